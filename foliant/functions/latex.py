"""Class templates, formula repair and document assembly in LaTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import strip_delimiters
from .text import bullet_items, clean_ocr, rewrite, section_headers, strip

# What a document begins and ends with.
PREAMBLE = (
    "\\documentclass{article}\n\\usepackage[margin=2cm]{geometry}\n\\usepackage{amsmath}\n\\usepackage{graphicx}\n\\usepackage{booktabs}\n",
    "\\usepackage{xeCJK}\n",
    "\\usepackage[utf8]{inputenc}\n",
    "\\usepackage{ragged2e}\n\\setlength{\\emergencystretch}{3em}\n",
    "\\usepackage{paracol}\n",
    "\\begin{document}\n\\sloppy\n",
)
CLOSING = "\n\\end{document}\n"
# Repetitions that mark a formula reading as broken.
BROKEN = (r"(\\hline\s*){5,}", r"(\\cdot\s*){8,}", r"(\\quad\s*){8,}", r"(&\s*\{\s*\}\s*){5,}", r"\\mathrm\s*\{[^}]*(~\s*){5,}")
MOST_TILDES = 10
LOOPS = ((r"(~\s*){10,}", "~ "), (r"(\\![\s\\!]*){10,}", r"\\! "), (r"(\\q?quad\s*){5,}", r"\\qquad "))
# Names of arrows that are written out.
ARROWS = ((r"\\[Rr]arr\b", r"\\rightarrow"), (r"\\[Ll]arr\b", r"\\leftarrow"), (r"\\[Uu]arr\b", r"\\uparrow"), (r"\\[Dd]arr\b", r"\\downarrow"))


def _around(before: str, content: Column, after: str) -> Column:
    return F.concat(F.lit(before), content, F.lit(after))


def template(class_name: Column, content: Column) -> Column:
    """The fragment of one region; unknown classes become paragraphs of cleaned text."""
    cleaned = clean_ocr(content)
    headings = F.concat(F.array_join(F.transform(section_headers(content), lambda p: _around("\n\\subsection*{", clean_ocr(p), "}")), "\n"), F.lit("\n"))
    items = F.array_join(F.transform(bullet_items(content), lambda p: _around("\\item ", clean_ocr(p), "\n")), "\n")
    figure = (content == "") | content.startswith("\\includegraphics")
    # fixed values: the text around each class's content
    return (
        F.when(class_name == "Title", _around("\n\\begin{center}\n\\textbf{\\large ", cleaned, "}\n\\end{center}\n"))
        .when(class_name == "Section-header", headings)
        .when(class_name == "Caption", _around("\n\\textit{", cleaned, "}\n"))
        .when(class_name == "Footnote", _around("\\footnote{", cleaned, "}"))
        .when(class_name == "Page-footer", _around("% [footer: ", content, "]"))
        .when(class_name == "Page-header", _around("% [header: ", content, "]"))
        .when(class_name == "List-item", items)
        .when((class_name == "Formula") & ~figure, _around("\n\\begin{equation}\n", content, "\n\\end{equation}\n"))
        .when(class_name == "Formula", _around("\n\\begin{center}\n", content, "\n\\end{center}\n"))
        .when(class_name == "Table", _around("\n\\begin{center}\n\\resizebox{\\columnwidth}{!}{\n", content, "\n}\n\\end{center}\n"))
        .when(class_name == "Picture", _around("\n\\begin{center}\n\\includegraphics[width=0.8\\linewidth]{", content, "}\n\\end{center}\n"))
        .otherwise(_around("\n", cleaned, "\n"))
    )


def count_of(text: Column, literal: str) -> Column:
    """How often a literal stands in the text, also within longer commands."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def sanitize(text: Column) -> Column:
    """Write arrows out, collapse loops, then balance braces, arrays and left delimiters."""
    out = rewrite(text, ARROWS + LOOPS)
    missing = count_of(out, "{") - count_of(out, "}")
    # surplus closing braces: the last ones go
    surplus = F.greatest(F.lit(0), -missing)
    pieces = F.split(out, r"\}")
    keep = F.size(pieces) - 1 - surplus
    cut = F.concat(F.array_join(F.slice(pieces, 1, F.greatest(F.lit(1), keep + 1)), "}"), F.array_join(F.slice(pieces, keep + 2, F.greatest(F.lit(0), surplus)), ""))
    out = F.when(missing > 0, F.concat(out, F.repeat(F.lit("}"), missing))).when(missing < 0, cut).otherwise(out)
    for opened, closed, end in (("\\begin{array}", "\\end{array}", "\\end{array}"), ("\\left", "\\right", "\\right.")):
        lack = count_of(out, opened) - count_of(out, closed)
        out = F.when(lack > 0, F.concat(F.regexp_replace(out, r"\s+$", ""), F.repeat(F.lit(end), lack))).otherwise(out)
    return strip(out)


def passes_gate(text: Column, width: Column, height: Column) -> Column:
    """Whether a formula reading looks sound: no loops, few tildes, not absurdly long for its crop."""
    broken = text.rlike("|".join(BROKEN)) | (count_of(text, "~") >= MOST_TILDES)
    return (F.coalesce(text, F.lit("")) != "") & ~broken & (F.length(text) <= 10 * F.greatest(F.lit(80.0), width * height / 50))


def fragments(regions: DataFrame, content: str = "content", order: str = "reading") -> DataFrame:
    """(page_id, zone, ord, class_name, latex, is_list_item): empty tables drop out, pictures take running figure names.

    Figures count through the page in reading order over all zones.
    """
    from pyspark.sql import Window

    kept = regions.filter(~((F.col("class_name") == "Table") & (F.coalesce(content, F.lit("")) == "")))
    nth = F.sum((F.col("class_name") == "Picture").cast("int")).over(Window.partitionBy("page_id").orderBy(F.array_position(F.array(F.lit("full"), F.lit("left"), F.lit("right")), F.col("zone")), order))
    shown = F.when(F.col("class_name") == "Picture", F.format_string("assets/figures/figure_%03d.png", nth)).otherwise(F.coalesce(content, F.lit("")))
    return kept.select("page_id", "zone", F.col(order).alias("ord"), "class_name", template(F.col("class_name"), shown).alias("latex"), (F.col("class_name") == "List-item").alias("is_list_item"))


def bodies(parts: DataFrame) -> DataFrame:
    """(page_id, zone, body): fragments in order, runs of list items inside itemize."""
    from ..operators.layout import list_boundaries

    marked = list_boundaries(parts.withColumn("_grp", F.struct("page_id", "zone")), group="_grp")
    piece = F.concat(F.when(F.col("opens"), "\\begin{itemize}\n").otherwise(""), F.col("latex"), F.when(F.col("closes"), "\n\\end{itemize}").otherwise(""))
    gathered = marked.groupBy("page_id", "zone").agg(F.sort_array(F.collect_list(F.struct("ord", piece.alias("latex")))).alias("rows"))
    return gathered.select("page_id", "zone", F.array_join(F.transform("rows", lambda r: r["latex"]), "\n").alias("body"))


def page_documents(regions: DataFrame, content: str = "content", cjk: Column | None = None) -> DataFrame:
    """(page_id, tex) of regions placed by ``layout.placed``: (page_id, columns, grp, place, class_name, content).

    Groups follow each other, figures and lists run on; only pages of two
    columns set their groups 1 and 2 side by side.
    """
    zone = F.when(F.col("columns") == 2, F.element_at(F.array(F.lit("full"), F.lit("left"), F.lit("right")), (F.col("grp") + 1).cast("int"))).otherwise("full")
    order = F.col("grp") * 1_000_000 + F.col("place")
    parts = fragments(regions.withColumn("zone", zone).withColumn("_order", order), content, "_order")
    return documents(parts, cjk, pages=regions.groupBy("page_id").agg(F.max("columns").alias("columns")))


def documents(parts: DataFrame, cjk: Column | None = None, logo: Column | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, tex): one document a page, in two columns where boxes lie left and right of the middle, or as ``pages(page_id, columns)`` says."""
    body = bodies(parts).groupBy("page_id").agg(*[F.coalesce(F.max(F.when(F.col("zone") == z, F.col("body"))), F.lit("")).alias(z) for z in ("full", "left", "right")])
    two = (F.col("left") != "") & (F.col("right") != "")
    if pages is not None:
        body = pages.join(body, "page_id", "left").na.fill("", ["full", "left", "right"])
        two = F.col("columns") == 2
    head = F.concat(F.lit(PREAMBLE[0]), F.when(F.coalesce(cjk, F.lit(False)), PREAMBLE[1]).otherwise(PREAMBLE[2]) if cjk is not None else F.lit(PREAMBLE[2]), F.lit(PREAMBLE[3]), F.when(two, PREAMBLE[4]).otherwise(""), F.lit(PREAMBLE[5]))
    mark = F.lit("") if logo is None else F.when(logo.isNotNull(), _around("\n\\noindent\\hfill\\includegraphics[height=1.8em]{", logo, "}\\par\\noindent\\hrule\\vspace{4pt}\n")).otherwise("")
    columns = F.concat(F.col("full"), F.lit("\n\\begin{paracol}{2}\n\\RaggedRight\n"), F.col("left"), F.lit("\n\\switchcolumn\n\\RaggedRight\n"), F.col("right"), F.lit("\n\\end{paracol}\n"))
    single = F.concat_ws("\n", *[F.when(F.col(z) != "", F.col(z)) for z in ("full", "left", "right")])
    return body.select("page_id", F.concat(head, mark, F.when(two, columns).otherwise(single), F.lit(CLOSING)).alias("tex"))


# Environments whose content is the formula; lines that hold an equation's number.
FORMULA_ENV = r"\\begin\{(equation|align|gather|multline)\*?\}(.*?)\\end\{\1\*?\}"
EQUATION_NUMBER = r"(?m)^\s*\(\d+[a-z]?\)\s*$"


def formula_of_page_reading(text: Column) -> Column:
    """The formula in a full-page reading: out of its environment and delimiters, without equation numbers and leading lines of prose."""
    out = strip(text)
    out = strip(F.regexp_replace(out, r"(?s)^.*?" + FORMULA_ENV + ".*$", "$2"))
    out = strip(F.regexp_replace(out, r"(?s)^\\\[(.*)\\\].*$", "$1"))
    out = strip(F.regexp_replace(out, r"(?s)^\$\$(.*)\$\$.*$", "$1"))
    out = strip(F.regexp_replace(out, EQUATION_NUMBER, ""))
    # lines before the first one with a sign of mathematics go, if there is such a line
    out = strip(F.regexp_replace(out, r"^(?:[^\n\\_^{}=]*\n)+(?=[^\n]*[\\_^{}=])", ""))
    return strip(strip_delimiters(F.regexp_replace(out, r"\n\s*\n", "\n")))


def fallback_formula(whole: Column, rows: Column, columns: Column, width: Column, height: Column, name: Column) -> Column:
    """The first reading that is sound: the whole crop's, its rows' joined by line breaks, its columns' joined by spaces, else the crop as a figure."""
    joined = F.when((F.size(rows) > 1) & F.forall(rows, lambda r: r != ""), F.array_join(rows, " \\\\ "))
    beside = F.when((F.size(columns) > 1) & F.forall(columns, lambda c: c != ""), F.array_join(columns, " "))
    tried = [F.when(passes_gate(x, width, height), x) for x in (whole, joined, beside)]
    return F.coalesce(*tried, _around("\\includegraphics[width=\\linewidth]{", name, "}"))


def formula_page(line: Column) -> Column:
    """A document that shows one formula."""
    return _around("\\documentclass{article}\n\\usepackage{amsmath}\n\\begin{document}\n\\[\n", line, "\n\\]\n\\end{document}\n")
