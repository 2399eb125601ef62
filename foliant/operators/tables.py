"""Tables: tokens to a grid of rows and columns, and the grid as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlap_1d
from .detections import by_page

# Structure thresholds that results depend on.
LEAST_SCORE = 0.5
WIDE_COLUMN = 0.85
WIDE_TOKEN = 0.8


def table_tokens(tokens: DataFrame, width: float) -> DataFrame:
    """Tokens without blanks, rule lines and strings across the table."""
    return tokens.filter((F.trim("text") != "") & ~F.trim("text").rlike(r"^[-_=.]+$") & (F.col("x2") - F.col("x1") <= WIDE_TOKEN * width))


def axes(structure: DataFrame, width: float) -> DataFrame:
    """(page_id, det_id, axis, idx, lo, hi) from labelled, scored boxes: rows that are no headers, columns of whatever kind, no wide ones."""
    axis = F.when(F.col("label").contains("row") & ~F.col("label").contains("header"), "row").when(F.col("label").contains("column"), "column")
    kept = structure.filter(F.col("score") > LEAST_SCORE).withColumn("axis", axis).filter("axis is not null")
    kept = kept.filter((F.col("axis") == "row") | (F.col("x2") - F.col("x1") < WIDE_COLUMN * width))
    low, high = (F.when(F.col("axis") == "row", F.col(f"y{i}")).otherwise(F.col(f"x{i}")) for i in (1, 2))
    spans = kept.select("page_id", "det_id", "axis", low.alias("lo"), high.alias("hi"))
    return spans.withColumn("idx", F.row_number().over(Window.partitionBy("page_id", "det_id", "axis").orderBy("lo", "hi")) - 1)


def assign(tokens: DataFrame, axis: DataFrame, name: str, low: str, high: str) -> DataFrame:
    """Add ``name``: the span with the largest overlap over the shorter extent; the first on a tie, 0 where none overlaps."""
    spans = axis.select("page_id", "det_id", F.col("idx").alias("_idx"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    share = overlap_1d(F.col(low), F.col(high), F.col("_lo"), F.col("_hi"))
    best = tokens.join(spans, ["page_id", "det_id"], "left").groupBy("page_id", "det_id", "tok_id").agg(F.max_by("_idx", F.struct(share, -F.col("_idx"))).alias(name))
    return tokens.join(best, ["page_id", "det_id", "tok_id"]).withColumn(name, F.coalesce(name, F.lit(0)))


def grid(tokens: DataFrame, structure: DataFrame) -> DataFrame:
    """(page_id, det_id, row, col, cell): tokens of a cell from left to right, joined by spaces."""
    placed = assign(tokens, structure.filter("axis = 'row'"), "row", "y1", "y2")
    placed = assign(placed, structure.filter("axis = 'column'"), "col", "x1", "x2")
    cells = placed.groupBy("page_id", "det_id", "row", "col").agg(F.sort_array(F.collect_list(F.struct("y1", "x1", "text"))).alias("t"))
    return cells.select("page_id", "det_id", "row", "col", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("cell"))


def grid_html(cells: DataFrame) -> DataFrame:
    """(page_id, det_id, html): rows in order with every column, rows without text left out."""
    wide = cells.groupBy("page_id", "det_id").agg(F.max("col").alias("last"))
    rows = cells.groupBy("page_id", "det_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("cells")).join(wide, ["page_id", "det_id"])
    shown = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.concat(F.lit("<td>"), F.coalesce(F.try_element_at("cells", i), F.lit("")), F.lit("</td>")))
    lines = rows.filter(F.exists(F.map_values("cells"), lambda c: F.trim(c) != "")).select("page_id", "det_id", "row", F.concat(F.lit("<tr>"), F.array_join(shown, ""), F.lit("</tr>")).alias("tr"))
    gathered = lines.groupBy("page_id", "det_id").agg(F.sort_array(F.collect_list(F.struct("row", "tr"))).alias("t"))
    return gathered.select("page_id", "det_id", F.concat(F.lit('<table border="1">'), F.array_join(F.transform("t", lambda x: x["tr"]), ""), F.lit("</table>")).alias("html"))


def grid_tex(cells: DataFrame) -> DataFrame:
    """(page_id, det_id, tex): the same grid as a ruled LaTeX table, the first row as its head."""
    wide = cells.groupBy("page_id", "det_id").agg(F.max("col").alias("last"))
    rows = cells.groupBy("page_id", "det_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "cell"))).alias("cells")).join(wide, ["page_id", "det_id"])
    shown = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit("")))
    lines = rows.filter(F.exists(F.map_values("cells"), lambda c: F.trim(c) != "")).select("page_id", "det_id", "row", "last", F.concat(F.array_join(shown, " & "), F.lit(" \\\\")).alias("line"))
    gathered = lines.groupBy("page_id", "det_id").agg(F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct("row", "line"))).alias("t"))
    body = F.array_join(F.transform("t", lambda x, i: F.concat(x["line"], F.when(i == 0, "\n\\midrule").otherwise(""))), "\n")
    tex = F.concat(F.lit("\\begin{tabular}{"), F.repeat(F.lit("l"), (F.col("last") + 1).cast("int")), F.lit("}\n\\toprule\n"), body, F.lit("\n\\bottomrule\n\\end{tabular}"))
    return gathered.select("page_id", "det_id", tex.alias("tex"))


def first_table(*made: Column) -> Column:
    """The first table that holds anything, else none."""
    return F.coalesce(*[F.nullif(m, F.lit("")) for m in made], F.lit(""))


def rows_by_height(tokens: DataFrame, width: float) -> DataFrame:
    """(page_id, det_id, body): tokens in rows of equal rounded height, ties to even, cells parted by ampersands."""
    height = F.bround((F.col("y1") + F.col("y2")) / 2 / max(width * 0.015, 1)).cast("long")
    rows = tokens.groupBy("page_id", "det_id", height.alias("k")).agg(F.sort_array(F.collect_list(F.struct("x1", "tok_id", "text"))).alias("t"))
    lines = rows.select("page_id", "det_id", "k", F.array_join(F.transform("t", lambda x: x["text"]), " & ").alias("line"))
    gathered = lines.groupBy("page_id", "det_id").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("t"))
    return gathered.select("page_id", "det_id", F.array_join(F.transform("t", lambda x: x["line"]), " \\\\\n").alias("body"))


def running_rows_page(rows: list[dict]) -> list[dict]:
    """Row numbers by distance to the running mean of the current row's centres, under 0.6 of a token's height or of ten pixels."""
    out: list[dict] = []
    for region in dict.fromkeys(r["det_id"] for r in rows):
        mean, n, row = 0.0, 0, -1
        for t in sorted((r for r in rows if r["det_id"] == region), key=lambda r: ((r["y1"] + r["y2"]) / 2, r["tok_id"])):
            y = (t["y1"] + t["y2"]) / 2
            if n and abs(y - mean) < max(t["y2"] - t["y1"], 10) * 0.6:
                mean, n = (mean * n + y) / (n + 1), n + 1
            else:
                mean, n, row = y, 1, row + 1
            out.append(t | {"row": row})
    return out


TOKEN = "page_id long, det_id long, tok_id long, text string, x1 double, x2 double, y1 double, y2 double"


def running_rows(tokens: DataFrame) -> DataFrame:
    """Tokens with ``row``, clustered within each region by a running mean."""
    names = tuple(x.split()[0] for x in TOKEN.split(", "))
    return by_page(tokens.select(*[F.col(n).cast("long") if n in ("page_id", "det_id", "tok_id") else F.col(n) for n in names]), running_rows_page, TOKEN + ", row long", names)


def column_segments(tokens: DataFrame, width: int) -> DataFrame:
    """(page_id, det_id, idx, lo, hi): maximal runs of pixel columns [lo, hi) under some token that is not over 40 % wide; the whole width if there is none."""
    clipped = [F.greatest(F.lit(0), F.col("x1").cast("long")).alias("l"), F.least(F.lit(width), F.col("x2").cast("long")).alias("r")]
    spans = tokens.filter(F.col("x2") - F.col("x1") <= 0.4 * width).select("page_id", "det_id", *clipped).filter("r > l")
    w = Window.partitionBy("page_id", "det_id").orderBy("l", "r")
    reach = F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("fresh", (reach.isNull() | (F.col("l") > reach)).cast("int"))
    grouped = marked.withColumn("idx", F.sum("fresh").over(w) - 1).groupBy("page_id", "det_id", "idx").agg(F.min("l").alias("lo"), F.max("r").alias("hi"))
    bare = tokens.select("page_id", "det_id").distinct().join(spans.select("page_id", "det_id").distinct(), ["page_id", "det_id"], "left_anti")
    return grouped.unionByName(bare.select("page_id", "det_id", F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("lo"), F.lit(width).cast("long").alias("hi")))


def nearest(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """Tokens with ``col``: the segment that overlaps most, the first of equals; where none overlaps, the nearest to the centre."""
    both = tokens.join(segments.select("page_id", "det_id", "idx", "lo", "hi"), ["page_id", "det_id"])
    shared = F.greatest(F.lit(0.0), F.least("x2", "hi") - F.greatest("x1", "lo"))
    centre = (F.col("x1") + F.col("x2")) / 2
    away = F.when((shared > 0) | centre.between(F.col("lo"), F.col("hi")), 0.0).otherwise(F.least(F.abs(centre - F.col("lo")), F.abs(centre - F.col("hi"))))
    best = both.groupBy("page_id", "det_id", "tok_id").agg(F.min_by("idx", F.struct(-shared, away, F.col("idx"))).alias("col"))
    return tokens.join(best, ["page_id", "det_id", "tok_id"])


def words_inside(regions: DataFrame, words: DataFrame) -> DataFrame:
    """regions(page_id, det_id, x1, ...) with each word(page_id, cx, cy, ...) whose centre lies in them; regions without one stay."""
    boxes = regions.select("page_id", "det_id", "x1", "y1", "x2", "y2")
    found = boxes.join(words, "page_id").filter("cx >= x1 and cx <= x2 and cy >= y1 and cy <= y2").drop("x1", "y1", "x2", "y2")
    return regions.select("page_id", "det_id").join(found, ["page_id", "det_id"], "left")


def strips(crops: DataFrame, gap: int = 20) -> DataFrame:
    """crops(page_id, det_id, height) with ``top`` and ``bottom`` in an image that stacks a page's crops, ``gap`` pixels apart."""
    below = F.sum(F.col("height") + gap).over(Window.partitionBy("page_id").orderBy("det_id"))
    return crops.withColumn("top", below - F.col("height") - gap).withColumn("bottom", F.col("top") + F.col("height"))


def unstitched(hits: DataFrame, stacked: DataFrame) -> DataFrame:
    """hits(page_id, cy, ...) with the crop they lie in and ``y`` within it; those between crops are dropped."""
    spans = stacked.select("page_id", "det_id", "top", "bottom")
    return hits.join(spans, "page_id").filter("cy >= top and cy < bottom").withColumn("y", F.col("cy") - F.col("top")).drop("top", "bottom")


def ocr_lines(tokens: DataFrame) -> DataFrame:
    """(page_id, det_id, line, text): lines where centres step by over 0.6 of the lower height, words spaced by gaps.

    A gap of 0.35 of the line's median character width or more is a space.
    """
    region = Window.partitionBy("page_id", "det_id")
    down = region.orderBy("cy", "x1", "tok_id")
    rows = tokens.withColumn("cy", (F.col("y1") + F.col("y2")) / 2).withColumn("h", F.col("y2") - F.col("y1"))
    step = F.abs(F.col("cy") - F.lag("cy").over(down)) > 0.6 * F.least("h", F.lag("h").over(down))
    rows = rows.withColumn("_new", F.coalesce(step, F.lit(False)).cast("int")).withColumn("line", F.sum("_new").over(down))
    line = Window.partitionBy("page_id", "det_id", "line")
    across = line.orderBy("x1", "tok_id")
    wide = F.percentile((F.col("x2") - F.col("x1")) / F.greatest(F.length("text"), F.lit(1)), 0.5).over(line)
    rows = rows.withColumn("_gap", F.col("x1") - F.lag("x2").over(across)).withColumn("_w", wide).withColumn("_i", F.row_number().over(across))
    word = F.concat(F.when(F.col("_gap") >= 0.35 * F.col("_w"), " ").otherwise(""), F.col("text"))
    got = rows.groupBy("page_id", "det_id", "line").agg(F.sort_array(F.collect_list(F.struct("_i", word.alias("t")))).alias("t"))
    return got.select("page_id", "det_id", "line", F.array_join(F.transform("t", lambda x: x["t"]), "").alias("text"))
