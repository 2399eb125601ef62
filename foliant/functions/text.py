"""OCR text repair, escaping, language decisions and plain-text extraction, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Repairs in the order in which they apply; later ones see what earlier ones made.
OCR_REPAIRS = (
    # a digit must not follow a group number, so such groups have a name
    (r"(?U)\bt0\b", "to"),
    (r"\[IO\]", "[10]"),
    (r"\[I0\]", "[10]"),
    (r"(?U)(?<=\d)O\b", "0"),
    (r"(?U)(?<=\d)O(?=\d)", "0"),
    (r"(?U)\b1(\d{1,2})1\b", "[$1]"),
    (r"(?U)\bl(\d{1,2})l\b", "[$1]"),
    (r"(?U)\[[iI](\d{1,2})\]", "[$1]"),
    (r"(?U)\[(\d{1,2})1\b", "[$1]"),
    (r"(?U)\b1(\d{1,2})\]", "[$1]"),
    (r"(?U)\bI(\d)", "1$1"),
    (r"(?U)(?<d>\d)I(\d)", "${d}1$2"),
    (r"(?U)(?<d>\d)I\b", "${d}1"),
    (r"(?U)\bIS([A-Z])", "18$1"),
    (r"(?U)(?<d>\d)S([KMGkm%])", "${d}8$2"),
    (r"(?U)\\\\_(?=\s|$)", "."),
    (r"(?U)_(?=\s|$)", "."),
    (r"(?U)(?<!\$)\b(1\.5)\s*[xX]\s*10-(\d)\b", r"\$$1\\times10^{-$2}\$"),
    (r"(?U)(?<!\$)\b(5)\s*[xX]\s*10-(\d)\b", r"\$5\\times10^{-$2}\$"),
    (r"(?U)(?<!\$)\b10-(\d)\b", r"\$10^{-$1}\$"),
    (r"(?U)\b([A-Z])\.((?:[IVX]+|[A-Z]{2})[A-Z]*)", "$1. $2"),
    (r"(?U)(\w) ?-[\s]+([a-z])", "$1$2"),
    (r"(?U)\b(\d{1,3})\.(\d{3})\b", "$1,$2"),
)
# How bullets and headings begin, what is escaped, which code points are CJK, what plain text lacks.
BULLET_START = r"^(?:[•–]\s+|\d+[.)]\s+|\bModel\s+[A-D][\s:\-.]|Level\s+\d|(?:[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){0,3}):(?:\s|$))"
BULLET_SPLIT = r"(?<!^)(?=\bModel\s+[A-D][\s:\-.])"
HEADER_SPLIT = r"(?<!^)(?=(?:(?<![IVXLCDMivxlcdm])[IVX]+\.[ \t])|(?:(?<![A-Z])[A-Z]\.[ \t]))"
ESCAPES = (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}]"
PLAIN = (
    (r"<table[^>]*>", ""),
    (r"</table>", ""),
    (r"<tr>", ""),
    (r"</tr>", "\n"),
    (r"(?s)<td>(.*?)</td>", "$1 "),
    (r"(?s)\\\[(.*?)\\\]", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*{1,2}(.*?)\*{1,2}", "$1"),
    (r"[ \t]+", " "),
    (r"\n{2,}", "\n"),
)


def rewrite(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Apply (pattern, replacement) rules one after the other."""
    return reduce(lambda c, r: F.regexp_replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def strip(text: Column) -> Column:
    """Without white space at both ends, whatever its kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_ocr(text: Column) -> Column:
    return strip(rewrite(text, OCR_REPAIRS))


def section_label(text: Column) -> Column:
    """A letter run into a capitalised heading gets its full stop."""
    return F.regexp_replace(text, r"^([A-Z])([A-Z]{3,})", "$1. $2")


def section_headers(text: Column) -> Column:
    """Headings that were read as one, split before each label."""
    parts = F.transform(F.split(text, HEADER_SPLIT), strip)
    return F.transform(F.filter(parts, lambda p: p != ""), section_label)


def escape_latex(text: Column) -> Column:
    """Escape nine characters; the backslash stays as it is."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), ESCAPES, text)


def strip_nonascii(text: Column) -> Column:
    """Pure ASCII stays; else other characters go and all white space collapses, newlines too."""
    cleaned = strip(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]+", " "), r"\s+", " "))
    return F.when(text.rlike(r"[^\x00-\x7F]"), cleaned).otherwise(text)


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK)).cast("long")


def language(cjk: Column, visible: Column) -> Column:
    """cjk, mixed or english from the counts of CJK and of other visible characters."""
    return F.when((cjk > 0) & ((visible < 10) | (cjk > visible)), "cjk").when(cjk > 0, "mixed").otherwise("english")


def bullet_start(text: Column) -> Column:
    return text.rlike(BULLET_START)


def bullet_items(text: Column) -> Column:
    """Lines grouped into bullets: each line that starts one opens a group; one line may still split on its labels."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    empty = F.array().cast("array<string>")
    joined = F.aggregate(
        lines, empty,
        lambda out, x: F.when(bullet_start(x) | (F.size(out) == 0), F.concat(out, F.array(x))).otherwise(
            F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(out, -1), x)))
        ),
    )
    labelled = F.filter(F.transform(F.split(text, BULLET_SPLIT), strip), lambda x: x != "")
    return F.when(F.size(joined) > 1, joined).otherwise(labelled)


def plain_text(text: Column) -> Column:
    """Text without table tags, display-math and heading marks and emphasis, for scoring."""
    return strip(rewrite(text, PLAIN))


def join_cjk(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def better_reading(english: Column, cjk: Column) -> Column:
    """Of two readings the longer one, the first on a tie."""
    return F.when(F.length(english) >= F.length(cjk), english).otherwise(cjk)


def seconds_from_log(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"done in ([\d.]+)s", 1), F.lit("")).cast("double")


def accuracy(distance: Column) -> Column:
    """A distance as the percentage that is right, one decimal; N/A for null."""
    return F.when(distance.isNull(), "N/A").otherwise(F.format_string("%.1f%%", (1 - distance) * 100))


def four_places(distance: Column) -> Column:
    return F.when(distance.isNull(), "N/A").otherwise(F.format_string("%.4f", distance))


def bar(distance: Column, width: int = 20) -> Column:
    """What is right as a bar, cut to whole blocks; blank for null."""
    full = ((1 - distance) * width).cast("int")
    return F.when(distance.isNull(), " " * width).otherwise(F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full)))


def shortened(text: Column, most: int = 60) -> Column:
    """At most ``most`` characters, an ellipsis where something is cut off."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def reading_of(result: Column) -> Column:
    """The text of a model's JSON result, under whichever name it stands."""
    return F.coalesce(*[F.get_json_object(result, p) for p in ("$.rec_formula", "$.res.rec_formula", "$.rec_text", "$.text")], F.lit(""))
