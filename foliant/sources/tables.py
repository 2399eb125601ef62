"""Readers: plain tables, text corpora, ground-truth pages, dictionaries and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GT_PAGE = (
    "page_info STRUCT<image_path STRING, width INT, height INT, page_attribute STRING>, "
    "layout_dets ARRAY<STRUCT<category_type STRING, poly ARRAY<DOUBLE>, latex STRING, ignore BOOLEAN>>"
)
PAGE_ATTRIBUTE = "language STRING, data_source STRING, layout STRING"
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def images(spark: SparkSession, paths: str | list[str], suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Image files below ``paths``, by suffix: path, stem, length, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.filter(suffix.isin(*suffixes)).withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))


def attribute_struct(attribute: str = "page_attribute"):
    """A struct from JSON, or from the single-quoted text of a mapping; nothing is evaluated."""
    return F.from_json(F.regexp_replace(F.col(attribute), "'", '"'), PAGE_ATTRIBUTE)


def gt_pages(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth pages of a JSON array, attributes as a struct whichever way they were stored."""
    pages = spark.read.schema(GT_PAGE).option("multiLine", "true").json(path)
    info = F.struct("page_info.image_path", "page_info.width", "page_info.height", attribute_struct("page_info.page_attribute").alias("page_attribute"))
    return pages.withColumn("page_info", info)


def gt_formulas(pages: DataFrame, language: str = "english", category: str = "equation_isolated") -> DataFrame:
    """One row for each usable formula box of the language's pages: image_path, latex and its bounding box."""
    from ..functions.geometry import polygon_box

    flat = pages.filter(F.col("page_info.page_attribute.language") == language).select("page_info.image_path", F.explode("layout_dets").alias("d"))
    keep = (F.col("d.category_type") == category) & ~F.coalesce("d.ignore", F.lit(False)) & (F.trim(F.coalesce("d.latex", F.lit(""))) != "")
    return flat.filter(keep).select("image_path", "d.latex", F.col("d.poly").alias("poly")).select("image_path", "latex", *polygon_box("poly"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """image -> answer, the second turn's value, trimmed; of repeated images the last entry wins."""
    read = spark.read.schema("image STRING, conversations ARRAY<STRUCT<value STRING>>").option("multiLine", "true").json(path)
    rows = read.withColumn("ord", _file_order())
    last = rows.groupBy("image").agg(F.max_by("conversations", "ord").alias("conversations"))
    return last.select("image", F.regexp_replace(F.col("conversations")[1]["value"], r"^\s+|\s+$", "").alias("answer"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """stem and text of every file, read whole."""
    read = spark.read.text(path, wholetext=True)
    return read.select(F.regexp_extract("_metadata.file_name", r"^(.+?)(?:\.[^.]*)?$", 1).alias("stem"), F.col("value").alias("text"))


def _file_order():
    """Where a row stands: its file, then the part of it that a task reads, then its place there."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (dense, from 0, files in order of their paths) and stripped text of a corpus.

    Files are read in splits: lines are numbered within each split, and splits
    start where the counts of those before them end.
    """
    lines = spark.read.text(path).select(F.col("value").alias("text"), _file_order().alias("ord")).select("text", "ord.file", "ord.block", "ord.at")
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    starts = counts.select("file", "block", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("start"))
    own = lines.withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1)
    return own.join(starts, ["file", "block"]).select((F.col("start") + F.col("nth")).cast("long").alias("line_no"), strip_all(F.col("text")).alias("text"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """token -> replacement of a two-column TSV; the word None stands for the empty replacement; the later row wins."""
    rows = spark.read.csv(path, sep="\t", schema="token STRING, replacement STRING", quote="").withColumn("ord", _file_order())
    last = rows.groupBy("token").agg(F.max_by("replacement", "ord").alias("replacement"))
    return last.withColumn("replacement", F.when(F.col("replacement") == "None", "").otherwise(F.coalesce("replacement", F.lit(""))))


def design_tokens(lines: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of an indented list (line_no, text): an unindented line names the group of what follows it."""
    header = F.when(~F.col("text").rlike(r"^\s"), F.trim("text"))
    grouped = lines.withColumn("grp", F.last(header, ignorenulls=True).over(Window.orderBy("line_no")))
    kept = grouped.filter(F.col("text").rlike(r"^\s") & (F.trim("text") != "") & ~F.coalesce(F.col("grp").isin(*ignored), F.lit(False)))
    return kept.select("grp", F.trim("text").alias("token"))


def latest(files: DataFrame) -> DataFrame:
    """The row of the file that was modified last."""
    return files.orderBy(F.col("modificationTime").desc(), "path").limit(1)


def merge_corpora(*corpora: DataFrame) -> DataFrame:
    """Corpora one after the other, rows without a caption dropped."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c)
    return out.filter(F.trim(F.coalesce("text", F.lit(""))) != "")


def numbered_images(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Corpus lines whose image ``%07d.png`` exists in names(name)."""
    return lines.withColumn("name", F.format_string("%07d.png", "line_no")).join(names, "name", "left_semi")


def strip_all(column):
    """Without white space at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def formula_crops(pages: DataFrame, most: int, language: str = "english", category: str = "equation_isolated") -> DataFrame:
    """(crop_id, image_path, latex, x1, y1, x2, y2): usable formula boxes by two corners of their outline, 16 by 8 pixels at least, the first ``most`` of them numbered."""
    flat = pages.filter(F.col("page_info.page_attribute.language") == language).select("page_info.image_path", F.posexplode("layout_dets").alias("pos", "d"))
    corner = [F.try_element_at("d.poly", F.lit(i + 1)).alias(n) for i, n in ((0, "x1"), (1, "y1"), (4, "x2"), (5, "y2"))]
    kept = flat.filter((F.col("d.category_type") == category) & ~F.coalesce("d.ignore", F.lit(False)) & (F.coalesce("d.latex", F.lit("")) != ""))
    boxes = kept.select("image_path", "pos", "d.latex", *corner).filter("x2 - x1 >= 16 and y2 - y1 >= 8")
    first = boxes.orderBy("image_path", "pos").limit(most)
    nth = F.row_number().over(Window.orderBy("image_path", "pos")) - 1
    return first.select(F.format_string("f%04d", nth).alias("crop_id"), "image_path", "latex", "x1", "y1", "x2", "y2")


def image_text_pairs(images: DataFrame, lines: DataFrame) -> DataFrame:
    """(image, text) of images(path, content) and the corpus lines whose number their stem is."""
    numbered = images.select(F.regexp_extract("path", r"([0-9]+)\.[^./]+$", 1).alias("stem"), F.col("content").alias("image")).filter("stem <> ''")
    return numbered.join(lines.withColumn("stem", F.lpad(F.col("line_no").cast("string"), 7, "0")), "stem").select("image", "text")


def image_bytes(cell: str) -> Column:
    """The bytes of an image cell that is a struct with them, or bytes."""
    return F.coalesce(F.get_json_object(F.col(cell), "$.bytes"), F.col(cell))


def captions(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """name and text of a two-column TSV, in an order fixed by the seed."""
    rows = spark.read.csv(path, sep="\t", schema="name STRING, text STRING", quote="")
    return shuffled(rows, ["name", "text"], seed)


def shuffled(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows in an order fixed by their keys and the seed."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary")), *keys)


def named_sets(spark: SparkSession, root: str) -> DataFrame:
    """Text lines of every sub-directory of ``root``, each named after its directory."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    return lines.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("dataset"), strip_all(F.col("value")).alias("text"))


def keep_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct tokens of a list, one a line; blank lines are left out."""
    return spark.read.text(path).select(F.col("value").alias("token")).filter(F.trim("token") != "").distinct()


def tokenizer_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(token, old_id) and (rank, left, right, merged) of a tokenizer's JSON file."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "model STRUCT<vocab MAP<STRING, BIGINT>, merges ARRAY<STRING>>").alias("j"))
    vocabulary = whole.select(F.explode("j.model.vocab").alias("token", "old_id"))
    merges = whole.select(F.posexplode("j.model.merges").alias("rank", "m")).select("rank", *[F.split("m", " ")[i].alias(n) for i, n in enumerate(("left", "right"))])
    return vocabulary, merges.withColumn("merged", F.concat("left", "right"))


def with_images(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Corpus rows (name, text) that have a caption and an image in files(name)."""
    return lines.filter(F.trim(F.coalesce("text", F.lit(""))) != "").join(files.select("name").distinct(), "name", "left_semi")


def scored_pages(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """truth(stem, gold) with pred, and ``missed`` where no prediction stands."""
    return truth.join(predictions.select("stem", F.col("text").alias("pred")), "stem", "left").withColumn("missed", F.col("pred").isNull())
