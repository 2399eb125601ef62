"""Writers: documents by page, figures, error side outputs, vocabularies and JSON summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_documents(documents: DataFrame, path: str, column: str = "tex") -> None:
    """One text file a page, replacing what was there; a failed page is an empty file."""
    documents.select("page_id", F.coalesce(column, F.lit("")).alias("value")).write.mode("overwrite").partitionBy("page_id").text(path)


def write_with_errors(lines: DataFrame, path: str, errors: str) -> None:
    """Lines with ``result`` and ``error``: the original stays where an error is set, and errors go to a second sink."""
    lines.select(F.when(F.col("error").isNull(), F.col("result")).otherwise(F.col("text")).alias("value")).write.mode("overwrite").text(path)
    lines.filter("error is not null").select(F.concat_ws("\t", F.col("line_no").cast("string"), "error").alias("value")).write.mode("overwrite").text(errors)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """``token count`` lines, commonest first."""
    vocabulary.orderBy(F.col("cnt").desc(), "token").select(F.concat_ws(" ", "token", F.col("cnt").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_table(frame: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    writer = frame.write.mode("overwrite").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)


def as_json_map(key: str, *values: str) -> Column:
    """An aggregate: one JSON object from key to a struct of values."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*values).alias("value"))))
    return F.to_json(F.map_from_entries(entries))


def figure_name(n: Column) -> Column:
    return F.format_string("figure_%03d.png", n)


def formula_name(n: Column) -> Column:
    return F.format_string("formula_%03d.png", n)
