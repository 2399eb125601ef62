"""The registry of queries and their SQL, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detections as D
from .fixture import SQL, detections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AREA = "greatest(0e0, {0}x2 - {0}x1) * greatest(0e0, {0}y2 - {0}y1)"
BOTH = "greatest(0e0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0e0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
CONFIDENT = SQL + ", good AS MATERIALIZED (SELECT * FROM dets WHERE confidence >= 0.3) "
BOX = "page_id, det_id, class_name, confidence, x1, y1, x2, y2"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.confident(detections(spark, sf_dir))


def turns(spark, sf_dir) -> DataFrame:
    """Each turn with the next one of its conversation, ASCII only."""
    turns = table(spark, sf_dir, "conversations").withColumn("plain", text.strip_nonascii(F.col("text")))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "plain")
    return turns.withColumn("next", F.lead("plain").over(w)).filter("next is not null")


TURNS_SQL = r"""
WITH plain AS (SELECT *, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN trim(regexp_replace(regexp_replace(text, '[^\x00-\x7F]+', ' ', 'g'), '\s+', ' ', 'g')) ELSE text END AS plain FROM conversations),
turns AS (SELECT *, lead(plain) OVER (PARTITION BY conv_id ORDER BY turn, role, plain) AS next FROM plain)
"""
