"""Detections derived from the lineitem table: pages of 1000 by 1400 pixels with one to four columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, HEIGHT = 1000, 1400
# Class names by hash, in order.
CLASSES = ("Text", "Text", "Text", "Section-header", "Caption", "List-item", "List-item", "Formula", "Table", "Picture", "Footnote", "Page-header", "Title", "Page-footer")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    page = F.floor(F.col("l_orderkey") / 8).cast("long")
    order = Window.partitionBy("page_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = items.withColumn("page_id", page).withColumn("det_id", F.row_number().over(order).cast("long"))
    rows = rows.withColumn("ncols", 1 + F.col("page_id") % 4).withColumn("h", F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * 7)
    left = (F.col("l_partkey") % F.col("ncols")) * (F.lit(1000.0) / F.col("ncols"))
    wide = F.col("l_tax") == 0.08
    y1 = ((F.col("h") * 13) % 1300).cast("double")
    return rows.select(
        "page_id", "det_id",
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("h") % 14 + 1).cast("int")).alias("class_name"),
        ((20 + 8 * F.round(F.col("l_discount") * 100, 0)) / 100).alias("confidence"),
        F.when(wide, F.lit(20.0)).otherwise(left + 8 + F.col("h") % 5).alias("x1"), y1.alias("y1"),
        F.when(wide, F.lit(980.0)).otherwise(left + F.lit(1000.0) / F.col("ncols") - 16 - F.col("h") % 7).alias("x2"),
        (y1 + 12 + F.col("l_quantity")).alias("y2"),
    )


SQL = f"""
WITH items AS (
  SELECT *, CAST(l_orderkey // 8 AS BIGINT) AS page_id, l_partkey * 31 + l_suppkey * 17 + l_linenumber * 7 AS h FROM lineitem
), numbered AS (
  SELECT *, 1 + page_id % 4 AS ncols,
    CAST(row_number() OVER (PARTITION BY page_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS det_id
  FROM items
), dets AS MATERIALIZED (
  SELECT page_id, det_id, ({list(CLASSES)})[1 + h % 14] AS class_name, (20 + 8 * round(l_discount * 100, 0)) / 100 AS confidence,
    CASE WHEN l_tax = 0.08 THEN 20e0 ELSE (l_partkey % ncols) * (1000e0 / ncols) + 8 + h % 5 END AS x1,
    CAST((h * 13) % 1300 AS DOUBLE) AS y1,
    CASE WHEN l_tax = 0.08 THEN 980e0 ELSE (l_partkey % ncols) * (1000e0 / ncols) + 1000e0 / ncols - 16 - h % 7 END AS x2,
    CAST((h * 13) % 1300 AS DOUBLE) + 12 + l_quantity AS y2
  FROM numbered
)
"""
