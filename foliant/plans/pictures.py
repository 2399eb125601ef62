"""Queries over pixels: grey levels derived from the characters of documents, 32 to a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imaging
from .registry import query, table

_PIXELS = """WITH p AS (SELECT doc_id AS image_id, unnest(range(0, length(text))) AS i, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0),
  px AS MATERIALIZED (SELECT image_id, i // 32 AS y, i % 32 AS x, CAST(unicode(ch) * 37 % 256 AS BIGINT) AS grey FROM p) """


def pixels(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("length(text) > 0").select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "")).alias("i", "ch")).filter("ch <> ''")
    return rows.select("image_id", F.floor(F.col("i") / 32).cast("long").alias("y"), (F.col("i") % 32).cast("long").alias("x"), (F.ascii("ch").cast("long") * 37 % 256).alias("grey"))


@query(
    _PIXELS
    + """, h AS (SELECT image_id, grey, count(*) AS c FROM px GROUP BY ALL), q AS (SELECT *, sum(c) OVER (PARTITION BY image_id) AS n FROM h),
  e AS (SELECT image_id, count(*) FILTER (c >= greatest(1, floor(n * 1e-4))) AS occupied_bins, sum(-(c / CAST(n AS DOUBLE)) * log2(c / CAST(n AS DOUBLE))) / 8 AS entropy FROM q GROUP BY image_id)
  SELECT image_id, occupied_bins, round(entropy, 6) AS entropy, CASE WHEN entropy >= 0.55 THEN 'camera' ELSE 'screenshot' END AS modality, round(occupied_bins / 256e0, 6) AS occupancy, round(0.5 + 0.5 * least(1e0, abs(entropy - 0.55) / 0.5), 6) AS confidence FROM e"""
)
def capture_modality(spark, sf_dir):
    got = imaging.capture_modality(pixels(spark, sf_dir))
    return got.select("image_id", "occupied_bins", F.round("histogram_entropy", 6).alias("entropy"), "modality", F.round("bin_occupancy_ratio", 6).alias("occupancy"), F.round("confidence", 6).alias("confidence"))


@query(
    _PIXELS
    + """SELECT image_id, round(avg(CASE WHEN grey > 250 THEN 1e0 ELSE 0e0 END), 6) AS white_share, round(avg(CASE WHEN grey > 230 THEN 1e0 ELSE 0e0 END), 6) AS glare_share, round(stddev_pop(grey), 6) AS contrast, round(quantile_cont(grey, 0.9), 6) AS background,
    CASE WHEN stddev_pop(grey) < 40 THEN 'binarise' WHEN quantile_cont(grey, 0.9) < 200 THEN 'equalise' ELSE 'plain' END AS branch FROM px GROUP BY image_id"""
)
def pixel_report(spark, sf_dir):
    """White and glare shares, contrast, background level, and how a crop is prepared for reading."""
    got = imaging.pixel_report(pixels(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("white_share", "glare_share", "contrast")]
    return got.select("image_id", *rounded, F.round("background", 6).alias("background"), imaging.crop_branch(F.col("contrast"), F.col("background")).alias("branch"))


@query(
    _PIXELS
    + """, h AS (SELECT image_id, grey, count(*) AS c FROM px GROUP BY ALL), r AS (SELECT image_id, grey, sum(c) OVER w AS w0, sum(c * grey) OVER w AS s0, sum(c) OVER (PARTITION BY image_id) AS w, sum(c * grey) OVER (PARTITION BY image_id) AS s FROM h WINDOW w AS (PARTITION BY image_id ORDER BY grey)),
  b AS (SELECT image_id, grey, CAST(w0 AS DOUBLE) * CAST(w - w0 AS DOUBLE) * pow(s0 / CAST(w0 AS DOUBLE) - (s - s0) / CAST(w - w0 AS DOUBLE), 2) AS v FROM r WHERE w0 < w)
  SELECT image_id, arg_max(grey, (round(v, 3), -grey)) AS threshold FROM b GROUP BY image_id"""
)
def otsu_threshold(spark, sf_dir):
    return imaging.otsu(pixels(spark, sf_dir)).select("image_id", "threshold")


@query(
    _PIXELS
    + """, m AS (SELECT image_id, min(grey) AS lo, max(grey) AS hi FROM px GROUP BY ALL), s AS (SELECT p.*, (grey - lo) * 255e0 / (hi - lo) AS v FROM px p JOIN m USING (image_id) WHERE hi > lo)
  SELECT image_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM s WHERE v < 200 GROUP BY image_id"""
)
def ink_box(spark, sf_dir):
    return imaging.ink_box(pixels(spark, sf_dir))


def _bands(axis: str, least: int, merge: int) -> str:
    return f"""{_PIXELS}, k AS (SELECT image_id, {axis} AS pos_, count(*) FILTER (grey < 128) AS n FROM px GROUP BY ALL), f AS (SELECT image_id, pos_ FROM k QUALIFY n >= 0.05e0 * max(n) OVER (PARTITION BY image_id) AND n > 0),
  j AS (SELECT image_id, pos_, CASE WHEN pos_ - lag(pos_) OVER (PARTITION BY image_id ORDER BY pos_) > {max(1, merge)} THEN 1 ELSE 0 END AS fresh FROM f), r AS (SELECT image_id, pos_, sum(fresh) OVER (PARTITION BY image_id ORDER BY pos_) AS run FROM j)
  SELECT image_id, min(pos_) AS lo, max(pos_) AS hi FROM r GROUP BY image_id, run HAVING max(pos_) - min(pos_) + 1 >= {least}"""


@query(_bands("y", 8, 0))
def row_bands(spark, sf_dir):
    return imaging.row_bands(pixels(spark, sf_dir))


@query(_bands("x", 10, 15))
def column_bands(spark, sf_dir):
    return imaging.row_bands(pixels(spark, sf_dir), "x", 10, merge=15)


@query(
    _PIXELS
    + """, c AS (SELECT image_id, avg(grey) FILTER (i3 = 0) AS b, avg(grey) FILTER (i3 = 1) AS g, avg(grey) FILTER (i3 = 2) AS r FROM (SELECT *, x % 3 AS i3 FROM px) GROUP BY image_id)
  SELECT image_id, round(b, 6) AS b, round(g, 6) AS g, round(r, 6) AS r, round((b + g + r) / 3 / greatest(b, 1e-6), 6) AS gain_b FROM c WHERE b IS NOT NULL AND g IS NOT NULL AND r IS NOT NULL"""
)
def channel_means(spark, sf_dir):
    """Means of three channels and the gain that makes the first one grey; every third column stands for a channel."""
    means = imaging.channel_means(pixels(spark, sf_dir).withColumn("channel", F.col("x") % 3))
    return means.select("image_id", *[F.round(c, 6).alias(n) for c, n in (("m0", "b"), ("m1", "g"), ("m2", "r"))], F.round("gain0", 6).alias("gain_b"))
