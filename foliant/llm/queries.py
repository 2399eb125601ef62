"""The registered query of every operator of this subpackage, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_quality, langid, toxicity
from .boilerplate import drop_boilerplate
from .bpe import bpe
from .hilbert import hilbert_shards
from .jaccard import jaccard_components
from .learning import fold
from .mixing import mixture
from .mpeg import read_mpeg, to_mpeg
from .neardup import near_duplicates

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(_documents(spark, sf_dir), shards=24, law="rows")


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_mpeg(to_mpeg(_documents(spark, sf_dir), unit=64))
    n = F.length("payload")
    feature = F.concat_ws(
        ";",
        F.format_string("mpeg%s-%d/%dHz/%dch", F.format_number("version", 1), "layer", "hertz", "channels"),
        F.format_string("frames=%d,samples=%d", "n_frames", "n_samples"),
        F.format_string("crc=%d/%d,resyncs=%d,skipped=%d", "crc_good", "crc_bad", "resyncs", "skipped"),
        F.format_string("%s=%d", "table_kind", "table_frames"),
        F.concat(F.lit("kbps="), F.array_join("kbps", "+")),
        F.concat(F.lit("seek="), F.crc32(F.array_join("seek", ",").cast("binary"))),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        n.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).cast("long").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "seconds",
        F.col("seek").alias("seek_offsets"),
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe(_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir), k=4, num=85, den=100)


def _labels(spark: SparkSession, sf_dir: str, column: str, folds: int, held: int) -> DataFrame:
    """Labels to learn from: all but the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter(fold("doc_id", folds) != held).select("doc_id", F.col(column).alias("label"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = compression_quality.fit(docs, _labels(spark, sf_dir, "quality", 5, 0))
    scored = compression_quality.score(docs, model, threshold=0.3)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_boilerplate(_documents(spark, sf_dir).select("doc_id", "text", "source"), report="report")
    return cleaned.select("doc_id", "text", F.col("report.lines").alias("n_lines"), F.col("report.removed").alias("n_removed"))


def op7_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, _labels(spark, sf_dir, "toxic", 3, 1))
    scored = toxicity.score(docs, model, threshold=0.7)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op8_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.filter(fold("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(_documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op10_hnsw_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


QUERIES = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_mpeg_audio": op2_mpeg_audio,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_compression_quality": op5_compression_quality,
    "op6_line_spread": op6_line_spread,
    "op7_nb_toxicity": op7_nb_toxicity,
    "op8_word_backoff_langid": op8_word_backoff_langid,
    "op9_source_mixing": op9_source_mixing,
    "op10_hnsw_near_duplicates": op10_hnsw_near_duplicates,
}

_MIXTURE_SQL = r"""
WITH sized AS (
  SELECT *, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), ranked AS (
  SELECT *, CAST(sum(3 * source_size) OVER o - 3 * source_size AS BIGINT) AS before,
         CAST(sum(weight) OVER () - sum(weight) OVER o + weight AS BIGINT) AS rest,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM per WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST)
), levels AS (
  SELECT *, CAST(total - before AS DOUBLE) / rest AS level FROM ranked
), filled AS (
  SELECT (SELECT arg_min(level, before - rest) FROM levels WHERE level * weight <= 3 * source_size) AS fill
), targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), fill * weight) AS target FROM levels, filled
), rated AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), mixed AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated
)
"""

_LINES_SQL = """
WITH lines AS (
  SELECT doc_id, text, source, i AS pos, string_split(text, chr(10))[i] AS line
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), spread AS (
  SELECT line, min((doc_id, pos)) AS first
  FROM lines WHERE length(line) >= 10
  GROUP BY line HAVING count(DISTINCT coalesce('s' || source, 'null')) >= 10
), marked AS (
  SELECT l.doc_id, l.text, l.pos, l.line, s.line IS NOT NULL AND (l.doc_id, l.pos) <> s.first AS gone
  FROM (SELECT DISTINCT doc_id, text, pos, line FROM lines) l LEFT JOIN spread s ON l.line = s.line
), kept AS (
  SELECT doc_id, text, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS cleaned,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM marked GROUP BY doc_id, text
)
SELECT d.doc_id, k.cleaned AS text, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.text = k.text
"""

ORACLES: dict[str, str] = {
    "op6_line_spread": _LINES_SQL,
    "op9_source_mixing": _MIXTURE_SQL + "SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM mixed",
}
