"""Line dedup by distinct-site spread: HyperLogLog sketches of the sites that each line stands on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

_BROADCAST_LINES = 200_000


def _site(site: str) -> Column:
    """The site as text, null apart from every value."""
    return F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("null"))


def _lines(docs: DataFrame, site: str, least_chars: int) -> DataFrame:
    rows = docs.select(
        F.xxhash64("doc_id", "text").alias("_row"), F.crc32(F.col("text").cast("binary")).alias("_sum"), F.col("doc_id").cast("long").alias("_doc"),
        _site(site).alias("_site"), F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"),
    )
    return rows.filter(F.length("_line") >= least_chars).withColumn("_hash", F.xxhash64("_line"))


def spread(docs: DataFrame, site: str = "source", sites: int = 10, least_chars: int = 10, log_k: int = 10) -> DataFrame:
    """Lines on at least ``sites`` distinct sites: _hash, and _first, the (doc, position) that comes first.

    One sketch for each line hash merges map-side. Where the estimate is within
    a quarter of ``sites``, eight standard errors at 2**10 registers, the sites
    are counted exactly; elsewhere the estimate decides.
    """
    lines = _lines(docs, site, least_chars)
    sketched = lines.groupBy("_hash").agg(F.hll_sketch_agg("_site", F.lit(log_k)).alias("_sketch"), F.count("*").alias("_n"), F.min(F.struct("_doc", "_pos")).alias("_first"))
    likely = sketched.filter(F.col("_n") >= sites).withColumn("_sites", F.hll_sketch_estimate("_sketch")).filter(F.col("_sites") >= sites * 0.75)
    likely = cut(likely.select("_hash", "_first", "_sites"))
    near = likely.filter(F.col("_sites") <= sites * 1.25).select("_hash")
    exact = lines.join(near, "_hash", "left_semi").select("_hash", "_site").distinct().groupBy("_hash").agg(F.count("*").alias("_exact"))
    decided = likely.join(exact, "_hash", "left")
    return cut(decided.filter(F.coalesce("_exact", "_sites") >= sites).select("_hash", "_first"))


def drop_boilerplate(docs: DataFrame, site: str = "source", sites: int = 10, least_chars: int = 10, report: str | None = None) -> DataFrame:
    """Remove every line that stands on ``sites`` or more distinct sites, save its first occurrence.

    First is the smallest (doc_id, line number). Lines are what newlines
    separate; those under ``least_chars`` characters are never boilerplate. A
    null site is a site of its own. All rows and columns stay; text loses the
    lines, n_chars (if there) is counted anew where it did. ``report`` names an
    added struct column (lines, removed) and replaces one of that name. Null
    and empty texts stay as they are; repeated rows are treated alike; an empty
    table stays empty. A line's identity is a 64-bit hash.

    Only line hashes and sites are shuffled for the spread. The boilerplate
    lines are broadcast while they are at most 200,000, counted first; texts are
    shuffled once to meet what they lose.
    """
    found = spread(docs, site, sites, least_chars)
    marked = F.broadcast(found) if found.count() <= _BROADCAST_LINES else found
    hits = _lines(docs, site, least_chars).join(marked, "_hash").filter(~F.struct("_doc", "_pos").eqNullSafe(F.col("_first")))
    lost = hits.groupBy("_row", "_sum").agg(F.collect_set("_pos").alias("_lost"))
    columns = [c for c in docs.columns if c != report]
    rows = docs.select(*columns).withColumn("_row", F.xxhash64("doc_id", "text")).withColumn("_sum", F.crc32(F.col("text").cast("binary")))
    rows = rows.join(lost, ["_row", "_sum"], "left")
    lines = F.split("text", "\n", -1)
    hit = F.col("_lost").isNotNull()
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_lost")
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    rows = rows.withColumn("_count", F.size(lines)).withColumn("_kept", F.when(hit, kept))  # apart from the new text: inside a lambda, its name would mean the new one
    new = {"text": F.when(hit, F.col("_kept")).otherwise(F.col("text"))}
    if "n_chars" in columns:
        new["n_chars"] = F.when(hit, F.length("_kept")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    out = [new[c].alias(c) if c in new else F.col(c) for c in columns]
    if report:
        counts = F.struct(F.coalesce("_count", F.lit(0)).cast("long").alias("lines"), F.when(hit, F.size("_lost")).otherwise(0).cast("long").alias("removed"))
        out.append(F.when(F.col("text").isNotNull(), counts).otherwise(F.struct(F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("removed"))).alias(report))
    return rows.select(*out)
