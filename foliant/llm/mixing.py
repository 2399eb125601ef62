"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
_SALTS = 64
_BROADCAST_SOURCES = 200_000


def word_count(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Words to take from each source.

    ``sizes(source, size)``: sources by code point, null last, weigh
    ``weights`` in turn and share all words; a target stops at ``most`` times
    its source's size and the excess is shared anew by weight. That fixpoint is
    ``min(most * size, level * weight)`` for one level, found with running sums
    over sources in order of ``most * size / weight``. The two global windows
    hold one row for each source, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (turn % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("most", F.col("source_size") * most)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    running = per.withColumn("before", F.sum("most").over(order) - F.col("most"))
    running = running.withColumn("left", F.sum("weight").over(whole) - F.sum("weight").over(order) + F.col("weight"))
    running = running.withColumn("level", (F.sum("source_size").over(whole) - F.col("before")) / F.col("left"))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    running = running.withColumn("fill", F.min_by(fits, F.when(fits.isNotNull(), F.col("before") - F.col("left"))).over(whole))
    return running.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("fill") * F.col("weight")).alias("target"))


def draws(seed: str, doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) fixed by the seed and the document id (null: one fixed number)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """Every row of ``docs`` with how often the mix takes it.

    Adds struct ``mix``: size (words), source_size, target, rate (target over
    source size, 0 for an empty source) and copies, which is floor(rate) plus
    one when the document's draw falls below the fraction. A column named
    ``mix`` is replaced; all others stay. A null text has size 0; null is a
    source of its own, last in order; repeated rows draw alike; an empty table
    stays empty. The targets are broadcast while they are at most 200,000
    sources, counted first; beyond it both sides are salted, so that a source
    with a third of all rows spreads over 64 keys.
    """
    rows = docs.drop("mix").withColumn("_size", word_count())
    targets = source_targets(rows.select("source", F.col("_size").alias("size")))
    targets = targets.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    if docs.select("source").distinct().count() <= _BROADCAST_SOURCES:
        both = rows.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("_source")), "left")
    else:
        salted = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        rows = rows.withColumn("_row_salt", F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SALTS)).cast("int"))
        both = rows.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_row_salt") == F.col("_salt")), "left")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    both = both.withColumn("_rate", rate)
    copies = F.floor("_rate") + F.when(draws(seed) < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)
    fields = [F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_rate").alias("rate"), copies.cast("long").alias("copies")]
    return both.withColumn("mix", F.struct(*fields)).select(*[c for c in docs.columns if c != "mix"], "mix")


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as ``mixture`` takes it, columns unchanged."""
    if "mix" in docs.columns:
        return emit(docs.withColumnRenamed("mix", "_own_mix"), **options).withColumnRenamed("_own_mix", "mix")
    mixed = mixture(docs, **options)
    return mixed.withColumn("_copy", F.explode(F.expr("array_repeat(0, cast(mix.copies as int))"))).select(*docs.columns)
