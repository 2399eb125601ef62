"""A training corpus in five stages: toxicity, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``docs``. What a stage does with
nulls, repeated rows and long texts is said at each. Columns besides doc_id,
text, source and n_chars pass through whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import toxicity
from foliant.llm.boilerplate import drop_boilerplate
from foliant.llm.bpe import bpe
from foliant.llm.jaccard import one_of_each
from foliant.llm.learning import fold
from foliant.llm.mixing import emit
from foliant.llm.store import cut

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; learned from two of three folds of the labels.

    Null and empty texts score by the constant alone, rows are judged each by
    its own text, whatever their ids, and whole, whatever its length.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 3) != 1)
    model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return toxicity.keep(docs, model, threshold=0.7)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that stand on ten sites or more, save their first occurrence; empty lines stay.

    Null texts stay null, repeated rows are treated alike, a null source is a
    site of its own.
    """
    return drop_boilerplate(docs, least_chars=1)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows are compared by their whole texts, whatever their ids: the smallest
    doc_id of a group stays, null ids last, and one of repeated rows. Null and
    wordless texts all stay.
    """
    return one_of_each(docs, k=5, num=4, den=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks.

    A row's copies hang on its doc_id, so repeated rows are copied alike; a null
    text has no words; null is a source of its own.
    """
    return emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the token ids and hashes of every copy; ids that do not decode to their text are an error.

    A null text has no tokens; a repeated row comes as often as it stands there.
    """
    coded = bpe(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_duplicates", one_of_each_group),
    ("mixing", mix),
    ("byte_bpe", tokens),
]

#: The trained first stage has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
