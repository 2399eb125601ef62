"""Texts of several megabytes, with ordinary words and with none, through every operator that works in Python."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from foliant.llm import compression_quality, langid, toxicity
from foliant.llm.boilerplate import drop_boilerplate
from foliant.llm.bpe import bpe
from foliant.llm.jaccard import jaccard_components
from foliant.llm.mpeg import read_mpeg, to_mpeg

from .helpers import documents


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    words = " ".join(f"word{i % 9973} and{i % 31}" for i in range(500_000))
    rows = [(1, words), (2, words + " more"), (3, "x" * 6_000_000), (4, "short text"), (5, "\n" * 1_000_000)]
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    documents(spark, rows).write.parquet(path)
    return spark.read.parquet(path), {i: len(t) for i, t in rows}


def test_long_texts(spark, docs):
    df, sizes = docs
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(df, 4).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    read = {r["doc_id"]: r["n"] for r in read_mpeg(to_mpeg(df)).select("doc_id", F.length("payload").alias("n")).collect()}
    assert read == {i: -(-n // 64) * 64 for i, n in sizes.items()}
    coded = {r["doc_id"]: r["n"] for r in bpe(df.filter("doc_id <> 2"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).select("doc_id", F.length("decoded").alias("n")).collect()}
    assert coded == {i: n for i, n in sizes.items() if i != 2}
    model = toxicity.train([("good words", 0), ("bad idiot", 1)], {0: 1, 1: 1}, steps=3)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(df, model).collect())
    model = compression_quality.train([("good words " * 9, 1), ("bad " * 9, 0)] * 9, {0: 9, 1: 9})
    assert all(0 <= r["score"] <= 1 for r in compression_quality.score(df, model).collect())
    model = langid.train([("word and short text", "en"), ("mot et texte court", "fr")] * 5)
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()}[5] == "und"
    assert drop_boilerplate(df).agg(F.sum(F.length("text"))).first()[0] == sum(sizes.values())
