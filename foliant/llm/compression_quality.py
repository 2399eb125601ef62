"""Quality by compression: how much better a text packs with a dictionary of good text than with one of bad text.

A text is packed in blocks of 256 bytes, so that the dictionaries count for
every part of it, not only until the packer has seen enough of the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import fit_line, labelled_sample, sigmoid
from .store import bounded_batches, frugal

DICTIONARY_BYTES = 112_640
BLOCK = 256
_LEVEL = 3


@dataclass
class Model:
    """Two dictionaries, and the line from a text's features to the log odds of label 1."""

    good: bytes
    bad: bytes
    line: tuple[float, float, float]

    def __post_init__(self):
        self._packers = [
            zstandard.ZstdCompressor(level=_LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            if d
            else zstandard.ZstdCompressor(level=_LEVEL)
            for d in (self.good, self.bad)
        ]

    def difference(self, text: str) -> float:
        """(bad - good) / raw of the sizes, packed block by block; positive where the good dictionary packs better."""
        data = text.encode()
        if not data:
            return 0.0
        good, bad = (p.compress for p in self._packers)
        gained = 0
        for i in range(0, len(data), BLOCK):
            block = data[i : i + BLOCK]
            gained += len(bad(block)) - len(good(block))
        return gained / len(data)

    def features(self, text: str) -> tuple[float, float]:
        """The difference, and how little text it rests on (from 1, empty, to 0)."""
        return self.difference(text), 64 / (64 + len(text))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        return sigmoid(self.line[0] * a + self.line[1] * b + self.line[2])


def dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of these texts; where they are too few to train one, their bytes themselves."""
    samples = [t.encode() for t in texts if t]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:]


def train(rows: list[tuple[str, int]], counts: dict) -> Model:
    """Two thirds of the labelled texts build the dictionaries, the rest calibrates; odds follow ``counts``."""
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    by = {k: [t for t, label in rows if label == k] for k in (1, 0)}
    model = Model(dictionary([t for i, t in enumerate(by[1]) if i % 3]), dictionary([t for i, t in enumerate(by[0]) if i % 3]), (0.0, 0.0, prior))
    held = [(t, k) for k in (1, 0) for i, t in enumerate(by[k]) if i % 3 == 0]
    y = np.array([k for _, k in held], dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        x = np.array([model.features(t) for t, _ in held])
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
        a, b, constant = fit_line(x, y, weight).tolist()
        model.line = (a, b, constant + prior)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """Train on at most ``per_class`` documents of each class of ``labels(doc_id, label)``, see ``labelled_sample``."""
    return train(*labelled_sample(docs, labels, per_class))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every whole text; a null or empty text has no difference and scores by the constant.

    Reads doc_id and text; other columns are ignored. Rows with equal texts
    score alike; an empty table stays empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.good, model.bad, model.line))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(own.score(t or "")) for t in batch.column(1).to_pylist()])], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
