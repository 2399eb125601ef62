"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import labelled_sample, sigmoid
from .store import bounded_batches, frugal

BUCKETS = 1 << 18
_WORD = re.compile(r"[^\W_]+")
_CACHED_WORDS = 150_000
_CACHED_CHARS = 64
_WINDOW = 1 << 18


def grams(words: list[str], low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every character n-gram of the words, their edges marked."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    marks = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word_of = np.repeat(np.arange(len(words)), sizes)
    owners, buckets = [], []
    for n in range(low, high + 1):
        m = len(marks) - n + 1
        if m <= 0:
            break
        inside = word_of[:m] == word_of[n - 1 :]
        owners.append(word_of[:m][inside])
        buckets.append(_buckets(marks, n)[inside])
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


def _buckets(marks: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at every place."""
    m = max(0, len(marks) - n + 1)
    value = np.full(m, n, np.uint64)
    for j in range(n):
        value = (value ^ marks[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return (value & np.uint64(BUCKETS - 1)).astype(np.int64)


def _long_word(word: str, weights: np.ndarray, low: int = 3, high: int = 5) -> float:
    """The weight of a word of whatever length, window by window."""
    marked, total = f"^{word}$", 0.0
    for n in range(low, high + 1):
        for at in range(0, len(marked) - n + 1, _WINDOW):
            part = marked[at : at + _WINDOW + n - 1]
            total += float(weights[_buckets(np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), n)].sum(dtype=np.float64))
    return total


def words(text: str) -> set[str]:
    """The distinct runs of letters and digits, lower case, whole."""
    return set(_WORD.findall(text.lower()))


@dataclass
class Model:
    """Weights by bucket (ratio times learned weight) and the constant."""

    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self._known: dict[str, float] = {}

    def scores(self, texts: list[str]) -> list[float]:
        """Scores of whole texts; each distinct word is weighed once for the batch and, up to 64 characters, remembered."""
        own, known = [words(t) for t in texts], self._known
        if len(known) >= _CACHED_WORDS:
            known.clear()
        fresh = list(set().union(*own).difference(known)) if own else []
        short = [w for w in fresh if len(w) <= _CACHED_CHARS]
        for at in range(0, len(short), 20_000):
            some = short[at : at + 20_000]
            owner, bucket = grams(some)
            known.update(zip(some, np.bincount(owner, weights=self.weights[bucket], minlength=len(some)).tolist(), strict=True))
        long = {w: _long_word(w, self.weights) for w in fresh if len(w) > _CACHED_CHARS}
        weight = lambda w: known[w] if w in known else long[w]
        return [float(sigmoid(self.bias + math.fsum(map(weight, w)))) for w in own]


def train(rows: list[tuple[str, int]], counts: dict, smoothing: float = 1.0, ridge: float = 1e-3, steps: int = 120) -> Model:
    """Fit on labelled texts. A document's feature is how often its distinct words hold an n-gram.

    Ratios: log of the smoothed share of positive over negative documents with
    the n-gram. The constant is moved to the class shares of ``counts``. With
    one class only, or none, the score is the smoothed share of positives.
    """
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    y = np.array([label for _, label in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), prior)
    ids: dict[str, int] = {}
    doc_words = [[ids.setdefault(w, len(ids)) for w in sorted(words(text))] for text, _ in rows]
    word_of, gram_in = grams(list(ids))
    doc_of = np.repeat(np.arange(len(rows)), [len(x) for x in doc_words])
    word_in = np.fromiter((w for x in doc_words for w in x), np.int64)
    first = np.searchsorted(np.sort(word_of), np.arange(len(ids) + 1))
    by_gram = gram_in[np.argsort(word_of, kind="stable")]
    seen = np.zeros((2, BUCKETS))
    for words_of_doc, label in zip(doc_words, y, strict=True):
        if words_of_doc:
            seen[int(label)][np.unique(np.concatenate([by_gram[first[w] : first[w + 1]] for w in words_of_doc]))] += 1
    ratio = np.log((seen[1] + smoothing) / (y.sum() + 2 * smoothing)) - np.log((seen[0] + smoothing) / (len(y) - y.sum() + 2 * smoothing))

    def forward(v: np.ndarray) -> np.ndarray:
        by_word = np.bincount(word_of, weights=(v * ratio)[gram_in], minlength=len(ids))
        return np.bincount(doc_of, weights=by_word[word_in], minlength=len(rows))

    def backward(g: np.ndarray) -> np.ndarray:
        by_word = np.bincount(word_in, weights=g[doc_of], minlength=len(ids))
        return np.bincount(gram_in, weights=by_word[word_of], minlength=BUCKETS) * ratio

    v, bias = np.zeros(BUCKETS), 0.0
    m, s, mb, sb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(forward(v) + bias, -30, 30)))
        g = backward((p - y) / len(y)) + ridge * v
        gb = float((p - y).mean())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        v -= 0.02 * (m / c1) / (np.sqrt(s / c2) + 1e-8)
        bias -= 0.02 * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    bias += prior - float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    return Model((v * ratio).astype(np.float32), bias)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every whole text; null counts as empty, which scores by the constant alone.

    Reads doc_id and text; other columns are ignored. Words count whole,
    whatever their length; rows with equal texts score alike; an empty table
    stays empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores([t or "" for t in batch.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """Train on at most ``per_class`` documents of each class of ``labels(doc_id, label)``, see ``labelled_sample``."""
    return train(*labelled_sample(docs, labels, per_class))


def keep(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, all columns unchanged.

    Batches are filtered as they stream through the worker, so no join by id is
    needed and repeated or missing ids do no harm. A null text scores as an
    empty one; an empty table stays empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent, at = spark.sparkContext.broadcast((model.weights, model.bias)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            scores = own.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
