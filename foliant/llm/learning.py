"""Bounded labelled samples, folds and a small logistic fit shared by the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = 1500, total_bytes: int = 24 << 20) -> tuple[list[tuple[str, object]], dict]:
    """(text, label) of at most ``per_class`` documents of each class, and how many documents each class has.

    ``labels(doc_id, label)``; rows without an id or a label are left out, so
    are documents without a text. Documents are taken in order of a hash of
    their id, as whole texts of whatever length, until their class has spent
    its equal share of ``total_bytes``; the text that passes it is still taken.
    An id with several labels counts for each of them, one with several texts
    by its least text. Only ids pass through the driver before the texts of the
    chosen ones are read by a broadcast of those ids, which number ``per_class``
    times the classes at most.
    """
    named = labels.filter("doc_id is not null and label is not null").select("doc_id", "label").distinct()
    counts = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], {}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.coalesce(*[F.when(F.col("label") == F.lit(k), F.lit(1.2 * per_class / n)) for k, n in counts.items()])
    drawn: dict = {}
    for r in named.withColumn("draw", draw).filter(F.col("draw") < share).collect():
        drawn.setdefault(r["label"], []).append((r["draw"], r["doc_id"]))
    chosen = [(i, k, x) for k, rows in drawn.items() for x, i in sorted(set(rows))[:per_class]]
    if not chosen:
        return [], counts
    kind = dict(named.dtypes)
    ids = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind['doc_id']}, _label {kind['label']}, _draw double")
    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_label", "_draw").agg(F.min("text").alias("text"))
    before = Window.partitionBy("_label").orderBy("_draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = texts.withColumn("_spent", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).filter(F.col("_spent") < total_bytes // len(counts))
    found = sorted(((r["_label"], r["doc_id"], r["text"]) for r in taken.collect()), key=lambda x: (str(x[0]), x[1]))
    return [(text, label) for label, _, text in found], counts


def fit_line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression of y on the columns of x and a constant, by Newton steps."""
    design = np.column_stack([x, np.ones(len(y))])
    theta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge * theta
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge * np.eye(len(theta))
        step = np.linalg.solve(curve, slope)
        theta -= step
        if np.abs(step).max() < 1e-9:
            break
    return theta


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, x))))
