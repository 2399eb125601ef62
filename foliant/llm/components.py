"""Connected components of an undirected link table, without a driver collect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, free


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``links(a, b)`` with the smallest node it reaches.

    Each round takes the least label among neighbours, then follows the label's
    own label twice (pointer jumping), so star-like groups settle in two or
    three rounds and a chain of n nodes in about log n. Every round is cut to
    the shared folder. Aggregations combine map-side and the joins are plain
    equi-joins, which adaptive execution can split where one hub holds many
    links. Null ends and self links are ignored; an empty table gives no rows.
    """
    plain = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    plain = plain.filter("a is not null and b is not null and a <> b")
    edges = cut(plain.unionByName(plain.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    held = labels
    for _ in range(max_rounds):
        near = (
            edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        nxt = cut(met.join(roots, "label").select("node", "old", F.least("label", "up").alias("label")))
        changed = nxt.filter("label <> old").limit(1).count()
        free(held)
        labels, held = nxt.select("node", "label"), nxt
        if not changed:
            free(edges)
            return labels
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
