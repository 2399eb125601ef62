"""Embedding near-duplicates: a small-world graph for each shard, every shard queried, cosines verified, components joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hnsw import Index
from .store import bounded_batches, cut, free, frugal

_AUDITED = 100
_RECALL = 0.98
_SLACK = 1e-4
_CHUNKS = 16
_MOST_PARTITIONS = 8192


def _build(table: pa.Table) -> pa.Table:
    ids = np.asarray(table.column("vec_id"))
    raw = np.asarray(table.column("embedding").combine_chunks().flatten()).reshape(len(ids), -1)
    keys = (ids, ids * np.int64(0x9E3779B97F4A7C15 - (1 << 64)))
    if len(np.unique(ids)) < len(ids):
        keys = (*raw.T, *keys)
    order = np.lexsort(keys)
    index = Index(ids[order], raw[order])
    row = {"graph": index.dump(), "queries": index.dump(graph=False)}
    return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1]} | {k: pa.array([v], pa.large_binary()).cast(pa.binary()) for k, v in row.items()})


class _Links:
    """Counts by row on both sides, and links that span what was found: as many as connect it, no more."""

    def __init__(self, left: Index, right: Index, least: float, same: bool):
        self.left, self.right, self.least = left, right, least
        self.counts = [np.zeros(len(left.ids), np.int64), np.zeros(len(right.ids), np.int64)]
        self._add = [np.zeros(len(left.leaders), np.int64), np.zeros(len(right.leaders), np.int64)]
        self.edges: list[tuple[int, int]] = []
        self.shift = 0 if same else len(left.ids)
        n = self.shift + len(right.ids)
        self._up, self._seen = list(range(n)), np.arange(n)
        # rows whose id stands on both sides in different rows: they are no partners of each other
        if same:
            once, n_of = np.unique(left.ids, return_counts=True)
            again = once[n_of > 1]
        else:
            again = np.intersect1d(left.ids, right.ids)
        self._again = [np.isin(x.ids, again) if len(again) else None for x in (left, right)]

    def _root(self, x: int) -> int:
        up = self._up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, row: int, others: np.ndarray) -> None:
        """Link a row of the left side with rows of the right one."""
        at = others + self.shift
        _, first = np.unique(self._seen[at], return_index=True)
        for i in first.tolist():
            a, b = self._root(row), self._root(int(at[i]))
            if a != b:
                self._up[b] = a
                self.edges.append((int(self.left.ids[row]), int(self.right.ids[others[i]])))
        self._seen[at] = self._seen[row] = self._root(row)

    def groups(self, a: int, near: np.ndarray) -> None:
        """Link a group with others: by their radii where those decide for all members, else by every cosine."""
        lead, leads = self.left.leaders[a], self.right.leaders[near]
        cos = self.right.vectors[leads] @ self.left.vectors[lead]
        angle, limit = np.arccos(np.clip(cos, -1, 1)), np.arccos(self.least)
        reach = self.left.radius[a] + self.right.radius[near]
        sizes, own = np.diff(self.right.start)[near], self.left.members(a)
        plain = np.ones(len(near), bool)
        if self._again[0] is not None and self._again[0][own].any():
            plain = np.array([not self._again[1][self.right.members(b)].any() for b in near.tolist()], bool)
        alone = plain & (sizes == 1) & (len(own) == 1)
        sure = np.where(alone, cos >= self.least, plain & (angle + reach < limit - 1e-6))
        if sure.any():
            self._add[0][a] += sizes[sure].sum()
            self._add[1][near[sure]] += len(own)
            self.join(int(lead), leads[sure])
        for b in near[~alone & ~sure & (angle - reach <= limit + 1e-6)].tolist():
            self.matrix(own, self.right.members(b))

    def matrix(self, x: np.ndarray, y: np.ndarray, half: bool = False) -> None:
        """Every cosine of two sets of rows; with ``half`` they are the same rows."""
        for i in range(0, len(x), 1024):
            for j in range(0, len(y), 1024):
                p, q = x[i : i + 1024], y[j : j + 1024]
                near = self.left.vectors[p] @ self.right.vectors[q].T >= self.least
                near &= self.left.ids[p][:, None] != self.right.ids[q]
                self.counts[0][p] += near.sum(axis=1)
                if not half:
                    self.counts[1][q] += near.sum(axis=0)
                for r in np.flatnonzero(near.any(axis=1)).tolist():
                    self.join(int(p[r]), q[near[r]])

    def inside(self, g: int) -> None:
        """The links within a group of the one shard."""
        mine = self.left.members(g)
        if np.cos(2 * self.left.radius[g]) >= self.least + 1e-9 and (self._again[0] is None or not self._again[0][mine].any()):
            self.counts[0][mine] += len(mine) - 1
            self.join(int(self.left.leaders[g]), mine)
        elif len(mine) > 1:
            self.matrix(mine, mine, half=True)

    def done(self) -> None:
        for side, index in ((0, self.left), (1, self.right)):
            self.counts[side] += self._add[side][index.group]


def _audit(left: Index, right: Index, least: float, same: bool, found: list[np.ndarray], rows: np.ndarray) -> tuple[int, int]:
    """How many of the partners of some rows stand in the groups found for them, and how many partners there are."""
    hit = every = 0
    for at in range(0, len(rows), 64):
        some = rows[at : at + 64]
        near = left.vectors[some] @ right.vectors.T >= least
        near &= left.ids[some][:, None] != right.ids
        for i, row in enumerate(near):
            true = right.group[np.flatnonzero(row)]
            every += len(true)
            hit += int(np.isin(true, found[at + i]).sum())
    return hit, every


def link_shards(left: Index, right: Index, least: float, same: bool, ef: int = 48) -> tuple[_Links, int, int]:
    """Query every group of ``left`` in ``right``; beams widen until the audited queries reach the wanted recall.

    Audited are the vectors with ids divisible by 100 (one at least), whose
    partners by brute force among all vectors of the other shard must be found.
    Also gives how many of those were, and how many there are.
    """
    links = _Links(left, right, least, same)
    if not len(left.leaders) or not len(right.leaders):
        return links, 0, 0
    margin = float(left.radius.max() + right.radius.max())
    floor = float(np.cos(min(np.pi, np.arccos(least) + margin))) - _SLACK
    rows = np.flatnonzero(left.ids % _AUDITED == 0)
    rows = rows if len(rows) else np.zeros(1, np.int64)
    asked, back = np.unique(left.group[rows], return_inverse=True)
    while True:
        tried = right.within(left.flat[asked], floor, ef)
        hit, every = _audit(left, right, least, same, [tried[i] for i in back], rows)
        if hit >= _RECALL * every or ef >= len(right.leaders):
            break
        ef *= 2
    for a, near in enumerate(right.within(left.flat, floor, ef)):
        if same:
            near = near[near > a]
        if len(near):
            links.groups(a, near)
    links.done()
    if same:
        links.counts[0] += links.counts[1]
        for g in range(len(left.leaders)):
            links.inside(g)
    return links, hit, every


def _search(least: float):
    """From rows (dim, shard, from, blob) sorted so that a shard's graph (null from) stands before the queries that it gets.

    Lets out links (a, b, null), counts (a, null, n) and audits (null, hits, partners).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = graph = None
        for batch in batches:
            for i in range(batch.num_rows):
                dim, shard, asks, blob = (batch.column(c)[i].as_py() for c in range(4))
                if asks is None:
                    right, graph = Index.load(blob), (dim, shard)
                    continue
                if graph != (dim, shard):
                    continue  # no vector of this length fell into that shard
                same = asks == shard
                left = right if same else Index.load(blob)
                links, hit, every = link_shards(left, right, least, same)
                for side, own in ((0, left), (1, right))[: 1 if same else 2]:
                    some = np.flatnonzero(links.counts[side])
                    yield _rows(own.ids[some], None, links.counts[side][some])
                edges = np.array(links.edges, np.int64).reshape(-1, 2)
                yield _rows(edges[:, 0], edges[:, 1], None)
                yield _rows(None, np.array([hit]), np.array([every]))

    return run


def _rows(*columns: np.ndarray | None) -> pa.RecordBatch:
    n = next(len(c) for c in columns if c is not None)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])


def near_duplicates(vectors: DataFrame, least: float = 0.9, shards: int = 8, shard_bytes: int = 32 << 20) -> DataFrame:
    """Components of vectors with cosine >= ``least``.

    Reads vec_id and embedding; other columns (labels among them) are ignored.
    Returns one row for each row: vec_id, n_links (other vectors linked
    directly), component_id (smallest vec_id reachable), kept (vec_id is
    component_id), recall (of the audits: the share of the partners, by brute
    force, of all vectors with ids divisible by 100 that the graphs found).
    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; neither do vectors of different lengths. Rows that
    repeat a vec_id with the same vector are one vector. Different vectors of
    one vec_id share its component and their links add up; they are no partners
    of each other. A row without vec_id has no links and a null component. An
    empty table gives an empty result.

    Vectors go to shards by a hash, at least ``shards`` and so many that a shard
    holds about ``shard_bytes`` of them; each builds one graph. Every unordered
    pair of shards is searched once, and what it finds counts for both sides:
    one of the two sends its vectors, in up to 16 tasks for each graph, so the
    vectors sent grow with their number times the number of shards, as the
    method asks every shard. A task lets out no more links than connect what it
    found. Cosines are verified in double precision.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = base.filter("vec_id is not null and embedding is not null").filter(finite & F.exists("embedding", lambda x: x != 0))
    sound = sound.dropDuplicates(["vec_id", "embedding"]).withColumn("dim", F.size("embedding"))
    size = sound.agg(F.sum("dim")).first()[0] or 0
    n = max(shards, -(-4 * size // shard_bytes))
    dealt = sound.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int"))
    graphs = cut(dealt.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, graph binary, queries binary"))
    chunks = min(_CHUNKS, n // 2 + 1)
    asks = graphs.select("dim", F.col("shard").alias("from"), "queries", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"))
    asks = asks.filter("shard = from or (shard < from) = ((shard + from) % 2 = 0)")
    asks = asks.select("dim", "shard", (F.col("from") % chunks).alias("chunk"), "from", F.when(F.col("from") != F.col("shard"), F.col("queries")).alias("blob"))
    heads = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(None).cast("int").alias("from"), F.col("graph").alias("blob"))
    sent = heads.unionByName(asks).repartition(min(_MOST_PARTITIONS, 2 * n * chunks), "dim", "shard", "chunk")
    sent = sent.sortWithinPartitions("dim", "shard", "chunk", F.col("from").asc_nulls_first()).select("dim", "shard", "from", "blob")
    found = cut(sent.mapInArrow(frugal(_search(least)), "a long, b long, n long"))
    free(graphs)
    audit = found.filter("a is null").agg(F.sum("b").alias("hit"), F.sum("n").alias("every")).first()
    recall = audit["hit"] / audit["every"] if audit["every"] else 1.0
    counts = found.filter("n is not null and a is not null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    labels = components(found.filter("a is not null and b is not null").select("a", "b"))
    rows = base.select("vec_id").join(counts, "vec_id", "left").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("label", "vec_id")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"), F.lit(float(recall)).alias("recall"),
    )
