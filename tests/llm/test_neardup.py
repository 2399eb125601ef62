import numpy as np
from pyspark.sql import functions as F

from foliant.llm.components import components
from foliant.llm.hnsw import Index
from foliant.llm.neardup import near_duplicates


def brute(ids, vectors, least):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in np.flatnonzero(near[a]):
                low = min(label[ids[a]], label[ids[b]])
                for x in (ids[a], ids[b]):
                    if label[x] != low:
                        label[x], changed = low, True
    return near.sum(1), label


def cloud(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(400, dim))]
    for size, spread in ((300, 1e-3), (40, 0.05), (60, 0.2), (80, 0.3), (30, 0.0)):
        parts.append(rng.normal(size=(1, dim)) + spread * rng.normal(size=(size, dim)))
    return np.concatenate(parts)


def test_links_and_components_equal_brute_force(spark):
    vectors = cloud()
    ids = np.random.default_rng(1).permutation(5_000)[: len(vectors)]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    nan, inf = float("nan"), float("inf")
    odd = [(9_000, None), (9_001, []), (9_002, [0.0] * 16), (9_003, [nan] + [1.0] * 15), (9_004, [inf] + [1.0] * 15), (9_005, [None] + [1.0] * 15), (9_006, rows[0][1][:8]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd + [rows[0]], "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "n_links": F.lit(7), "node": F.lit(0), "dim": F.lit(3)})
    got = near_duplicates(df, 0.9, shards=3).collect()
    assert len(got) == len(rows) + len(odd) + 1
    links, label = brute(ids.tolist(), np.array([v for _, v in rows]), 0.9)
    want = {int(i): (int(n), label[i]) for i, n in zip(ids, links, strict=True)}
    have = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    exact = np.mean([have[i] == want[i] for i in want])
    assert exact >= 0.99 and sum(have[i][0] for i in want) >= 0.98 * links.sum()
    assert all(have[i][0] <= want[i][0] for i in want)
    assert all(have[i] == (0, i) for i, _ in odd if i is not None)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)
    assert near_duplicates(df.limit(0)).collect() == []


def test_recall_of_the_graph():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4_000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    index = Index(np.arange(len(v)), v)
    found, _ = Index.load(index.dump()).search(v[:200].astype(np.float32), 64)
    truth = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    rows = [set(index.leaders[f[f >= 0]].tolist()) for f in found]
    assert np.mean([len(set(t.tolist()) & r) / 10 for t, r in zip(truth, rows, strict=True)]) > 0.9


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (None, 1), (20, 21)] + [(100, 100 + i) for i in range(1, 50)] + [(300 + i, 301 + i) for i in range(40)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 8, 9, 21)] == [1, 1, 1, 1, 8, 8, 20] and 5 not in got
    assert {got[i] for i in range(100, 150)} == {100} and {got[i] for i in range(300, 341)} == {300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_different_vectors_of_one_id(spark):
    rng = np.random.default_rng(9)
    a, b, c = rng.normal(size=(3, 12))
    near = lambda v: (v + 0.01 * rng.normal(size=12)).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (1, near(a)), (2, near(a)), (3, near(b)), (4, near(b)), (5, c.tolist()), (200, (1e200 * c).tolist()), (6, (1e-200 * c).tolist())]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["recall"]) for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=2).collect())
    assert got == [(1, 4, 1, 1.0)] * 3 + [(2, 2, 1, 1.0), (3, 2, 1, 1.0), (4, 2, 1, 1.0), (5, 2, 5, 1.0), (6, 2, 5, 1.0), (200, 2, 5, 1.0)]


def test_links_that_leave_a_task_only_connect():
    from foliant.llm.neardup import link_shards

    rng = np.random.default_rng(2)
    v = rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(400, 16))
    one, two = Index(np.arange(0, 400, 2), v[::2]), Index(np.arange(1, 400, 2), v[1::2])
    links, hit, every = link_shards(one, two, 0.9, False)
    assert hit == every > 0 and len(links.edges) <= 399 and links.counts[0].sum() == 200 * 200
    links, hit, every = link_shards(one, one, 0.9, True)
    assert hit == every > 0 and len(links.edges) == 199 and links.counts[0].tolist() == [199] * 200


def test_the_query(spark, tmp_path):
    from foliant.llm import queries

    vectors = cloud(3)
    ids = list(range(len(vectors)))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>, label int")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = np.array([r["embedding"] for r in spark.read.parquet(f"{tmp_path}/embeddings.parquet").orderBy("vec_id").collect()])
    links, label = brute(ids, stored, 0.9)
    got = queries.QUERIES["op10_hnsw_near_duplicates"](spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(i, int(links[i]), label[i], label[i] == i) for i in ids]
