import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import queries
from foliant.llm.hilbert import hilbert_index, hilbert_shards, quantised, shard_ranges, shards_to_read, string_cuts
from foliant.llm.mixing import emit, mixture

from .helpers import clashing, documents


@pytest.mark.parametrize("dims,bits", [(2, 5), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    side = 1 << bits
    cells = spark.range(side**dims).select(*[(F.floor(F.col("id") / side**d) % side).alias(f"c{d}") for d in range(dims)])
    p = cells.select("*", hilbert_index([F.col(f"c{d}") for d in range(dims)], bits).alias("h")).toPandas().sort_values("h")
    assert p.h.tolist() == list(range(side**dims))
    assert (np.abs(np.diff(p[[f"c{d}" for d in range(dims)]].to_numpy(), axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    rows = [(i, "x" * (i % 50), ["en", "fr", None][i % 3], f"site{i % 7}" if i % 5 else None) for i in range(500)]
    rows += [(1000 + i, "same text", "en", "hot") for i in range(300)] + [(2000, None), (2001, ""), (2002, "y" * 5_000), (None, "z"), (7, "x" * 7), (7, "x" * 7)]
    got = hilbert_shards(clashing(documents(spark, rows)), 8, law=law).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {law} and got["grown_shard"].isna().all()
    texts = dict((r[0], r[1]) for r in rows)
    for r in got[got.doc_id.notna()].itertuples():
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 8 and r.text_crc32 == zlib.crc32(data)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    counts, sizes = got.groupby("shard").size(), got.groupby("shard")["size"].sum()
    assert len(counts) == 8
    if law == "rows":
        assert counts.max() - counts.min() <= 1
    else:
        assert sizes.max() - sizes.min() <= 2 * 5_008


def test_shards_of_nothing(spark):
    assert hilbert_shards(documents(spark, [])).collect() == []
    assert [r["slot"] for r in hilbert_shards(documents(spark, [(1, None, None, None)])).collect()] == [0]


def test_string_cuts_are_quantiles(spark):
    rng = np.random.default_rng(7)
    urls = [f"https://site.example/{'abc'[i % 3]}/{int(rng.zipf(1.3)) % 5_000:05}" for i in range(3_000)] + ["odd", "", "https://site.example/", "\0", "a\0", "a"] + ["hot"] * 1_500
    rng.shuffle(urls)
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)] * 50, "u string")
    cells, ordered = 16, sorted(u.encode() for u in urls)
    cuts = string_cuts(df, "u", cells)
    assert len(cuts) == cells - 1 and cuts == sorted(cuts)
    for i, c in enumerate(cuts):
        below, upto = sum(x < c for x in ordered), sum(x <= c for x in ordered)
        wanted = (i + 1) / cells * len(ordered)
        slack = max(0.02 * len(ordered), max(sum(x.startswith(y) for x in ordered) for y in [c]) if c not in ordered else 0)
        assert below - slack <= wanted <= upto + slack, (i, c)
    assert string_cuts(df.filter("u is null"), "u", 4) == [] and string_cuts(df.filter("u = 'hot'"), "u", 4) == [b"hot"] * 3


def test_dimensions_of_all_kinds(spark):
    df = spark.range(64).selectExpr("id", "date_add(date'2020-01-01', cast(id as int)) as d", "timestamp_seconds(id) as t", "cast(id as decimal(9,2)) as m", "id % 2 = 0 as b", "cast(cast(id as string) as binary) as x", "cast(null as string) as n")
    rows = df.select("id", *[c.alias(f"c{i}") for i, c in enumerate(quantised(df, ("d", "t", "m", "b", "x", "n"), 2))]).orderBy("id").collect()
    for c in ("c0", "c1", "c2"):
        got = [r[c] for r in rows]
        assert got == sorted(got) and sorted(map(got.count, set(got))) in ([16] * 4, [15, 16, 16, 17])
    assert {r["c5"] for r in rows} == {0} and {r["c3"] for r in rows} <= {0, 1, 2, 3} and len({r["c4"] for r in rows}) == 4


def test_a_box_reads_few_shards(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(1, 2_000)), "en", f"site{int(rng.integers(0, 50)):02}") for i in range(6_000)]
    docs = documents(spark, rows)
    dims = ("source", "n_chars")
    placed = hilbert_shards(docs, 24, dims=dims, keep=dims)
    ranges = shard_ranges(placed, dims).cache()
    read = {r["shard"] for r in shards_to_read(ranges, source=("site10", "site14"), n_chars=(400, 600)).collect()}
    inside = {r["shard"] for r in placed.filter("source between 'site10' and 'site14' and n_chars between 400 and 600").select("shard").distinct().collect()}
    assert inside <= read and len(read) <= 6
    scattered = shard_ranges(docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(24))), dims)
    assert shards_to_read(scattered, source=("site10", "site14"), n_chars=(400, 600)).count() == 24


def curve(point, bits):
    """Plain transform of a cell to its place on the curve."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def test_the_shard_query_equals_a_plain_run(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = [(i, "x" * int(rng.integers(0, 300)), str(rng.choice(["en", "fr", "de"])), f"s{int(rng.integers(0, 9))}") for i in range(700)] + [(1_000, None, None, None), (1_001, "é", "en", "s0")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    dims, cells = ("source", "lang", "n_chars"), 16
    cuts = [[c.decode() for c in string_cuts(docs, d, cells)] for d in dims[:2]] + [docs.agg(F.percentile_approx("n_chars", [(i + 1) / cells for i in range(cells - 1)], 10_000)).first()[0]]
    part = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1024)).alias("p")).collect()}
    order = []
    for i, text, lang, source in rows:
        value = (source, lang, None if text is None else len(text))
        cell = [0 if v is None else sum(v > c for c in own) for v, own in zip(value, cuts, strict=True)]
        order.append((curve(cell, 4), part[i], i))
    want, n = {}, len(rows)
    for place, (h, _, i) in enumerate(sorted(order)):
        shard = place * 24 // n
        want[i] = (shard, place - -(-shard * n // 24), h)
    got = queries.QUERIES["op1_hilbert_shards"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"], r["hilbert"]) for r in got} == want
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]])) for r in got)


def fill(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, set(names)
    while left:
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > most * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(most * sizes[s]) for s in over}
        left -= over
    return target


def test_mixture(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", str(rng.choice(["a", "b", "ä", "z", "Z"], p=[0.4, 0.3, 0.1, 0.1, 0.1]))) for i in range(4_000)]
    rows += [(9_000, "a b c", "en", None), (9_001, None, "en", "b"), (9_002, "", "en", "empty"), (None, "q r", "en", "a"), (3, rows[3][1], "en", rows[3][3])]
    got = mixture(clashing(documents(spark, rows))).select("doc_id", "source", "mix.*").toPandas()
    sizes = {s: sum(len((t or "").split()) for _, t, _, x in rows if x == s) for s in {r[3] for r in rows}}
    want = fill(sizes)
    assert len(got) == len(rows)
    for r in got.itertuples():
        source = None if r.source is None or r.source != r.source else r.source
        assert r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6
        assert 0 <= r.copies <= 3 and r.copies in (int(r.rate), int(r.rate) + 1)
    for s, part in got[got.source_size > 10_000].groupby("source"):
        # independent draws: five standard deviations of their sum
        share = part.rate % 1
        assert abs((part.copies * part["size"]).sum() - want[s]) <= 1e-6 + 5 * np.sqrt((part["size"] ** 2 * share * (1 - share)).sum())
    again = mixture(documents(spark, rows[::-1])).select("doc_id", "mix.copies").toPandas()
    assert sorted(map(tuple, again.fillna(-1).to_numpy())) == sorted(map(tuple, got[["doc_id", "copies"]].fillna(-1).to_numpy()))
    assert emit(documents(spark, rows)).count() == got.copies.sum()
    assert mixture(documents(spark, [])).collect() == []


def test_salted_join_gives_the_same(spark, monkeypatch):
    import foliant.llm.mixing as m

    docs = documents(spark, [(i, "a b " * (i % 5), "en", f"s{i % 4}" if i % 9 else None) for i in range(200)])
    plain = sorted(mixture(docs).select("doc_id", "mix").collect())
    monkeypatch.setattr(m, "_BROADCAST_SOURCES", 0)
    assert sorted(mixture(docs).select("doc_id", "mix").collect()) == plain
