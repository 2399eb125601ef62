import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import jaccard, queries
from foliant.llm.jaccard import WIDE_BITS, Bands, _shared, block_keys, jaccard_components, largest_difference, one_of_each
from foliant.llm.shingling import overlap, shingle_sets

from .helpers import clashing, documents


def shingles(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= k:
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def brute(rows, k, num, den):
    """(doc_id, size, component) of every row; rows of one id are one document."""
    sets = [shingles(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2):
        both = len(a & b)
        if (both and den * both >= num * (len(a) + len(b) - both)) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
            up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def found(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in frame.collect()), key=str)


def corpus(seed, groups=12, copies=7):
    rng, rows = random.Random(seed), []
    passage = " ".join(f"common{i}" for i in range(60))
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 20, 60, 150, 400]))]
        for _ in range(copies):
            own = [w if rng.random() > rng.choice([0, 0.01, 0.02, 0.04]) else f"e{rng.randrange(10**6)}" for w in words]
            text = " ".join(own)
            rows.append((len(rows), text if rng.random() < 0.5 else passage + "\n" + text.upper()))
    rows += [(len(rows) + i, passage + " " + " ".join(f"u{i}_{j}" for j in range(14))) for i in range(30)]
    return rows


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5)])
def test_components_equal_brute_force(spark, k, num, den):
    rows = corpus(k) + [(5000, None), (5001, ""), (5002, " \t\n "), (5003, "One two"), (5004, "one  TWO"), (5005, "one"), (5006, "x " * 30_000)]
    assert found(jaccard_components(clashing(documents(spark, rows)), k, num, den)) == brute(rows, k, num, den)


def test_the_query_equals_brute_force(spark, tmp_path):
    rows = corpus(9, groups=10) + [(7000, None), (7001, "short")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(queries.QUERIES["op4_ngram_jaccard"](spark, str(tmp_path))) == brute(rows, 4, 85, 100)


def test_templates_that_are_just_apart(spark):
    """Groups around a shared template whose members lie on both sides of the threshold, so that first classes and forests fail."""
    rng, rows = random.Random(5), []
    for g in range(3):
        base = [f"t{g}_{i}" for i in range(300)]
        for _ in range(40):
            own = base[:]
            for at in rng.sample(range(0, 300, 6), rng.choice([4, 6, 7, 8])):
                own[at] = f"v{rng.randrange(10**7)}"
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    want = brute(rows, 4, 85, 100)
    assert 6 < len({c for _, _, c in want}) < 115
    assert found(jaccard_components(documents(spark, rows), 4, 85, 100)) == want


def test_small_bounds_give_the_same(spark, monkeypatch):
    for bound in ("_BLOCK", "_PARTNERS"):
        monkeypatch.setattr(jaccard, bound, 3)
    rows = corpus(11, groups=6, copies=12)
    got = found(jaccard_components(documents(spark, rows), 4, 85, 100))
    assert got == brute(rows, 4, 85, 100)


def test_shared_keys_whatever_the_batches():
    rng = np.random.default_rng(4)
    rows = sorted((int(rng.integers(0, 60)), int(rng.choice([0, 0, 0, 2])), int(rng.integers(0, 40)), 8 + int(rng.random() < 0.02)) for _ in range(600))
    groups = {}
    for key, salt, one, mark in rows:
        groups.setdefault((key, salt), {}).setdefault(one, []).append(mark & 1)
    want = {}
    for (key, salt), ones in groups.items():
        hot = salt > 0 or any(map(any, ones.values()))
        if hot or len(ones) > 1:
            want.update({(key, salt, one): 1 << 16 if hot else len(ones) for one in ones})
    for step in (1, 2, 7, 600):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + step]], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["key", "salt", "one", "mark"]) for at in range(0, 600, step)]
        out = [r for b in _shared(iter(batches)) for r in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True)]
        assert sorted(set(out)) == sorted({(key, one, n) for (key, _, one), n in want.items()}), step


def test_crowded_keys_lose_no_pair():
    """Whatever rows get a salt, a key that several sets have comes out with all of them."""
    texts = pa.array([" ".join(f"w{i % 7}_{j}" if j else f"o{i}" for j in range(40)) for i in range(400)])
    plain = pa.concat_batches(list(jaccard._keys(2, 4, 5)(iter([pa.record_batch({"text": texts})]))))
    before, jaccard._CROWDED = jaccard._CROWDED, 4
    try:
        salted = pa.concat_batches([b for at in range(0, 400, 20) for b in jaccard._keys(2, 4, 5)(iter([pa.record_batch({"text": texts[at : at + 20]}), pa.record_batch({"text": texts[at : at + 20]})]))])
        many = list(jaccard._keys(2, 4, 5)(iter([pa.record_batch({"text": texts[at : at + 20]}) for at in range(0, 400, 20)])))
    finally:
        jaccard._CROWDED = before

    def shared(batch):
        ordered = batch.sort_by([(c, "ascending") for c in ("key", "salt", "one")])
        return {(k, o) for b in _shared(iter([ordered])) for k, o in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}

    assert max(b.column("salt").to_numpy().max() for b in many) > 0
    for other in (salted, pa.concat_batches(many)):
        assert shared(plain) <= shared(other)


def test_repeats_nulls_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (None, "q r s t")]
    assert found(jaccard_components(documents(spark, rows), 4)) == brute(rows, 4, 4, 5)
    assert jaccard_components(documents(spark, []), 4).collect() == []


def test_any_text_of_an_id_links(spark):
    a, b, c = (" ".join(f"{w}{n}" for n in range(60)) for w in "abc")
    rows = [(1, a + " x"), (1, b + " x"), (2, a + " y"), (3, b + " y"), (4, c), (4, None), (5, None), (6, c + " z"), (7, "a"), (7, "")]
    got = found(jaccard_components(documents(spark, rows), 4, 85, 100))
    assert got == brute(rows, 4, 85, 100) and (3, 58, 1) in got and (4, 0, 4) in got and (6, 58, 4) in got


def test_a_linked_pair_shares_a_key_that_neither_leaves_out():
    rng = np.random.default_rng(3)
    for n in (7, 12, 13, 40, 200, 900):
        for _ in range(60):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64))
            drop = rng.integers(0, max(1, n // 12) + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, rng.integers(0, max(1, n // 12) + 1), dtype=np.int64).view(np.uint64)]))
            both = overlap(a, b)
            if 100 * both < 85 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            assert len(a) + len(b) - 2 * both <= largest_difference(len(a) + len(b), 85, 100)
            bands, kept = Bands(85, 100), []
            for s in (a, b):
                own = set()
                for level in bands.levels(len(s)):
                    keys, bare, out = block_keys(s, *level)
                    # any order of keys will do that is the same for all sets
                    order = sorted(zip(bare.tolist(), (keys * np.uint64(0x9E3779B97F4A7C15)).tolist(), keys.tolist(), strict=True))
                    own |= {key for _, _, key in order[: len(order) - out]}
                kept.append(own)
            assert kept[0] & kept[1], (len(a), len(b))


def test_long_and_periodic_words():
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    giant = "g" * 3_000_000
    text = " ".join(f"w{i}" for i in range(200_000)) + " " + giant + " end"
    (_, x), (_, y), (_, z) = shingle_sets(pa.array([thue, other, text]), 1)
    assert x[0] != y[0] and len(z) == 200_002
    (_, alone), (_, pair) = shingle_sets(pa.array([giant.upper(), f"é {giant}"]), 1)
    assert alone[0] in z and alone[0] in pair
    assert WIDE_BITS == 4096


def test_one_of_each(spark):
    long = lambda w, n=60: " ".join(f"{w}{i}" for i in range(n))
    rows = [
        (5, long("a") + " x", "en", "s"), (3, long("a") + " y", "en", "s"), (9, long("a"), "en", "s"), (None, long("a"), "en", "s"),
        (7, long("b"), "en", "t"), (7, long("b"), "en", "r"), (7, long("c"), "en", "s"), (None, long("d"), "en", "s"), (None, long("d"), "en", "s"),
        (8, None), (8, None), (11, ""), (12, " "), (13, "One two"), (14, "one two"),
    ]
    docs = clashing(documents(spark, rows))
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "")[-3:], r["source"]) for r in got.collect()), key=str) == sorted(
        [(3, "9 y", "s"), (7, "b59", "r"), (7, "c59", "s"), (None, "d59", "s"), (8, "", "s"), (8, "", "s"), (11, "", "s"), (12, " ", "s"), (13, "two", "s")], key=str
    )
    assert one_of_each(documents(spark, [])).collect() == []
