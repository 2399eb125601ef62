import math
import random
import re
import zlib

import numpy as np
import pytest

import zstandard

from foliant.llm import compression_quality, langid, queries, toxicity
from foliant.llm.learning import fold, labelled_sample

from .helpers import clashing, documents

BAD = ("scum", "worthless", "idiot")


def prose(rng, n=60):
    return " ".join("".join(rng.choice(["an", "the", "er", "ti", "on", "st", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, tox, good = random.Random(4), [], {}, {}
    for i in range(600):
        text = prose(rng)
        tox[i] = int(i % 4 == 0)
        good[i] = int(i % 3 != 0)
        if tox[i]:
            words = text.split()
            words[rng.randrange(len(words))] = rng.choice(BAD)
            words[rng.randrange(len(words))] = rng.choice(BAD)
            text = " ".join(words)
        if not good[i]:
            text = text.replace(" ", "### ") if i % 2 else "Buy Buy Buy Buy " * 20
        docs.append((i, text))
    df = documents(spark, docs)
    to = lambda d: spark.createDataFrame(list(d.items()), "doc_id long, label int")
    return df, docs, tox, good, to


def test_fold_is_crc32(spark):
    df = documents(spark, [(i, "") for i in range(50)] + [(None, "")])
    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", fold("doc_id", 5).alias("f")).collect()}
    assert got.pop(None) == -1 and got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def test_sample_is_bounded_and_ignores_rows_without_label(spark, labelled):
    df, _, tox, _, to = labelled
    rows, counts = labelled_sample(df, to(tox | {9_999: None}), per_class=40)
    assert counts == {0: 450, 1: 150} and 30 <= sum(k == 1 for _, k in rows) <= 40 and sum(k == 0 for _, k in rows) <= 40
    assert labelled_sample(df, to({}) if tox is None else spark.createDataFrame([], "doc_id long, label int")) == ([], {})


def accuracy(scored, truth):
    got = {r["doc_id"]: r for r in scored.collect()}
    return np.mean([got[i]["predicted"] == k for i, k in truth.items()])


def test_toxicity(spark, labelled):
    df, docs, tox, good, to = labelled
    clean = {i: k for i, k in tox.items() if good[i]}
    model = toxicity.fit(df, to({i: k for i, k in clean.items() if i % 5}), 200)
    held = {i: k for i, k in clean.items() if i % 5 == 0}
    assert accuracy(toxicity.score(clashing(df), model), held) > 0.95
    odd = documents(spark, [(1, None), (2, ""), (None, "fine"), (3, "an " * 50_000), (4, "q" * 200_000), (4, "q" * 200_000)])
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows) and rows[0]["score"] == rows[1]["score"]
    kept = toxicity.keep(clashing(df), model)
    assert kept.columns == clashing(df).columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in toxicity.score(df, model).collect() if r["score"] < 0.7}
    assert toxicity.score(documents(spark, []), model).collect() == []


@pytest.mark.parametrize("module", [toxicity, compression_quality])
def test_one_class_or_no_labels_gives_the_share(spark, labelled, module):
    df, _, _, _, to = labelled
    for labels in ({1: 1, 2: 1}, {}):
        model = module.fit(df, to(labels) if labels else spark.createDataFrame([], "doc_id long, label int"))
        rows = module.score(df, model).collect()
        assert len({r["score"] for r in rows}) == 1


def test_compression_quality(spark, labelled):
    df, docs, _, good, to = labelled
    model = compression_quality.fit(df, to({i: k for i, k in good.items() if i % 5}), 200)
    assert accuracy(compression_quality.score(clashing(df), model), {i: k for i, k in good.items() if i % 5 == 0}) > 0.95
    rows = compression_quality.score(documents(spark, [(1, None), (2, ""), (3, "x" * 300_000)]), model).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[0]["score"] == rows[1]["score"]
    assert compression_quality.score(documents(spark, []), model).collect() == []


def test_langid(spark):
    rng = random.Random(6)
    sounds = {"en": ["the", "and", "ing"], "fr": ["eau", "oui", "é"], "de": ["sch", "ung", "ä"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(12)), lang) for i in range(300) for lang in [list(sounds)[i % 3]]]
    docs = documents(spark, rows + [(1_000, "rien", None), (None, "schung", "de")])
    model = langid.fit(docs.filter("doc_id % 5 != 0 or doc_id is null"), 60)
    assert model.langs == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in langid.predict(clashing(docs.drop("lang")), model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows if i % 5 == 0]) > 0.95
    odd = {r["doc_id"]: r for r in langid.predict(documents(spark, [(1, None), (2, ""), (3, "12 34 !? ½ ² Ⅷ ①"), (4, "zzz"), (5, "schungä " * 30_000)]), model).collect()}
    assert [odd[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and odd[1]["score"] == 0
    assert odd[4]["lang_pred"] in model.langs and odd[5]["lang_pred"] == "de"
    nothing = langid.fit(documents(spark, []), 10)
    assert langid.predict(documents(spark, [(1, "abc")]), nothing).first()["lang_pred"] == "und"
    assert langid.predict(documents(spark, []), model).collect() == []


def test_sample_takes_whole_texts_and_settles_repeats(spark):
    big = "x " * 200_000
    docs = documents(spark, [(1, big), (2, "b"), (2, "a"), (3, None), (4, "c"), (None, "d")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 0), (3, 0), (4, 0), (None, 1)], "doc_id long, label int")
    rows, counts = labelled_sample(docs, labels, 10)
    assert sorted((t[:3], k) for t, k in rows) == [("a", 0), ("a", 1), ("c", 0), ("x x", 1)] and counts == {1: 2, 0: 3} and big in [t for t, _ in rows]
    few, _ = labelled_sample(docs, labels, 10, total_bytes=2)
    assert 2 <= len(few) < len(rows)


ODD = ["", "12 ½ ² Ⅷ", "q" * 300_000, "An the " * 70_000, "schung-" * 50_000, "É" * 70 + " the", "naïve ﬁ İstanbul ǅ", "thé\u0301and", "a" * 262_144 + "b the"]


def test_langid_scores_equal_a_plain_scorer():
    rng, sounds = random.Random(2), {"en": ["the", "and", "ing"], "fr": ["eau", "oui", "é"], "de": ["sch", "ung", "ä"]}
    made = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    model = langid.train([(made(k, 40), k) for k in sounds for _ in range(30)])

    def plain(text):
        found, at = [], re.compile(r"[^\W\d_]+")
        for run in at.findall(text.lower()):
            found += "".join(c if c.isalpha() else " " for c in run).split()
        if not found:
            return "und", 0.0
        rows = []
        for w in found:
            if w in model.words:
                rows.append(model.words[w])
                continue
            marked, row = f" {w} ", [0.0] * len(model.langs)
            for n in range(5, 0, -1):
                hits = [model.grams[n - 1][g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in model.grams[n - 1] and g != " "]
                if hits:
                    row = [sum(h[j] for h in hits) / len(hits) for j in range(len(model.langs))]
                    break
            rows.append(row)
        mean = [math.fsum(r[j] for r in rows) / len(rows) for j in range(len(model.langs))]
        share = [math.exp(m - max(mean)) for m in mean]
        return model.langs[mean.index(max(mean))], max(share) / sum(share)

    texts = ODD + [made(k, n) for k in sounds for n in (1, 5, 50)]
    got = model.predict(texts)
    for text, (lang, score), (want, other) in zip(texts, got, map(plain, texts), strict=True):
        assert score == pytest.approx(other, abs=1e-9) and (lang == want or abs(other - 1 / 3) < 1e-9), text[:30]
    assert model.predict(texts[::-1])[::-1] == got and [model.predict([t])[0] for t in texts] == got


def test_toxicity_scores_equal_a_plain_scorer():
    rng = random.Random(3)
    model = toxicity.train([(prose(rng) + " scum" * (i % 2), i % 2) for i in range(80)], {0: 40, 1: 40})

    def plain(text):
        weights = []
        for w in set(re.findall(r"[^\W_]+", text.lower())):
            owner, bucket = toxicity.grams([w])
            assert len(owner) == sum(max(0, len(w) + 3 - n) for n in (3, 4, 5))
            weights.append(math.fsum(model.weights[bucket].astype(float)))
        return 1 / (1 + math.exp(-max(-30, min(30, model.bias + math.fsum(weights)))))

    texts = ODD + [prose(rng) for _ in range(5)] + ["scum " * 3]
    got = model.scores(texts)
    assert got == pytest.approx([plain(t) for t in texts], abs=1e-9)
    assert model.scores(texts[::-1])[::-1] == got


def test_quality_scores_equal_a_plain_scorer():
    rng = random.Random(8)
    model = compression_quality.train([((prose(rng) if i % 2 else "Buy now! " * 30), i % 2) for i in range(90)], {0: 45, 1: 45})
    for text in ODD[:6] + [prose(rng), "Buy now! " * 3]:
        data, gained = text.encode(), 0
        for i in range(0, len(data), 256):
            sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[i : i + 256])) for d in (model.good, model.bad)] if i < 20 * 256 else [0, 0]
            gained += sizes[1] - sizes[0]
        if len(data) <= 20 * 256:
            line = model.line[0] * (gained / max(1, len(data))) + model.line[1] * 64 / (64 + len(text)) + model.line[2]
            assert model.score(text) == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, line)))), abs=1e-12)


def test_the_queries(spark, labelled, tmp_path):
    """Held-out rows are those of the fold and never train; predicted follows the threshold; languages are learned ones."""
    df, docs, tox, good, _ = labelled
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, good[i], tox[i]) for i in tox], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    flipped = spark.createDataFrame([(i, good[i] if zlib.crc32(str(i).encode()) % 5 else 1 - good[i], tox[i] if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - tox[i]) for i in tox], "doc_id long, quality int, toxic int")
    df.write.parquet(f"{tmp_path}/other/documents.parquet")
    flipped.write.parquet(f"{tmp_path}/other/labels.parquet")
    for name, folds, held, threshold in (("op5_compression_quality", 5, 0, 0.3), ("op7_nb_toxicity", 3, 1, 0.7)):
        rows = {r["doc_id"]: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert rows.keys() == tox.keys()
        for i, r in rows.items():
            assert r["held_out"] == (zlib.crc32(str(i).encode()) % folds == held) and r["predicted"] == int(r["score"] >= threshold) and 0 <= r["score"] <= 1
        assert {r["doc_id"]: r["score"] for r in queries.QUERIES[name](spark, f"{tmp_path}/other").collect()} == {i: r["score"] for i, r in rows.items()}
    rows = queries.QUERIES["op8_word_backoff_langid"](spark, str(tmp_path)).collect()
    assert {r["lang_pred"] for r in rows} == {"en"} and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
