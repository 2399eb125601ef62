import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from foliant.llm.bpe import read_ranks

from .helpers import clashing, documents


def test_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(8)
    pool = ["an", "the", "er", "ti", "on", "st", "re", "ou", "ha"]
    prose = lambda n: " ".join("".join(rng.choice(pool, rng.integers(1, 4))) for _ in range(n))
    rows, toxic = [], {}
    for i in range(400):
        text = prose(80)
        toxic[i] = int(i % 10 == 0)
        if toxic[i]:
            text += " worthless scum idiot scum"
        rows.append((i, text + "\nAll rights are reserved here.", "en", f"s{i % 12}"))
    rows += [(1_000 + i, rows[1][1].replace("the", "thee", 1), "en", "s1") for i in range(5)] + [(2_000, None, "en", None), (2_001, "", "fr", "s2")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, k) for i, k in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_duplicates", "mixing", "byte_bpe"]
    kept = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert np.mean([i not in ids for i, k in toxic.items() if k]) > 0.9 and np.mean([i in ids for i, k in toxic.items() if not k]) > 0.99
    lines = stages["line_dedup"](spark, kept, str(tmp_path))
    assert lines.columns == docs.columns and lines.count() == kept.count()
    assert sum("reserved" in (r["text"] or "") for r in lines.collect()) == 1
    single = stages["near_duplicates"](spark, kept, str(tmp_path))
    left = {r["doc_id"] for r in single.collect()}
    assert single.columns == docs.columns and ids - left == {1_000 + i for i in range(5)}
    mixed = stages["mixing"](spark, single, str(tmp_path))
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= left

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    with open(P.path(corpus_pipeline.VOCABULARY), "rb") as file:
        other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(file.read()), special_tokens={})
    texts = {i: t for i, t, *_ in rows}
    for r in out:
        text = other.decode(np.frombuffer(r["ids"], "<u4").tolist())
        assert r["n_tokens"] * 4 == len(r["ids"]) and text in (texts[r["doc_id"]] or "") and not re.search("scum", text)


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, [])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_short_shared_lines_go_too(spark):
    docs = documents(spark, [(i, f"own line number {i}\n\nLes.", "en", f"s{i % 12}") for i in range(24)])
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert got == {i: f"own line number {i}\n" + "\nLes." * (i == 0) for i in range(24)}


def test_rows_are_deduplicated_by_text(spark):
    rows = [(i, " ".join(f"{w}{n}" for n in range(40)), "en", s) for i, w, s in [(0, "p", "a"), (1, "p", "a"), (1, "q", "b"), (1, "q", "a"), (2, "r", "b"), (2, "s", "b")]]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, documents(spark, rows + [(3, None)]), "").collect()
    assert sorted((r["doc_id"], (r["text"] or "-")[0], r["source"]) for r in got) == [(0, "p", "a"), (1, "q", "a"), (2, "r", "b"), (2, "s", "b"), (3, "-", "s")]


def brute_stage(rows):
    """The near-duplicate stage by comparing all pairs of rows."""
    words = [re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in words]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] & sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best.setdefault(find(i), []).append((doc_id is None, doc_id or 0, i))
    return sorted([str(rows[i][0]) for i, s in enumerate(sets) if not s] + [str(rows[min(g)[2]][0]) for g in best.values() if sets[g[0][2]]])


def test_odd_rows_through_all_stages(spark, tmp_path):
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join("".join(rng.choice(["an", "the", "er", "ti", "on"], 3)) for _ in range(n))
    rows = [(i, prose(30)) for i in range(60)] + [(None, prose(30)), (None, prose(30)), (5, None), (None, None), (6, ""), (61, "x " * 100_000)]
    rows += [rows[3], rows[60], (70, rows[4][1] + " end"), (71, rows[8][1].upper())]
    docs = clashing(documents(spark, rows))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path)).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
    single = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in single.collect()) == brute_stage(rows)
    coded = corpus_pipeline.tokens(spark, docs, str(tmp_path))
    assert coded.count() == len(rows) and coded.filter("doc_id = 6").first()["n_tokens"] == 0
