import duckdb
import pandas as pd
import pytest

import foliant.llm.boilerplate as boilerplate
from foliant.llm.boilerplate import drop_boilerplate

from .helpers import clashing, documents


def brute(rows, sites, least=10):
    where, first = {}, {}
    for i, text, _, source in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line) >= least:
                where.setdefault(line, set()).add(source)
                place = (i is not None, i or 0, pos)
                first[line] = min(first.get(line, place), place)
    gone = {line for line, s in where.items() if len(s) >= sites}
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if x not in gone or first[x] == (i is not None, i or 0, p)) for i, t, _, _ in rows]


@pytest.mark.parametrize("limit", [200_000, 0])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(boilerplate, "_BROADCAST_LINES", limit)
    rows = []
    for i in range(120):
        lines = [f"own line number {i} of a site"] + ["All rights are reserved here."] * (i % 2)
        lines += [f"shared by about {k} sites, more or less" for k in range(1, 16) if i % 20 < k]
        rows.append((i, "\n".join(lines) + ("\n" if i % 3 else ""), "en", f"s{i % 20}" if i % 20 else None))
    rows += [(200, None, "en", "a"), (201, "", "en", "b"), (202, "\n\n", "en", "c"), (203, "short\nshort", "en", "d"), (None, "All rights are reserved here.", "en", "e")]
    rows += [rows[1], (204, "long line of text " * 20_000, "en", "f")]
    docs = clashing(documents(spark, rows))
    got = drop_boilerplate(docs, sites=10, report="report")
    assert sorted(got.columns) == sorted(docs.columns)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=key) == sorted([(r[0], t) for r, t in zip(rows, brute(rows, 10), strict=True)], key=key)
    for r in got.collect():
        assert r["report"]["removed"] <= r["report"]["lines"]
        if r["report"]["removed"]:
            assert r["n_chars"] == len(r["text"])
    assert drop_boilerplate(documents(spark, [])).collect() == []


def test_estimates_far_from_the_threshold_decide(spark):
    rows = [(i, "a line that stands everywhere\n" + f"private line {i:05}", "en", f"s{i}") for i in range(400)]
    got = {r["doc_id"]: r["text"] for r in drop_boilerplate(documents(spark, rows), sites=100).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"private line {i:05}" for i in range(1, 400))


def test_sql_gives_the_same(spark, tmp_path):
    from foliant.llm import queries

    docs = documents(spark, [(i, f"line {i % 3} is on many sites\nown {i} text here\n", "en", f"s{i % 12}") for i in range(60)] + [(99, None), (100, "")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    want = con.execute(queries.ORACLES["op6_line_spread"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES["op6_line_spread"](spark, str(tmp_path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns].astype(object).where(got.notna(), None), want.astype(object).where(want.notna(), None), check_dtype=False)
