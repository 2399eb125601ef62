import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm.bpe import Encoder, bpe, read_ranks

from .helpers import clashing, documents

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        ranks = read_ranks(file.read())
    return Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.sampled_from(list("abeinrst .,'19\n\t\x85\xa0  　\x1céß中文🙂-=")), max_size=80))
def test_equals_tiktoken(both, text):
    own, other = both
    assert ids(own.encode(text)) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_long_runs_stay_exact_and_linear(both):
    own, other = both
    for text in ("a" * 50_000, "ab" * 30_000, " " * 40_000 + "x", "🙂" * 5_000, "<|endoftext|> it's"):
        assert ids(own.encode(text)) == other.encode_ordinary(text)


def test_table(spark, both):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (2, None), (3, ""), (None, "x\n\n"), (4, "wörter und mehr " * 20_000)]
    got = bpe(clashing(documents(spark, rows)), PATH, P.PATTERN).collect()
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for (_, text), r in zip(rows, got, strict=True):
        assert ids(r["ids"]) == both[1].encode_ordinary(text or "")
        assert hashlib.sha256(r["decoded"]).digest() == hashlib.sha256((text or "").encode()).digest()
    assert bpe(documents(spark, []), PATH, P.PATTERN).collect() == []


def test_other_patterns_and_missing_bytes(both):
    pattern = r"\p{L}+\s*\p{L}*|\s+\S|."
    own = Encoder(both[0].ranks, pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=both[0].ranks, special_tokens={})
    for text in ("one two  three", "a \n b", "  x", "ab\u3000 cd ef"):
        assert ids(own.encode(text)) == other.encode_ordinary(text)
    lacking = Encoder({t: r for t, r in both[0].ranks.items() if b"q" not in t}, P.PATTERN)
    for text in ("q", "aqua", "unique things", "qqqq"):
        with pytest.raises(ValueError):
            lacking.encode(text)


def test_the_query(spark, both, tmp_path):
    from foliant.llm import queries

    rows = [(1, "Hello  world"), (2, None), (3, ""), (4, "wörter\n\n und mehr " * 2_000), (None, "x")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_byte_bpe"](spark, str(tmp_path)).collect()}
    for i, text in rows:
        want = both[1].encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(want) and got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_while_caches_turn_over(both, monkeypatch):
    from foliant.llm import bpe as module

    for name in ("_CACHED", "_CACHED_PAIRS"):
        monkeypatch.setattr(module, name, 3)
    own = Encoder(both[0].ranks, P.PATTERN)
    for text in ("the unlikely, the unlikelier; it's wörter 's and and\n\n  the unlikely " * 5, "x" * 200 + ", " + "x" * 200, "中文🙂-= 19ab"):
        assert ids(own.encode(text)) == both[1].encode_ordinary(text)
        assert len(own._known) <= 3 and len(own._fitting) <= 3
