"""Byte-level BPE by longest matches with backtracking, exact and in linear time.

Every token is a key of an Aho-Corasick automaton over Latin-1 text (one
character for each byte). Encoding takes the longest match at each position
and goes on; two neighbours may stand together only
if merging their joined bytes gives exactly the two of them. Where a match
doesn't fit, the next shorter prefix token is tried (which one may follow a
token is memoised for each match); where none fits, the
position is closed for good and the encoder steps back, so each position is
opened once. The result is
the sequence that merging by rank gives.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, frugal

# The characters with Unicode's White_Space property.
_WHITE = "\t-\r \x85\xa0  -     　"
#: No match of public_tokenizers.PATTERN holds a white character after another one,
#: so for it texts may be cut before any white character that follows a different one.
#: Under another pattern texts are only cut into its matches. Nor does a match change
#: where it stands alone, so chunks and their matches share one cache.
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_CACHED = 150_000
_CACHED_CHARS = 64
_CACHED_PAIRS = 250_000
_NEVER = 1 << 62
_LARGEST_VOCABULARY = 64 << 20


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Recent(dict):
    """Results of ``work`` by text, of two generations: a full one becomes the older, what is asked again stays."""

    def __init__(self, work: Callable[[str], bytes]):
        self.work, self.older = work, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.work(text)
            if len(text) > _CACHED_CHARS:
                return found
        if len(self) >= _CACHED:
            self.older = dict(self)
            super().clear()
        self[text] = found
        return found

    def clear(self) -> None:
        super().clear()
        self.older = {}


class Encoder:
    """Encodes and decodes with one vocabulary; ``pattern`` splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pattern, self._cuts = regex.compile(pattern), pattern == public_tokenizers.PATTERN
        self.sizes = [0] * (max(self.tokens) + 1)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if self.merged(token) == [token]:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self._fitting: dict[int, int] = {}
        self._shorter = [-2] * len(self.sizes)
        self._spines: dict[int, tuple[tuple[tuple[bytes, int], ...], ...]] = {}
        self._known = Recent(self._chunk if self._cuts else self._piece)

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Merge by rank until no pair is left, or ``until`` parts; only for single tokens, which are short."""
        ranks, parts = self.ranks, [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            best = at = _NEVER
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], _NEVER)
                if rank < best:
                    best, at = rank, i
            if best == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, a: int) -> tuple[tuple[tuple[bytes, int], ...], ...]:
        """The parts that stand at the token's left and right edge while it is merged, each with the rank that ends it."""
        known = self._spines.get(a)
        if known is None:
            known = self._spines[a] = (self._spine(a, 0), self._spine(a, -1))
        return known

    def _spine(self, a: int, side: int) -> tuple[tuple[bytes, int], ...]:
        part, spine = self.tokens[a], [(self.tokens[a], _NEVER)]
        while len(part) > 1:
            end = self.ranks[part]
            part = self.merged(part, 2)[side]
            spine.append((part, end))
        return tuple(spine)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined bytes of two tokens leaves these two.

        A merge across the border takes place where its rank comes before the
        ranks that end its two parts; of two equal ranks the left one is first.
        """
        ranks = self.ranks
        for x, x_end in self.spines(a)[1]:
            for y, y_end in self.spines(b)[0]:
                rank = ranks.get(x + y)
                if rank is not None and rank < x_end and rank <= y_end:
                    return False
        return True

    def fitting(self, a: int, b: int) -> int:
        """The token ``b`` or the longest token it begins with that may stand after ``a``; -1 if there is none; memoised."""
        known = self._fitting.get(a << 32 | b)
        if known is None:
            if len(self._fitting) >= _CACHED_PAIRS:
                self._fitting.clear()
            known = b
            while known >= 0 and not self.compatible(a, known):
                known = self.shorter(known)
            self._fitting[a << 32 | b] = known
        return known

    def shorter(self, a: int) -> int:
        """The longest mergeable token that is a proper prefix of this one; -1 if there is none."""
        known = self._shorter[a]
        if known == -2:
            token = self.tokens[a].decode("latin-1")
            known = self._shorter[a] = next((self.automaton.get(token[:n]) for n in range(len(token) - 1, 0, -1) if token[:n] in self.automaton), -1)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, fitting = piece.decode("latin-1"), self._fitting
        found, sizes = [rank for _, rank in self.automaton.iter_long(text)], self.sizes
        if sum([sizes[t] for t in found]) < len(text):
            raise ValueError("the vocabulary lacks a byte of the text")
        last = found[0]
        for i in range(1, len(found)):
            token = found[i]
            fits = fitting.get(last << 32 | token)
            if fits != token and (fits is not None or self.fitting(last, token) != token):
                return self._backtrack(text, found[:i], token)
            last = token
        return found

    def _backtrack(self, text: str, found: list[int], token: int) -> list[int]:
        """Go on where the longest match ``token`` doesn't fit after the tokens found so far."""
        n, sizes, fitting = len(text), self.sizes, self._fitting
        longest = [-1] * (n + 1)
        for end, rank in self.automaton.iter(text):
            longest[end + 1 - sizes[rank]] = rank  # ends rise, so the last one is the longest
        opened = bytearray(b"\1") * (n + 1)
        at, last = sum([sizes[t] for t in found]), found[-1]
        while at < n:
            while token >= 0:
                if last >= 0:
                    fits = fitting.get(last << 32 | token)
                    token = self.fitting(last, token) if fits is None else fits
                    if token < 0:
                        break
                end = at + sizes[token]
                if opened[end]:
                    break
                token = self.shorter(token)
            if token >= 0:
                found.append(token)
                at, last = end, token
                token = longest[at]
            else:
                opened[at] = 0
                if not found:
                    raise ValueError("the vocabulary lacks a byte of the text")
                token = found.pop()
                last = found[-1] if found else -1
                at -= sizes[token]
                token = self.shorter(token)
        return found

    def _piece(self, piece: str) -> bytes:
        ids = array("I", self.encode_piece(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _chunk(self, chunk: str) -> bytes:
        pieces = self.pattern.findall(chunk)
        if len(pieces) == 1:
            return self._piece(pieces[0])
        return b"".join(map(self._known.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        parts = _CHUNK.findall(text) if self._cuts else self.pattern.findall(text)
        return b"".join(map(self._known.__getitem__, parts))

    def forget(self) -> None:
        """Drop what was remembered of texts, as a worker lives on for other stages; what is known of the vocabulary stays."""
        self._known.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[int, int, str], Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """The worker's encoder for this vocabulary, built once."""
    key = (len(data), hash(data), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(data), pattern)
    return _encoders[key]


def bpe(docs: DataFrame, vocabulary: str, pattern: str, decode: bool = True) -> DataFrame:
    """Encode every whole text, and decode the ids again.

    Reads doc_id and text; other columns are ignored. Returns doc_id, ids
    (binary, little-endian unsigned 32-bit) and, with ``decode``, decoded
    (binary UTF-8), compared with the text: a difference is an error. A null or
    empty text has no ids; a text may have as many as fit two gigabytes; rows
    may repeat; an empty table stays empty. A byte that the vocabulary lacks is
    an error. The vocabulary file is read by the driver and broadcast;
    it must be under 64 MB.
    """
    if os.path.getsize(vocabulary) > _LARGEST_VOCABULARY:
        raise ValueError("the vocabulary file is over 64 MB")
    with open(vocabulary, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(data.value, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [own.encode(t) for t in texts]
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decode:
                back = [own.decode(x) for x in ids]
                if any(x != t.encode() for x, t in zip(back, texts, strict=True)):
                    raise ValueError("token ids do not decode to their text")
                columns.append(pa.array(back, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        own.forget()

    schema = "doc_id long, ids binary" + ", decoded binary" * decode
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), schema)
