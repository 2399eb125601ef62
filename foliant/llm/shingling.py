"""Word tokens and word shingles as 64-bit hashes, vectorised over Arrow batches.

A word of up to 64 bytes is hashed by a polynomial over its bytes, a longer one
by xxh3: the polynomial alone is weak on long periodic words. Long texts are
worked through in pieces of whole words, so that the arrays by byte stay small;
what grows with a text is eight bytes for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PIECE = 1 << 18
_LONG_WORD = 64
#: A-Z lowered, every white character a space.
_FOLD = bytes(0x20 if b in (0x20, *range(0x09, 0x0E)) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
_COEFFICIENTS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _piece_hashes(text: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a folded piece, none of which crosses ``edges``, and each edge's word offset."""
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    inside = data != 0x20
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at = edges[edges < n]
    opens[at] = inside[at]
    starts = np.flatnonzero(opens)
    shut = inside.copy()
    shut[:-1] &= ~inside[1:]
    at = edges[edges > 0] - 1
    shut[at] = inside[at]
    ends = np.flatnonzero(shut) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=sums[1:])
    sizes = (ends - starts).astype(np.uint64)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + sizes)
    for i in np.flatnonzero(sizes > _LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return hashes, np.searchsorted(starts, edges)


def word_hashes(text: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, and the word offset of every row edge in ``text``."""
    text = text.translate(_FOLD)
    if len(text) <= 2 * _PIECE:
        return _piece_hashes(text, edges) if text else (np.zeros(0, np.uint64), np.zeros(len(edges), np.int64))
    # one long row: cut after spaces; a word that fills a piece is hashed alone
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        if end < len(text):
            last = text.rfind(b" ", at, end) + 1
            if last > at:
                end = last
            else:
                end = text.find(b" ", end)
                end = len(text) if end < 0 else end
        if end - at > _PIECE:
            found.append(np.array([xxhash.xxh3_64_intdigest(text[at:end])], np.uint64))
        else:
            found.append(_piece_hashes(text[at:end], np.zeros(1, np.int64))[0])
        at = end
    hashes = np.concatenate(found)
    return hashes, np.array([0, len(hashes)])


def blocks(column: pa.Array, most: int = _PIECE):
    """(first row, slice) pieces of about ``most`` bytes of text, whole rows each; a longer row stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield at, column.slice(at, i - at)
            at, total = i, 0
        total += size
    if at < len(column):
        yield at, column.slice(at)


def _bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The column's UTF-8 bytes end to end and the edges of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None else b""), offsets - offsets[0]


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of every row.

    A row with fewer than ``k`` words, but some, has its whole word sequence as
    its one shingle; one without words has an empty set.
    """
    for first, piece in blocks(column):
        words, at = word_hashes(*_bytes(piece))
        n = len(words)
        grams = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            grams += words[j : n - k + 1 + j] * _COEFFICIENTS[j] if n >= k else 0
        grams = mix(grams + np.uint64(k))
        for i in range(len(piece)):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                got = np.sort(grams[a : b - k + 1])
                if len(got) > 1:
                    fresh = np.empty(len(got), bool)
                    fresh[0] = True
                    np.not_equal(got[1:], got[:-1], out=fresh[1:])
                    got = got[fresh]
            elif b > a:
                whole = (words[a:b] * _COEFFICIENTS[: b - a]).sum(dtype=np.uint64)
                got = mix(np.array([whole + np.uint64(b - a)], np.uint64))
            else:
                got = words[:0]
            yield first + i, got


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
