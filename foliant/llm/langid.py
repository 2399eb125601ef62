"""Language identification, words first: log frequencies of known words, shorter and shorter character n-grams for others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import labelled_sample
from .shingling import mix
from .store import bounded_batches, frugal

_PIECE = 1 << 18
_LONG_WORD = 64
_CACHED_CELLS = 2_000_000
LONGEST_GRAM = 5
UNKNOWN = "und"
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters, as ``str.isalpha`` has it."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def _spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, and the start and end of every run of letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.flatnonzero(np.diff(_letters()[codes].astype(np.int8), prepend=0, append=0))
    return codes, edges[::2], edges[1::2]


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about 262,144 characters that cut no run of letters."""
    at = 0
    while len(text) - at > _PIECE:
        end = at + _PIECE
        while end > at and text[end - 1].isalpha():
            end -= 1
        if end == at:
            end = at + _PIECE
            while end < len(text) and text[end].isalpha():
                end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n-gram at every place."""
    m = max(0, len(codes) - n + 1)
    value = np.full(m, n, np.uint64)
    for j in range(n):
        value = (value ^ codes[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    return value


def words(text: str) -> list[str]:
    """Runs of letters, lower case, whole."""
    found = []
    for piece in _pieces(text.lower()):
        _, starts, ends = _spans(piece)
        found += [piece[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return found


@dataclass
class Model:
    """Log frequencies by language: of words, and of n-grams from 1 to 5 characters."""

    langs: list[str]
    words: dict[str, tuple[float, ...]]
    grams: list[dict[str, tuple[float, ...]]]

    def __post_init__(self):
        self._rows: dict[int, int] = {}
        self._table = np.zeros((1024, len(self.langs)))
        self._grams = []
        for n, table in enumerate(self.grams, 1):
            some = [g for g in table if g != " "]
            keys = _gram_keys(np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), n)[::n]
            order = np.argsort(keys)
            self._grams.append((keys[order], np.array([table[g] for g in some], float).reshape(len(some), len(self.langs))[order]))

    def word(self, word: str) -> np.ndarray:
        """A known word's log frequencies; else the mean over its n-grams of the longest length with any known one."""
        known = self.words.get(word)
        if known is not None:
            return np.array(known)
        marked = f" {word} "
        for n in range(LONGEST_GRAM, 0, -1):
            table = self.grams[n - 1]
            found = Counter(g for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in table and g != " ")
            if found:
                return np.sum([np.array(table[g]) * c for g, c in found.items()], axis=0) / found.total()
        return np.zeros(len(self.langs))

    def _many(self, words: list[str]) -> np.ndarray:
        """What ``word`` gives for each of these, all unknown ones together."""
        out = np.zeros((len(words), len(self.langs)))
        new = []
        for i, w in enumerate(words):
            known = self.words.get(w)
            if known is None:
                new.append(i)
            else:
                out[i] = known
        if not new:
            return out
        marked = "".join([f" {words[i]} " for i in new])
        codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word_of = np.repeat(np.arange(len(new)), [len(words[i]) + 2 for i in new])
        left = np.ones(len(new), bool)
        for n in range(LONGEST_GRAM, 0, -1):
            keys, rows = self._grams[n - 1]
            m = len(codes) - n + 1
            if not len(keys) or m <= 0:
                continue
            own = _gram_keys(codes, n)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == own) & (word_of[:m] == word_of[n - 1 :]) & left[word_of[:m]])
            owner, found = word_of[hit], rows[at[hit]]
            count = np.bincount(owner, minlength=len(new))
            some = count > 0
            sums = np.column_stack([np.bincount(owner, weights=found[:, j], minlength=len(new)) for j in range(len(self.langs))])
            out[np.array(new)[some]] = sums[some] / count[some, None]
            left &= ~some
            if not left.any():
                break
        return out

    def _add(self, keys: list[int], values: np.ndarray) -> None:
        at = len(self._rows)
        while at + len(keys) > len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
        self._table[at : at + len(keys)] = values
        self._rows.update(zip(keys, range(at, at + len(keys)), strict=True))

    def _lookup(self, text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table row of every word; each distinct one is looked up once."""
        sizes = ends - starts
        if len(codes) > 4 * _PIECE:  # a run of letters as long as that stands nearly alone
            at = len(self._rows)
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                self._add([-1 - at - i], self.word(text[a:b])[None])
            return np.arange(at, at + len(starts))
        up, down = _powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * down[starts] + sizes.astype(np.uint64))
        for i in np.flatnonzero(sizes > _LONG_WORD):
            keys[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]].encode("utf-8", "surrogatepass"))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        known, every = self._rows, distinct.tolist()
        fresh = [i for i, key in enumerate(every) if key not in known]
        if fresh:
            at = first[np.array(fresh)]
            self._add([every[i] for i in fresh], self._many([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
        return np.array([known[key] for key in every], np.int64)[back]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Each text's likeliest language and its share of the mean likelihood over words; ``und`` and 0 without letters."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        total, count = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)

        def add(group: list[tuple[int, str]]) -> None:
            if len(self._rows) * len(self.langs) > _CACHED_CELLS:
                self._rows.clear()
            joined = "\n".join([t for _, t in group])
            codes, starts, ends = _spans(joined)
            if not len(starts):
                return
            rows = self._lookup(joined, codes, starts, ends)
            edges = np.cumsum([0] + [len(t) + 1 for _, t in group])
            owner = np.searchsorted(edges, starts, "right") - 1
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            texts_of = np.array([i for i, _ in group])[owner[first]]
            total[texts_of] += np.add.reduceat(self._table[rows], first, axis=0)
            count[texts_of] += np.diff(np.append(first, len(owner)))

        group, held = [], 0
        for i, text in enumerate(texts):
            for piece in _pieces(text.lower()):
                if group and (held + len(piece) > _PIECE or group[-1][0] == i):
                    add(group)
                    group, held = [], 0
                group.append((i, piece))
                held += len(piece)
        if group:
            add(group)
        mean = total / np.maximum(count, 1)[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        best = mean.argmax(axis=1)
        score = share[np.arange(len(texts)), best] / share.sum(axis=1)
        return [(self.langs[b], float(s)) if n else (UNKNOWN, 0.0) for b, s, n in zip(best.tolist(), score.tolist(), count.tolist(), strict=True)]


def _log_shares(counts: list[Counter], keep: int, least: int) -> dict[str, tuple[float, ...]]:
    """Add-half log frequencies of each language's ``keep`` commonest keys seen ``least`` times."""
    keys = {k for c in counts for k, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:keep] if n >= least}
    size = len({k for c in counts for k in c}) or 1
    totals = [sum(c.values()) + 0.5 * size for c in counts]
    return {k: tuple(float(np.log((c[k] + 0.5) / t)) for c, t in zip(counts, totals, strict=True)) for k in keys}


def train(rows: list[tuple[str, str]], keep_words: int = 20_000, keep_grams: int = 10_000, least_word: int = 3, least_gram: int = 2) -> Model:
    """Count words and n-grams of labelled texts by language.

    The model holds of each language the ``keep_words`` commonest words that it
    has ``least_word`` times and, for each length, the ``keep_grams`` commonest
    n-grams that it has ``least_gram`` times; frequencies
    are over all that was counted. What the model lacks is scored by backing off.
    """
    langs = sorted({lang for _, lang in rows})
    by_word = [Counter() for _ in langs]
    for text, lang in rows:
        by_word[langs.index(lang)].update(words(text))
    by_gram = [[Counter() for _ in langs] for _ in range(LONGEST_GRAM)]
    for at, counted in enumerate(by_word):
        for word, n in counted.items():
            marked = f" {word} "
            for size in range(1, LONGEST_GRAM + 1):
                own = by_gram[size - 1][at]
                for i in range(len(marked) - size + 1):
                    own[marked[i : i + size]] += n
    return Model(langs, _log_shares(by_word, keep_words, least_word), [_log_shares(c, keep_grams, least_gram) for c in by_gram])


def fit(docs: DataFrame, per_lang: int = 600, **bounds: int) -> Model:
    """Train on at most ``per_lang`` documents of each non-null lang of ``docs(doc_id, text, lang)``, see ``labelled_sample``; ``bounds`` of the model go to ``train``."""
    rows, _ = labelled_sample(docs, docs.select("doc_id", F.col("lang").alias("label")), per_lang)
    return train(rows, **bounds)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; null or letterless texts give ``und`` with score 0.

    Letters are what ``str.isalpha`` takes for such: ½ and Ⅷ are none. Reads
    doc_id and text; other columns are ignored. Words count whole, whatever
    their length; rows with equal texts get equal results; an empty table stays
    empty. A model without languages gives ``und`` throughout.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast((model.langs, model.words, model.grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in batches:
            found = own.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")
