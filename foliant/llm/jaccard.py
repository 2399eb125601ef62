"""N-gram Jaccard join by parity sketches.

Every document is the set of its distinct word shingles. Each set gets

* a block sketch: shingles are dealt by hash to ``k`` blocks and the 64-bit
  hashes of a block are XORed, so one shingle more or less changes one block;
* bit sketches of 512 and 4,096 parity bits, whose Hamming distance to another
  is at most the size of the symmetric difference.

For a similarity t and sizes a and b, a linked pair differs in at most
``D = (1-t)/(1+t) * (a+b)`` shingles. Sizes fall into bands; a band has
``k = D + 1 + e`` blocks for its largest D, so by the pigeonhole principle a
linked pair has ``1 + e`` equal blocks. Put all blocks of the band into one
order and let every set leave out the last ``e`` of its own: the first equal
block of a linked pair is followed by ``e`` others, so neither set leaves it
out. The order is empty blocks last, then the blocks that most sets have. What
many unlinked documents share, a passage, thus costs nothing as long as it
fills no more than ``e`` blocks. The join on (band, block, XOR) loses no link.

Groups: equal sets are one class from the start. Within one block pairs are
tested against its first class only, so a group of n near copies costs about n
tests, not n * n. Blocks that still span several components are compared in
bounded groups of bit sketches: first a spanning forest of the near pairs is
verified, then what is near and still apart is decided on the exact sets, in
tasks that let out no more links than it takes to connect their documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shingling import mix, overlap, shingle_sets
from .store import bounded_batches, cut, free, frugal, small

PARITY_BITS = 512
WIDE_BITS = 4096
_BAND_GROWTH = 1.4
_BANDS = 256
_BLOCK = 1024
_BLOCK_SHINGLES = 4 << 20
_SEEN_CLASSES = 1_000_000
_CROWDED = 4096
_SALTS = 64
_COUNTED = 1 << 16
_PARTNERS = 1024
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def largest_difference(total: int, num: int, den: int) -> int:
    """Most shingles in which two sets of ``total`` elements together differ at similarity num/den."""
    return (den - num) * total // (den + num)


class Bands:
    """Size bands and the sets of blocks a document of a given size takes part in."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.lows = num, den, [1]

    def _grow(self, size: int) -> None:
        while self.lows[-1] <= size * self.den // self.num + 1:
            low = self.lows[-1]
            self.lows.append(max(low + 1, int(low * _BAND_GROWTH + 1)))

    def levels(self, size: int) -> list[tuple[int, int, int]]:
        """(band, blocks, slack) for the own band and every higher one that holds a partner."""
        self._grow(size)
        own, found = bisect.bisect_right(self.lows, size) - 1, []
        for band in range(own, len(self.lows) - 1):
            if self.den * size < self.num * self.lows[band]:
                break
            most = largest_difference(2 * (self.lows[band + 1] - 1), self.num, self.den)
            if most:
                slack = 1 if most == 1 else 2 + most // 8
                found.append((band, most + 1 + slack, slack))
        return found


def block_keys(shingles: np.ndarray, band: int, blocks: int, slack: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Join keys of one sorted set in one band, which of them are empty blocks, and how many keys it may leave out.

    Up to ``slack`` empty blocks are left out at once. A key's low bits are its band.
    """
    block = ((shingles >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    tokens = mix(shingles ^ _GOLDEN)
    sums, used = np.bitwise_xor.reduceat(tokens, first), block[first]
    without = blocks - len(used)
    bare = np.zeros(len(used), bool)
    if without > slack:
        empty = np.setdiff1d(np.arange(blocks, dtype=np.uint64), used)
        used, sums, bare = np.concatenate((used, empty)), np.concatenate((sums, np.zeros(len(empty), np.uint64))), np.concatenate((bare, np.ones(len(empty), bool)))
    keys = mix(sums ^ mix(used + np.uint64(band << 32) + np.uint64(7)))
    return keys & ~np.uint64(_BANDS - 1) | np.uint64(band), bare, slack if without > slack else slack - without


def _hashes(got: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that stand for a set."""
    return np.bitwise_xor.reduce(mix(got + np.uint64(1))), mix(got ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)


def _parity(got: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((got & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            parity = np.zeros((n, PARITY_BITS // 64), np.uint64)
            for i, got in shingle_sets(batch.column(1), k):
                size[i] = len(got)
                if len(got):
                    one[i], two[i] = _hashes(got)
                    parity[i] = _parity(got, PARITY_BITS).view(np.uint64)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * (PARITY_BITS // 64))
            own = [pa.array(size), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(parity.reshape(-1).view(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *own], ["doc_id", "text_key", "text_sum", "size", "one", "two", "parity"])

    return run


class _Crowds:
    """Finds the keys that one task sends often; their rows are then dealt by class too, so that no task gets them all."""

    def __init__(self):
        self.counts, self.sent, self.known = np.zeros(1 << 20, np.int32), 0, set()

    def salts(self, keys: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A salt for each row, 0 for most. The first row of a key that gets others says so in its mark and keeps salt 0."""
        slot = (keys >> np.uint64(8) & np.uint64(len(self.counts) - 1)).astype(np.int64)
        busy = self.counts[slot] >= _CROWDED
        self.counts += np.bincount(slot, minlength=len(self.counts)).astype(np.int32)
        self.sent += len(keys)
        salt, hot = np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        if busy.any():
            at = np.flatnonzero(busy)
            salt[at] = 1 + (mix(ones[at]) % np.uint64(_SALTS)).astype(np.int32)
            _, first = np.unique(keys[at], return_index=True)
            for i in at[first].tolist():
                if int(keys[i]) not in self.known:
                    self.known.add(int(keys[i]))
                    salt[i], hot[i] = 0, True
        if self.sent > 1 << 24:
            self.counts[:], self.sent, self.known = 0, 0, set()
        return salt, hot


def _keys(k: int, num: int, den: int):
    """(key, salt, one, mark) of every set; mark holds how many keys the set may leave out, whether this is an empty block, whether the key is crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen, crowds = Bands(num, den), set(), _Crowds()
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, ones, marks = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            salt, hot = crowds.salts(keys, ones)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(salt), pa.array(ones.view(np.int64)), pa.array(marks + hot)], ["key", "salt", "one", "mark"])

        for batch in batches:
            held = 0
            for _, got in shingle_sets(batch.column(0), k):
                if not len(got):
                    continue
                one, two = _hashes(got)
                if (int(one), int(two)) in seen:
                    continue
                if len(seen) >= _SEEN_CLASSES:
                    seen.clear()
                seen.add((int(one), int(two)))
                for band, blocks, slack in bands.levels(len(got)):
                    keys, bare, out = block_keys(got, band, blocks, slack)
                    parts.append((keys, np.full(len(keys), one, np.uint64), (out << 2) + 2 * bare.astype(np.int32)))
                    held += len(keys)
                if held > 100_000:
                    yield flush()
                    held = 0
            if parts:
                yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, salt, one): the keys that several sets have, with how many have them (65,536 for all the more, and for crowded keys)."""
    left: list[np.ndarray] = []  # the rows of the last group, which may go on
    many = None  # a group that is let out without waiting for its end

    def out(rows: list[np.ndarray], shared: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[i]) for i in (0, 2, 3)] + [pa.array(shared.astype(np.int32))], ["key", "one", "mark", "shared"])

    def grouped(rows: list[np.ndarray], ends: bool) -> Iterator[pa.RecordBatch]:
        nonlocal left, many
        key, salt, one, mark = rows
        same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
        fresh = np.flatnonzero(np.concatenate(([True], ~(same & (one[1:] == one[:-1])))))
        mark = np.minimum.reduceat(mark >> 1, fresh) << 1 | np.bitwise_or.reduceat(mark & 1, fresh)
        key, salt, one = key[fresh], salt[fresh], one[fresh]
        begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))))
        sizes = np.diff(np.append(begins, len(key)))
        crowded = (np.bitwise_or.reduceat(mark & 1, begins) > 0) | (salt[begins] > 0)
        if many is not None:
            if (key[0], salt[0]) == many:
                crowded[0] = True
            many = None
        left = []
        if not ends:
            if sizes[-1] > _COUNTED or crowded[-1]:
                crowded[-1], many = True, (key[-1], salt[-1])
            else:
                left = [x[begins[-1] :] for x in (key, salt, one, mark)]
                begins, sizes, crowded = begins[:-1], sizes[:-1], crowded[:-1]
        keep = np.repeat(crowded | (sizes > 1), sizes)
        if keep.any():
            n = len(keep)
            shared = np.repeat(np.where(crowded, _COUNTED, np.minimum(sizes, _COUNTED)), sizes)
            yield out([x[:n][keep] for x in (key, salt, one, mark)], shared[keep])

    for batch in batches:
        if batch.num_rows:
            rows = [np.asarray(batch.column(i)) for i in range(4)]
            yield from grouped([np.concatenate([a, b]) for a, b in zip(left, rows, strict=True)] if left else rows, False)
    if left:
        yield from grouped(left, True)


def _verify(k: int, num: int, den: int):
    """Links from rows (a, salt, b, text) sorted so that the text of ``a`` (null b) stands before those of its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            links = []
            for i, got in shingle_sets(batch.column(3), k):
                if b[i] is None:
                    head, centre = a[i], got
                elif head == a[i] and linked(got, centre, num, den):
                    links.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in links], pa.int64()) for j in (0, 1)], ["a", "b"])

    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = overlap(a, b)
    return both > 0 and den * both >= num * (len(a) + len(b) - both)


def classes_of(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """What the rows of ``docs`` are, and how their sets are linked.

    First a table with one row for each row of ``docs``: doc_id, text_key and
    text_sum (xxhash64 and crc32 of the text), size and node, a number for its
    set, the same for equal sets and null for an empty one. Second a table
    (node, label): the smallest node reachable by links, for all nodes that
    have any. Equality of shingles rests on 64-bit hashes, of sets on 128 bits.
    """
    bounded_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = base.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.crc32(F.col("text").cast("binary")).alias("text_sum"))
    profile = cut(keyed.mapInArrow(frugal(_profile(k)), "doc_id long, text_key long, text_sum long, size long, one long, two long, parity array<long>"))
    first = F.min(F.struct("text_key", "text_sum", F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    grouped = profile.filter("size > 0").groupBy("one", "two", "size").agg(first.alias("first"), F.first("parity").alias("parity"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("node"), "one", "two", "size", "first.doc_id", "first.text_key", "first.text_sum", "parity"))

    sent = base.select("text").mapInArrow(frugal(_keys(k, num, den)), "key long, salt int, one long, mark int")
    dealt = sent.repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "one")
    shared = cut(dealt.mapInArrow(frugal(_shared), "key long, one long, mark int, shared int"))
    members = cut(_members(shared, classes))
    free(shared)

    tested = cut(_passing(_stars(members), classes, num, den))
    needed = small(cut(classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_key", "text_sum")))
    same = keyed["doc_id"].eqNullSafe(needed["doc_id"]) & (keyed["text_key"] == needed["text_key"]) & (keyed["text_sum"] == needed["text_sum"])
    texts = cut(keyed.join(needed, same).select("node", "text").dropDuplicates(["node"]))
    links = cut(_verified(tested, texts, k, num, den))
    labels = components(links)
    done = [members, tested, texts, links]

    mixed = cut(_mixed(members, labels, classes))
    if mixed.limit(1).count():
        nodes = cut(texts.join(mixed.select("node").distinct(), "node", "left_semi").mapInArrow(frugal(_wide(k)), "node long, sketch binary"))
        near = cut(mixed.join(nodes, "node").groupBy("key", "i", "j").applyInArrow(_forest(num, den), "a long, b long").distinct())
        more = cut(_verified(near, texts, k, num, den))
        done += [mixed, nodes, near, more]
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links)
            mixed = cut(_mixed(members, labels, classes))
        apart = cut(mixed.join(nodes, "node").groupBy("key", "i", "j").applyInArrow(_apart(num, den), "key long, i int, j int, own int, node long, label long"))
        done += [mixed, apart]
        if apart.limit(1).count():
            decided = cut(apart.join(texts, "node").groupBy("key", "i", "j").applyInArrow(_decide(k, num, den), "a long, b long").distinct())
            labels = components(links.union(decided))
            done.append(decided)
    free(*done)
    named = profile.join(classes.select("one", "two", "size", "node"), ["one", "two", "size"], "left").select("doc_id", "text_key", "text_sum", "size", "node")
    return named, labels


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Components of documents whose word ``k``-shingle sets have Jaccard similarity >= num/den.

    Reads ``doc_id`` and ``text`` of a stored table, several times; other
    columns are ignored. Returns one row for each row of ``docs``: doc_id,
    n_shingles (long, of this row's text) and
    component_id (smallest doc_id reachable by links). A null or wordless text
    has an empty set, links with nothing and is its own component; with fewer
    than ``k`` words the whole sequence is one shingle. Rows that share a doc_id
    are one document: it is linked through any of its texts and all its rows
    have one component. A row without doc_id takes the component of its set,
    null if no document of that component has an id. An empty table gives an
    empty result.
    """
    named, labels = classes_of(docs, k, num, den)
    named = cut(named)
    by_id = named.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("node").alias("full"), F.min("node").alias("low"), F.max("node").alias("high"))
    repeated = cut(by_id.filter("low <> high or (full > 0 and full < rows)").select("doc_id", "low", "high"))
    if repeated.limit(1).count():
        # texts of one document: its nodes are one component, and its rows without words take part
        ties = named.join(repeated.filter("low <> high"), "doc_id").filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
        stars = labels.select(F.col("label").alias("a"), F.col("node").alias("b")).filter("a <> b")
        labels = components(stars.union(ties))
        named = named.join(repeated.select("doc_id", F.col("low").alias("other")), "doc_id", "left").withColumn("node", F.coalesce("node", "other")).drop("other")
    own = named.join(labels, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("label", "node").alias("label"))
    least = own.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return own.join(least, "label", "left").select("doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked texts one row stays, columns unchanged.

    Rows are compared by their texts, whatever their ids. The row with the
    smallest doc_id stays (null ids come last), of several texts of that id the
    one with the smallest hash, of repeated rows the one with the least other
    columns; columns of no order (maps) take whichever row's value. Null and
    wordless texts all stay. An empty table stays empty.
    """
    named, labels = classes_of(docs, k, num, den)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "text_sum")
    full = named.filter("node is not null").join(labels, "node", "left")
    full = cut(full.select(F.coalesce("label", "node").alias("label"), row.alias("row")))
    chosen = full.groupBy("label").agg(F.min("row").alias("chosen"), F.count("*").alias("n")).filter("n > 1").drop("n")
    judged = full.join(chosen, "label")
    lost = judged.filter("row <> chosen").select("row", F.lit(False).alias("stays")).distinct()
    twice = judged.filter("row = chosen").groupBy("row").agg(F.count("*").alias("n")).filter("n > 1").select("row", F.lit(True).alias("stays"))
    found = cut(lost.unionByName(twice).select(F.col("row.no_id").alias("_no"), F.coalesce("row.doc_id", F.lit(0)).alias("_id"), F.col("row.text_key").alias("_key"), F.col("row.text_sum").alias("_sum"), "stays"))
    own: list[Column] = [
        F.col("doc_id").isNull().alias("_no"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
        F.xxhash64("text").alias("_key"), F.crc32(F.col("text").cast("binary")).alias("_sum"),
    ]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *own)
    names = ["_no", "_id", "_key", "_sum"]
    kept = rows.join(small(found.select(*names)), names, "left_anti").select("_row.*")
    again = found.filter("stays").select(*names)
    if again.limit(1).count():
        repeats = rows.join(small(cut(again)), names, "left_semi")
        ordered = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        least = F.min_by("_row", F.struct(*[F.col(f"_row.{c}").alias(f"c{i}") for i, c in enumerate(ordered)]))
        kept = kept.unionByName(repeats.groupBy(*names).agg(least.alias("_row")).select("_row.*"))
    return kept


def _members(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node) of the shared keys that their sets do not leave out: all but the last of each set in its band, the commonest last."""
    band = F.col("key").bitwiseAND(_BANDS - 1).alias("band")
    rows = shared.select("key", "one", "shared", band, F.shiftright("mark", 2).alias("out"), F.col("mark").bitwiseAND(2).alias("bare"))
    own = Window.partitionBy("one", "band").orderBy(F.col("bare").desc(), F.col("shared").desc(), "key")
    kept = rows.withColumn("nth", F.row_number().over(own)).filter("nth > out").select("key", "one")
    kept = kept.join(classes.select("one", "node"), "one").select("key", "node")
    several = kept.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key")
    return kept.join(several, "key")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): every other class of a key with the key's first class."""
    first = members.groupBy("key").agg(F.min("node").alias("a"))
    return members.join(first, "key").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def _passing(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that pass the size test and the Hamming bound of their bit sketches."""
    for x in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("parity").alias(f"parity_{x}")), x)
    hamming = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fit = F.least("size_a", "size_b") * den >= F.greatest("size_a", "size_b") * num
    return pairs.filter(fit & (hamming * (den + num) <= (F.col("size_a") + F.col("size_b")) * (den - num))).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that are linked. A class's text goes once to each task that tests up to 1,024 partners of it."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / _PARTNERS).alias("salts"))
    salted = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    heads = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return sorted_.mapInArrow(frugal(_verify(k, num, den)), "a long, b long")


def _mixed(members: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, i, j, own, node, label, size) of the keys whose members lie in several components, dealt to pairs of bounded blocks."""
    named = members.join(classes.select("node", "size"), "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "size")
    number = F.xxhash64("node")
    by_key = named.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.sum("size").alias("total"),
        F.count("*").alias("n"), F.sum(number.bitwiseAND((1 << 40) - 1)).alias("s"), F.bit_xor(number).alias("x"),
    ).filter("low <> high")
    # keys with the same members decide the same pairs: keep one of each
    parts = F.ceil(F.greatest(F.col("n") / _BLOCK, F.col("total") / _BLOCK_SHINGLES)).cast("int")
    kept = by_key.groupBy("n", "s", "x").agg(F.min(F.struct("key", parts.alias("parts"))).alias("k")).select("k.*")
    dealt = named.join(kept, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "size")


def _wide(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [_parity(got, WIDE_BITS).tobytes() for _, got in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.binary())], ["node", "sketch"])

    return run


class Union:
    """Joins numbers into sets; ``join`` says whether they were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[b] = a
        return a != b


def _near(table: pa.Table, num: int, den: int) -> np.ndarray:
    """(distance, row, row) of the pairs of different components, one from each block, whose sketches lie near enough."""
    own, node, label, size = (np.asarray(table.column(c)) for c in ("own", "node", "label", "size"))
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(node), -1)
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    found = [np.zeros((0, 3), np.int64)]
    for x in left:
        fit = right[(label[x] != label[right]) & (den * np.minimum(size[x], size[right]) >= num * np.maximum(size[x], size[right])) & ((i != j) | (node[x] < node[right]))]
        if len(fit):
            far = np.bitwise_count(bits[fit] ^ bits[x]).sum(axis=1, dtype=np.int64)
            near = far * (den + num) <= (size[x] + size[fit]) * (den - num)
            found.append(np.column_stack([far[near], np.full(near.sum(), x), fit[near]]))
    return np.concatenate(found)


def _forest(num: int, den: int):
    """Of the near pairs of two blocks as many, nearest first, as connect the components that all of them would."""

    def run(table: pa.Table) -> pa.Table:
        pairs, (node, label) = _near(table, num, den), (np.asarray(table.column(c)) for c in ("node", "label"))
        sets, kept = Union(), []
        if len(pairs):
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            _, first = np.unique(np.sort(label[pairs[:, 1:]], axis=1), axis=0, return_index=True)
            kept = [i for i in np.sort(first).tolist() if sets.join(int(label[pairs[i, 1]]), int(label[pairs[i, 2]]))]
        ends = np.sort(node[pairs[np.array(kept, np.int64), 1:]], axis=1)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return run


def _apart(num: int, den: int):
    """The documents of two blocks that have a near one in another component."""

    def run(table: pa.Table) -> pa.Table:
        some = np.unique(_near(table, num, den)[:, 1:])
        return table.select(["key", "i", "j", "own", "node", "label"]).take(pa.array(some))

    return run


def _decide(k: int, num: int, den: int):
    """Links, decided on the exact sets, that connect what is linked across components between two blocks."""

    def run(table: pa.Table) -> pa.Table:
        sets = [got for _, got in shingle_sets(table.column("text").combine_chunks(), k)]
        sketches = pa.array([_parity(got, WIDE_BITS).tobytes() for got in sets], pa.binary())
        whole = table.append_column("size", pa.array([len(got) for got in sets], pa.int64())).append_column("sketch", sketches)
        pairs, (node, label) = _near(whole, num, den), (np.asarray(table.column(c)) for c in ("node", "label"))
        groups, out = Union(), []
        for _, x, y in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
            a, b = int(label[x]), int(label[y])
            if groups.root(a) != groups.root(b) and linked(sets[x], sets[y], num, den):
                groups.join(a, b)
                out.append((int(node[x]), int(node[y])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run
