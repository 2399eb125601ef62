"""Sharding along a Hilbert curve over several metadata dimensions, with DataFrame functions only."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

_CHUNK = 6
_TAIL = 4096


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of cells with ``bits`` bits in each dimension.

    A fold over (bit, dimension) steps undoes the excess rotations of the
    transposed index, then Gray-codes and interleaves it; lambda variables keep
    the expression linear in the number of steps.
    """
    n = len(coordinates)
    axes = F.array(*[c.cast("long") for c in coordinates])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def undo(x: Column, s: Column) -> Column:
        low = s["q"] - 1
        own = F.element_at(x, s["i"] + 1)
        swap = own.bitwiseXOR(x[0]).bitwiseAND(low)
        inverted = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(own.bitwiseAND(s["q"]) != 0, inverted).when(s["i"] == 0, x).otherwise(swapped)

    def gray(x: Column) -> Column:
        pre = F.transform(x, lambda _, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)))
        return pre

    def weave(x: Column) -> Column:
        masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
        last = F.element_at(x, n)
        turn = F.aggregate(masks, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        woven = lambda t: F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda h, p: h * 2 + F.call_function("getbit", F.element_at(x, p["i"] + 1).bitwiseXOR(t), p["b"]).cast("long"),
        )
        return F.element_at(F.transform(F.array(turn), lambda t: woven(t)), 1)

    moved = F.aggregate(steps, axes, undo)
    coded = F.transform(F.array(moved), gray)
    return F.element_at(F.transform(coded, weave), 1)


def _chunk(value: Column, skip: int) -> Column:
    """The ``_CHUNK`` bytes after the first ``skip`` as a number that sorts as they do, short ends included; exact as a double."""
    part = F.substring(value, skip + 1, _CHUNK)
    return F.conv(F.rpad(F.hex(part), 2 * _CHUNK, "0"), 16, 10).cast("long") * 8 + F.length(part)


def _bytes_of(chunk: int) -> bytes:
    return (chunk >> 3).to_bytes(_CHUNK, "big")[: chunk & 7]


def string_cuts(docs: DataFrame, name: str, cells: int) -> list[bytes]:
    """Values at the ``cells`` - 1 inner quantiles of a string or binary column, over all its rows.

    Quantiles are found for the first six bytes that differ; where several fall
    on the same six bytes, they are found again among the rows that begin so,
    and so on. What all values there share is skipped at once. Each level is two
    aggregations over the column, of at most ``cells`` expressions.
    """
    value = F.col(name).cast("binary")
    begins = lambda p: F.substring(value, 1, len(p)) == F.lit(bytearray(p))
    n = docs.agg(F.count(name)).first()[0]
    cuts: dict[int, bytes] = {}
    level = [(b"", n, {i: (i + 1) / cells for i in range(cells - 1)})] if n else []
    while level:
        ends = docs.agg(
            *[f(F.when(begins(p), F.substring(value, len(p) + 1, _TAIL))).alias(f"{f.__name__}{g}") for g, (p, _, _) in enumerate(level) for f in (F.min, F.max)]
        ).first()
        asked = []
        for g, (prefix, rows, shares) in enumerate(level):
            low, high = bytes(ends[f"min{g}"]), bytes(ends[f"max{g}"])
            if low == high and len(low) < _TAIL:
                cuts |= dict.fromkeys(shares, prefix + low)
            else:
                asked.append((prefix, prefix + os.path.commonprefix([low, high]), rows, shares))
        if not asked:
            break
        found = docs.agg(
            *[F.percentile_approx(F.when(begins(p), _chunk(value, len(q))), list(shares.values()), 10_000).alias(f"q{g}") for g, (p, q, _, shares) in enumerate(asked)]
        ).first()
        hot = []
        for g, (prefix, skip, rows, shares) in enumerate(asked):
            by_chunk: dict[int, list[int]] = {}
            for i, c in zip(shares, found[f"q{g}"], strict=True):
                by_chunk.setdefault(c, []).append(i)
            for c, at in by_chunk.items():
                if len(at) > 1 and c & 7 == _CHUNK:
                    hot.append((prefix, skip, c, rows, {i: shares[i] for i in at}))
                else:
                    cuts |= dict.fromkeys(at, skip + _bytes_of(c))
        if not hot:
            break
        counts = docs.agg(
            *[F.count_if(begins(p) & (_chunk(value, len(q)) < c)).alias(f"below{g}") for g, (p, q, c, _, _) in enumerate(hot)],
            *[F.count_if(begins(p) & (_chunk(value, len(q)) == c)).alias(f"n{g}") for g, (p, q, c, _, _) in enumerate(hot)],
        ).first()
        level = []
        for g, (_, skip, c, rows, shares) in enumerate(hot):
            inner = {i: min(1.0, max(0.0, (x * rows - counts[f"below{g}"]) / counts[f"n{g}"])) for i, x in shares.items()}
            level.append((skip + _bytes_of(c), counts[f"n{g}"], inner))
    return [cuts[i] for i in sorted(cuts)]


def quantised(docs: DataFrame, dims: tuple[str, ...], bits: int) -> list[Column]:
    """One expression for each dimension: its cell from 0 to 2**bits - 1, null in cell 0.

    Cut points are quantiles over all rows, so no dimension is sorted or
    collected: mergeable sketches for numbers, dates and timestamps,
    ``string_cuts`` for strings and binary values, which count by their bytes.
    """
    cells = 1 << bits
    kinds = dict(docs.dtypes)
    keys = {}
    for d in dims:
        if kinds[d] in ("string", "binary"):
            keys[d] = F.col(d).cast("binary")
        elif kinds[d] == "date":
            keys[d] = F.unix_date(d).cast("double")
        elif kinds[d] == "boolean":
            keys[d] = F.col(d).cast("int").cast("double")
        else:
            keys[d] = F.col(d).cast("double")
    shares = [(i + 1) / cells for i in range(cells - 1)]
    numbers = docs.agg(F.lit(0).alias("_"), *[F.percentile_approx(keys[d], shares, 10_000).alias(d) for d in dims if kinds[d] not in ("string", "binary")]).first()
    found = []
    for d in dims:
        cuts = [bytearray(c) for c in string_cuts(docs, d, cells)] if kinds[d] in ("string", "binary") else numbers[d] or []
        below = sum((F.when(keys[d] > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
        found.append(F.when(keys[d].isNotNull(), below).otherwise(0))
    return found


def hilbert_shards(
    docs: DataFrame,
    shards: int = 24,
    dims: tuple[str, ...] = ("source", "lang", "n_chars"),
    bits: int = 4,
    law: str = "rows",
    spread: int = 1024,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Cut all documents, in order of a Hilbert curve over ``dims``, into shards.

    Reads doc_id, text and ``dims``; other columns are ignored. Returns doc_id,
    size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32 (unsigned;
    null text: that of no bytes), law, shard, slot (gapless from 0 in each
    shard), grown_shard (null under both laws), hilbert and the columns that
    ``keep`` names. Law ``rows`` makes
    counts differ by at most one, ``bytes`` cuts where the running size passes
    a shard's share. Ties on the curve fall in order of a hash of the doc_id,
    then doc_id, checksum and size; repeated rows take neighbouring slots. An
    empty table gives an empty result.

    Every curve cell is split into ``spread`` hash parts, so a cell with a
    third of all rows is numbered by ``spread`` tasks; only the 2**(bits*dims)
    cells, a fixed number, pass through one task or a broadcast.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        hilbert_index(quantised(docs, dims, bits), bits).alias("hilbert"),
        F.pmod(F.xxhash64("doc_id"), F.lit(spread)).cast("int").alias("part"),
        *[F.struct(*keep).alias("_keep")] * bool(keep),
    )
    base = cut(base)
    parts = base.groupBy("hilbert", "part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    whole = parts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    rows, size = int(whole["n"] or 1), int(whole["b"] or 1)
    curve = Window.orderBy("hilbert")
    cells = parts.groupBy("hilbert").agg(F.sum("n").alias("cn"), F.sum("b").alias("cb"))
    cells = cells.select("hilbert", (F.sum("cn").over(curve) - F.col("cn")).alias("n0"), (F.sum("cb").over(curve) - F.col("cb")).alias("b0"))
    inside = Window.partitionBy("hilbert").orderBy("part")
    starts = parts.select("hilbert", "part", (F.sum("n").over(inside) - F.col("n")).alias("n1"), (F.sum("b").over(inside) - F.col("b")).alias("b1"))
    starts = starts.join(F.broadcast(cells), "hilbert").select("hilbert", "part", (F.col("n0") + F.col("n1")).alias("n"), (F.col("b0") + F.col("b1")).alias("b"))
    own = Window.partitionBy("hilbert", "part").orderBy("doc_id", "text_crc32", "size")
    placed = base.withColumn("nth", F.row_number().over(own) - 1)
    if law == "bytes":
        placed = placed.withColumn("sum", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.join(starts, ["hilbert", "part"]).withColumn("place", F.col("n") + F.col("nth"))
    if law == "rows":
        placed = placed.withColumn("shard", F.expr(f"place * {shards} div {rows}"))
        first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    else:
        middle = F.col("b") + F.coalesce("sum", F.lit(0)) + F.floor(F.col("size") / 2)
        placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle.cast("double") * shards / size)).cast("long"))
        firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
        placed, first = placed.join(F.broadcast(firsts), "shard"), F.col("first")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert",
        *["_keep.*"] * bool(keep),
    )


def shard_ranges(placed: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(shard, rows, and min_d and max_d for each dimension): one row for each shard of ``hilbert_shards(..., keep=dims)``."""
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)])


def shards_to_read(ranges: DataFrame, **within: tuple) -> DataFrame:
    """The shards that may hold rows with every named dimension in its closed interval; the others need not be opened."""
    for d, (low, high) in within.items():
        ranges = ranges.filter((F.col(f"max_{d}") >= F.lit(low)) & (F.col(f"min_{d}") <= F.lit(high)))
    return ranges.select("shard")
