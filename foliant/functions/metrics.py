"""Edit distances, overlaps and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Blocks in which equal ends are measured.
BLOCKS = tuple(1 << k for k in range(30, -1, -1))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def common_start(a: Column, b: Column, shortest: Column) -> Column:
    """How many characters two texts share from the start; ``shortest`` is the shorter length."""

    def longer(at: Column, block: Column) -> Column:
        return F.when((at + block <= shortest) & (F.substring(a, at + 1, block) == F.substring(b, at + 1, block)), at + block).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, BLOCKS)), F.lit(0), longer)


def apart(a: Column, b: Column) -> Column:
    """Two texts without the start they share."""
    ends = lambda r, at: F.struct(F.substring(r["a"], at + 1, F.lit(2**31 - 1)).alias("a"), F.substring(r["b"], at + 1, F.lit(2**31 - 1)).alias("b"))
    whole = F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n"))
    return bound(whole, lambda r: bound(common_start(r["a"], r["b"], r["n"]), lambda at: ends(r, at)))


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; equal ends, which add nothing to it, are cut off first, as time and memory grow with the product of the lengths."""
    within = lambda r: bound(apart(F.reverse(r["a"]), F.reverse(r["b"])), lambda e: F.levenshtein(e["a"], e["b"]))
    return bound(apart(a, b), within)


def ned(pred: Column, gold: Column) -> Column:
    """Edit distance over the longer length; for an empty gold text 0 if nothing was predicted, else 1."""
    longest = F.greatest(F.length(pred), F.length(gold))
    return F.when(F.length(gold) == 0, F.when(F.length(pred) == 0, 0.0).otherwise(1.0)).otherwise(distance(pred, gold) / longest)


def folded(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", ""))


def folded_ned(a: Column, b: Column) -> Column:
    """The same over lower-case texts with white space collapsed; both empty 0, one empty 1."""
    x, y = folded(a), folded(b)
    return F.when((x == "") & (y == ""), 0.0).when((x == "") | (y == ""), 1.0).otherwise(F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


# Pairs of delimiters around a formula, in the order in which they are stripped.
DELIMITERS = ("$$", "$", r"\[", r"\]", r"\(", r"\)")


def strip_delimiters(text: Column) -> Column:
    """Without each delimiter in turn at the start and at the end, one independent of the other."""
    for d in DELIMITERS:
        mark = "".join(f"\\{c}" for c in d)
        text = F.regexp_replace(F.regexp_replace(text, f"^{mark}", ""), f"{mark}\\z", "")
    return text


def without_delimiters(text: Column) -> Column:
    """The same with white space collapsed."""
    return F.regexp_replace(F.regexp_replace(strip_delimiters(text), r"(?U)\s+", " "), r"^ | $", "")


def edr(pred: Column, gold: Column) -> Column:
    """Edit distance ratio of formulas; an empty gold formula counts 0 whatever was predicted."""
    x, y = without_delimiters(pred), without_delimiters(gold)
    return F.when(y == "", 0.0).otherwise(F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein over words divided by the longer count: each distinct word becomes one character."""
    x, y = words(a), words(b)
    names = F.array_distinct(F.concat(x, y))

    def coded(own: Column) -> Column:
        # private-use and supplementary planes: one code point a word
        points = F.transform(own, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(names, w) + 0x20000), 8, "0")), "UTF-32"))
        return F.array_join(points, "")

    longest = F.greatest(F.size(x), F.size(y))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(coded(x), coded(y)) / longest)


def jaccard(a: Column, b: Column) -> Column:
    """Over two token arrays as sets; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def corpus_bleu(pairs: DataFrame, pred: str = "pred", gold: str = "gold", order: int = 4) -> DataFrame:
    """One row: corpus BLEU of whitespace tokens with clipped counts; 0 where an order has no match.

    Counts are kept apart by a hash of the pair's texts; pairs that are equal
    may be counted together, as clipping then scales with their number.
    """
    tokens = pairs.select(F.xxhash64(pred, gold).alias("pair"), words(F.col(pred)).alias("p"), words(F.col(gold)).alias("g"))

    def grams(side: str) -> DataFrame:
        sizes = F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n")
        by = tokens.select("pair", F.col(side).alias("t"), sizes).filter("size(t) >= n")
        cut = F.transform(F.sequence(F.lit(1), F.size("t") - F.col("n") + 1), lambda i: F.array_join(F.slice("t", i, F.col("n")), "\x01"))
        return by.select("pair", "n", F.explode(cut).alias("gram"), F.lit(int(side == "p")).alias("in_p"), F.lit(int(side == "g")).alias("in_g"))

    counts = grams("p").unionByName(grams("g")).groupBy("pair", "n", "gram").agg(F.sum("in_p").alias("p"), F.sum("in_g").alias("g"))
    hits = counts.groupBy("n").agg(F.sum(F.least("p", "g")).alias("hit"), F.sum("p").alias("all")).filter("hit > 0")
    logs = hits.agg(F.count("*").alias("orders"), F.sum(F.log(F.col("hit") / F.col("all"))).alias("logs"), F.lit(1).alias("_k"))
    lengths = tokens.agg(F.sum(F.size("p")).alias("pl"), F.sum(F.size("g")).alias("gl"), F.lit(1).alias("_k"))
    brevity = F.when(F.col("pl") >= F.col("gl"), 1.0).otherwise(F.exp(1 - F.col("gl") / F.col("pl")))
    return logs.join(lengths, "_k").select(F.when(F.col("orders") == order, brevity * F.exp(F.col("logs") / order)).otherwise(0.0).alias("bleu"))


def latency_summary(samples: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, p90 (the element at int(0.9 n) of the sorted values, if there are two or more), total and count."""
    ordered = samples.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(value)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    p90 = F.max(F.when((F.col("_i") == F.floor(F.col("_n") * 0.9)) & (F.col("_n") > 1), F.col(value)))
    return ordered.groupBy(group).agg(
        F.round(F.avg(value), 6).alias("mean_s"), F.percentile(value, 0.5).alias("median_s"), p90.alias("p90_s"), F.round(F.sum(value), 4).alias("total_s"), F.count("*").alias("n")
    )


def entropy(symbols: DataFrame, group: str, symbol: str, states: int = 256) -> DataFrame:
    """Normalised Shannon entropy of each group's histogram, and how many states it takes."""
    counts = symbols.groupBy(group, symbol).agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy(group))
    return counts.withColumn("p", share).groupBy(group).agg((F.sum(-F.col("p") * F.log2("p")) / F.log2(F.lit(float(states)))).alias("entropy"), F.count("*").alias("occupied"))


def preferred(first: Column, second: Column) -> Column:
    """The first value unless it is null or 0."""
    return F.coalesce(F.nullif(first, F.lit(0.0)), second)


def attribute(scores: Column, name: str) -> Column:
    """Of a map of scores those under ``name: label``, by their labels."""
    start = f"{name}: "
    own = F.map_filter(scores, lambda k, v: k.startswith(start) & v.isNotNull())
    return F.transform_keys(own, lambda k, _: F.substring(k, len(start) + 1, 1 << 30))


def report_rows(results: DataFrame) -> DataFrame:
    """(element, attr, label, value, place) from (element, scores): keys ``attr: label`` in order of their values; totals are no rows."""
    rows = results.select("element", F.explode("scores").alias("key", "value")).filter(F.col("key").contains(": ") & F.col("value").isNotNull())
    parts = F.split("key", ": ", 2)
    named = rows.select("element", parts[0].alias("attr"), parts[1].alias("label"), "value")
    place = F.row_number().over(Window.partitionBy("element", "attr").orderBy("value", "label"))
    return named.withColumn("place", place.cast("long"))


def side_by_side(samples: DataFrame, row: str, column: str, value: str, conditions: list[str]) -> DataFrame:
    """One row for each page with its value under every condition."""
    return samples.groupBy(row).pivot(column, conditions).agg(F.max(value))


def mean_of_batches(samples: DataFrame, group: str, batch: str, value: str) -> DataFrame:
    """(group, mean_of_batches): the mean of the batches' means, whatever their sizes."""
    return samples.groupBy(group, batch).agg(F.avg(value).alias("_m")).groupBy(group).agg(F.avg("_m").alias("mean_of_batches"))


def warm_summary(samples: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """(group, warm_mean, peak, speedup, reduction): the mean without each group's first sample, compared with the plain mean and the peak."""
    ordered = samples.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    by = ordered.groupBy(group).agg(F.avg(F.when(F.col("_i") > 1, F.col(value))).alias("warm"), F.avg(value).alias("every"), F.max(value).alias("peak"))
    return by.select(group, F.round("warm", 6).alias("warm_mean"), "peak", F.round(F.col("every") / F.col("warm"), 6).alias("speedup"), F.round((1 - F.col("warm") / F.col("peak")) * 100, 6).alias("reduction"))


def setting_summary(rows: DataFrame, setting: str, score: str, pred: str) -> DataFrame:
    """(setting, mean_edr, empty, n) of a sweep's results."""
    return rows.groupBy(setting).agg(F.avg(score).alias("mean_edr"), F.count_if(F.col(pred) == "").alias("empty"), F.count("*").alias("n"))
