"""Formula corpora: lexing, normalisation, vocabularies and their reduction."""

from __future__ import annotations

import tempfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import strip_all

# Delimiters that \left and \right attach to, spacing commands, special tokens with their ids.
DELIMITERS = ("(", ")", "[", "]", "|", ".", "/", "<", ">")
SPACINGS = (r"\,", r"\:", r"\;", r"\!", r"\ ", r"\quad", r"\qquad")
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>")
LEXER = r"\\[a-zA-Z]+|\\.|[a-zA-Z]|[0-9]|\S"


def lex(text: Column) -> Column:
    """LaTeX tokens: commands, escaped characters, letters, digits, other characters."""
    return F.regexp_extract_all(text, F.lit(LEXER), 0)


def split_commands(text: Column) -> Column:
    """Words split before each backslash; a double backslash stays whole and what stands before the first is dropped."""

    def one(word: Column) -> Column:
        parts = F.regexp_extract_all(word, F.lit(r"(\\\\|\\[^\\]*)"), 1)
        return F.when(word.contains("\\"), parts).otherwise(F.array(word))

    return F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda x: x != ""), one))


def substitute(tokens: Column, mapping: Column) -> Column:
    """Each token by the mapping, itself where it has no entry, nothing where the entry is empty."""
    return F.filter(F.transform(tokens, lambda t: F.coalesce(mapping[t], t)), lambda t: t != "")


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def modern_env(text: Column, commands: dict[str, str]) -> Column:
    """Old font switches, braced before or after, as modern commands with a brace."""
    pairs = [p for old, new in commands.items() for p in ((f"{{ {old} ", f"{new} {{ "), (f"{old} {{", f"{new} {{"))]
    return replace_all(text, pairs)


def without_spacing(text: Column) -> Column:
    return replace_all(text, [(f"{s} ", "") for s in SPACINGS])


def split_left_right(tokens: Column) -> Column:
    r"""``\left(`` and its like as two tokens."""
    pattern = r"^(\\left|\\right)([" + "".join(f"\\{d}" for d in DELIMITERS) + r"])$"
    one = lambda t: F.when(t.rlike(pattern), F.array(F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2))).otherwise(F.array(t))
    return F.flatten(F.transform(tokens, one))


def drop_scopes(commands: tuple[str, ...]):
    """A pandas UDF: remove the commands with their scope, braced (nesting counts) or the one next token."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(column: pd.Series) -> pd.Series:
        def one(tokens) -> list[str]:
            out, i, tokens = [], 0, list(tokens if tokens is not None else [])
            while i < len(tokens):
                if tokens[i] not in commands:
                    out.append(tokens[i])
                    i += 1
                    continue
                i += 1
                depth = 0
                while i < len(tokens):
                    depth += (tokens[i] == "{") - (tokens[i] == "}")
                    i += 1
                    if depth <= 0:
                        break
            return out

        return column.map(one)

    return run


@F.pandas_udf(T.StringType())
def without_nested_braces(column: pd.Series) -> pd.Series:
    """Groups that hold nothing but one other group lose a level."""

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        stack, match = [], {}
        for i, ch in enumerate(text):
            if ch == "{" and text[max(0, i - 1) : i] != "\\":
                stack.append(i)
            elif ch == "}" and text[max(0, i - 1) : i] != "\\" and stack:
                match[stack.pop()] = i
        gone = set()
        for a, b in match.items():
            inner = a + 1 + len(text[a + 1 : b]) - len(text[a + 1 : b].lstrip())
            if inner in match and not text[match[inner] + 1 : b].strip():
                gone |= {a, b}
        return "".join(ch for i, ch in enumerate(text) if i not in gone)

    return column.map(one)


def vocabulary(lines: DataFrame, text: str = "text") -> DataFrame:
    """(token, cnt, first_pos): counts of words, with where each appears first."""
    rows = lines.select("line_no", F.posexplode(F.split(strip_all(F.col(text)), r"\s+")).alias("pos", "token")).filter("token <> ''")
    return rows.groupBy("token").agg(F.count("*").alias("cnt"), F.min(F.struct("line_no", "pos")).alias("first_pos"))


def encode(tokens: Column, ids: Column) -> Column:
    """Word ids between begin and end marks, unknown words as 3."""
    inner = F.transform(tokens, lambda t: F.coalesce(ids[t], F.lit(3)))
    return F.concat(F.array(F.lit(0)), inner, F.array(F.lit(2)))


def fit_length(ids: Column, length: int, pad: int = 1) -> Column:
    """Cut or padded to ``length``."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def labels(ids: Column, pad: int = 1) -> Column:
    """Ids moved one to the left; padding counts -100."""
    moved = F.concat(F.slice(ids, 2, F.greatest(F.lit(0), F.size(ids) - 1)), F.array(F.lit(pad)))
    return F.transform(moved, lambda x: F.when(x == pad, F.lit(-100)).otherwise(x))


def settled(frame: DataFrame) -> DataFrame:
    """A checkpoint in the cluster's shared folder; where none is set (tests), in a temporary one."""
    spark = frame.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="foliant-"))
    return frame.checkpoint()


def kept_merges(merges: DataFrame, keep: DataFrame) -> DataFrame:
    """Merges (left, right, merged) needed for the tokens in ``keep``, parts of parts included, to a fixpoint.

    The frontier shrinks with every level and is at most the merge depth long;
    each level is one join on the merged token, whose lineage is cut.
    """
    found = merges.join(keep.select(F.col("token").alias("merged")).distinct(), "merged", "left_semi")
    total = found.count()
    while True:
        parts = found.select(F.explode(F.array("left", "right")).alias("merged")).union(found.select("merged")).distinct()
        found = settled(merges.join(parts, "merged", "left_semi"))
        grown = found.count()
        if grown == total:
            return found
        total = grown


def renumbered(kept: DataFrame) -> DataFrame:
    """(token, old_id, new_id): kept tokens numbered densely in order of their old ids."""
    from pyspark.sql import Window

    return kept.select("token", "old_id", (F.row_number().over(Window.orderBy("old_id")) - 1).alias("new_id"))


def length_batches(rows: DataFrame, length: str, batch: int, seed: int = 0) -> DataFrame:
    """Add ``batch``: rows of like length together, batches in an order fixed by the seed."""
    spread = rows.repartitionByRange(F.col(length)).sortWithinPartitions(length)
    part = F.spark_partition_id()
    return spread.withColumn("_n", F.monotonically_increasing_id()).withColumn("batch", F.xxhash64(part, F.floor(F.col("_n") / batch), F.lit(seed))).drop("_n")


def keep_set(listed: DataFrame, vocabulary: DataFrame, specials: DataFrame, added: DataFrame, alphabet: int = 0) -> DataFrame:
    """(token, old_id) that a reduced vocabulary keeps: listed tokens that it has, specials and its first ``alphabet`` ids, without added tokens, specials again."""
    known = vocabulary.join(listed.select("token").distinct(), "token", "left_semi").unionByName(vocabulary.filter(F.col("old_id") < alphabet))
    own = vocabulary.join(specials.select("token").distinct(), "token", "left_semi")
    return known.join(added.select("token"), "token", "left_anti").unionByName(own).distinct()


def unused_ids(used: DataFrame, size: int = 50_000) -> DataFrame:
    """(id,) of 0 to ``size`` - 1 that stand in no row of used(id)."""
    return used.sparkSession.range(size).join(used.select("id").distinct(), "id", "left_anti")


def without_unknown(rows: DataFrame, tokens: str, vocabulary: DataFrame) -> DataFrame:
    """Rows none of whose tokens the vocabulary lacks; only distinct tokens move, each with a digest of its row's tokens."""
    # hex and the count keep token lists apart whatever they hold
    spelt = F.array_join(F.transform(tokens, lambda t: F.hex(t.cast("string"))), ",", "-")
    keyed = rows.withColumn("_key", F.unhex(F.sha2(F.concat(F.size(tokens).cast("string"), F.lit(":"), spelt), 256)))
    bad = keyed.select("_key", F.explode(F.array_distinct(tokens)).alias("token")).join(vocabulary.select("token").distinct(), "token", "left_anti").select("_key").distinct()
    return keyed.join(bad, "_key", "left_anti").drop("_key")


def remapped(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """ids(key, pos, old_id) with new_id from mapping(old_id, new_id); null where there is none."""
    return ids.join(mapping.select("old_id", "new_id"), "old_id", "left")


def verified(ids: DataFrame, retokenised: DataFrame, mapping: DataFrame) -> DataFrame:
    """(key, same): whether a line's new ids are its old ones, mapped, place by place."""
    mapped = remapped(ids, mapping)
    both = mapped.join(retokenised.select("key", "pos", F.col("new_id").alias("own")), ["key", "pos"], "full")
    return both.groupBy("key").agg(F.bool_and(F.coalesce(F.col("new_id") == F.col("own"), F.lit(False))).alias("same"))


def normalised(text: Column, symbols: Column, commands: dict[str, str], expressions: list[tuple[str, str]]) -> Column:
    """Tokens of a formula after all rewriting steps that work on expressions: environments, expressions, spacings, then tokens split, mapped and parted."""
    whole = without_spacing(replace_all(modern_env(text, commands), expressions))
    return split_left_right(substitute(split_commands(whole), symbols))
