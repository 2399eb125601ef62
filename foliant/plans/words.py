"""Queries over texts, formulas and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import corpus, latex, markdown, metrics, text
from ..sources import tables as S
from .registry import TURNS_SQL, query, table, turns

_ASCII = r"regexp_full_match(text, '[\x00-\x7F]*')"
_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


@query(
    TURNS_SQL
    + r""", n AS (SELECT plain AS p, next AS g, row_number() OVER () AS id FROM turns WHERE next IS NOT NULL),
  w AS (SELECT id, list_filter(regexp_split_to_array(p, '\s+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(g, '\s+'), lambda x: x <> '') AS g FROM n),
  k AS (SELECT unnest([1, 2, 3, 4]) AS n), a AS (SELECT id, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], chr(1)))) AS gram FROM w, k WHERE len(p) >= n),
  b AS (SELECT id, n, unnest(list_transform(range(1, len(g) - n + 2), lambda i: array_to_string(g[i:i + n - 1], chr(1)))) AS gram FROM w, k WHERE len(g) >= n),
  ca AS (SELECT id, n, gram, count(*) AS c FROM a GROUP BY ALL), cb AS (SELECT id, n, gram, count(*) AS c FROM b GROUP BY ALL),
  h AS (SELECT ca.n, sum(least(ca.c, coalesce(cb.c, 0))) AS hit, sum(ca.c) AS every FROM ca LEFT JOIN cb USING (id, n, gram) GROUP BY ca.n), l AS (SELECT sum(len(p)) AS pl, sum(len(g)) AS gl FROM w)
  SELECT round(CASE WHEN (SELECT count(*) FROM h WHERE hit > 0) = 4 THEN (SELECT exp(sum(ln(hit / CAST(every AS DOUBLE))) / 4) FROM h) * CASE WHEN pl >= gl THEN 1e0 ELSE exp(1 - gl / CAST(pl AS DOUBLE)) END ELSE 0e0 END, 6) AS bleu FROM l"""
)
def corpus_bleu(spark, sf_dir):
    return metrics.corpus_bleu(turns(spark, sf_dir), "plain", "next").select(F.round("bleu", 6).alias("bleu"))


_BULLET = text.BULLET_START.replace("'", "''")


@query(
    rf"""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn, role, text) AS id FROM conversations), l AS (SELECT id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, {_STRIP("unnest(string_split(text, chr(10)))")} AS line FROM t),
  s AS (SELECT id, i, line, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM l WHERE line <> ''), g AS (SELECT *, sum(CASE WHEN k = 1 OR regexp_matches(line, '{_BULLET}') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS grp FROM s),
  items AS (SELECT id, grp, string_agg(line, ' ' ORDER BY i) AS item FROM g GROUP BY id, grp), many AS (SELECT id FROM items GROUP BY id HAVING count(*) > 1),
  parts AS (SELECT id, unnest(string_split(regexp_replace(text, '(\bModel\s+[A-D][\s:\-.])', chr(1) || '\1', 'g'), chr(1))) AS part FROM t WHERE id NOT IN (SELECT id FROM many)),
  every AS (SELECT id, item FROM items WHERE id IN (SELECT id FROM many) UNION ALL SELECT id, {_STRIP("part")} FROM parts WHERE {_STRIP("part")} <> '')
  SELECT t.conv_id, t.turn, e.item, count(*) AS n FROM every e JOIN t USING (id) GROUP BY ALL"""
)
def bullet_items(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.bullet_items(F.col("text"))).alias("item"))
    return rows.groupBy("conv_id", "turn", "item").agg(F.count("*").alias("n"))


def _words(spark, sf_dir) -> DataFrame:
    """doc_id with the lower-case ASCII words of three letters or more, two of them at least."""
    found = F.regexp_extract_all("text", F.lit("[a-z]{3,}"), 0)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", found.alias("w")).filter("size(w) >= 2").select("doc_id", "lang", "source", F.col("w")[0].alias("a"), F.col("w")[1].alias("b"))


_W = "WITH w AS (SELECT doc_id, lang, source, regexp_extract_all(text, '[a-z]{3,}') AS ws FROM documents), d AS (SELECT doc_id, lang, source, ws[1] AS a, ws[2] AS b FROM w WHERE len(ws) >= 2) "


@query(_W + "SELECT doc_id, 'IV. ' || upper(a) || '|' || 'A. ' || upper(b) AS headers, 'Q. ' || upper(a) AS label FROM d")
def section_headers(spark, sf_dir):
    """Headings read as one come apart before their labels; a letter run into a heading gets its full stop."""
    both = F.concat(F.lit("IV. "), F.upper("a"), F.lit(" A. "), F.upper("b"))
    return _words(spark, sf_dir).select("doc_id", F.array_join(text.section_headers(both), "|").alias("headers"), text.section_label(F.concat(F.lit("Q"), F.upper("a"))).alias("label"))


@query(
    _W
    + r"""SELECT doc_id, '\uparrow ' || repeat('{', x) || a || CASE WHEN y >= x THEN repeat('}', x) || ' ~ z' ELSE repeat('}', y) || ' ~ z' || repeat('}', x - y) END || CASE WHEN doc_id % 2 = 0 THEN '\right.' ELSE '' END AS tex
  FROM (SELECT *, CAST(doc_id % 3 AS INT) AS x, CAST(doc_id % 4 AS INT) AS y FROM d) WHERE doc_id % 2 <> 0
  UNION ALL SELECT doc_id, '\uparrow ' || '\left( ' || repeat('{', x) || a || CASE WHEN y >= x THEN repeat('}', x) || ' ~ z' ELSE repeat('}', y) || ' ~ z' || repeat('}', x - y) END || '\right.' AS tex
  FROM (SELECT *, CAST(doc_id % 3 AS INT) AS x, CAST(doc_id % 4 AS INT) AS y FROM d) WHERE doc_id % 2 = 0"""
)
def formula_sanitize(spark, sf_dir):
    """Arrows written out, loops collapsed, braces and left delimiters balanced."""
    raw = F.concat(F.lit("\\Uarr "), F.when(F.col("doc_id") % 2 == 0, "\\left( ").otherwise(""), F.expr("repeat('{', cast(doc_id % 3 as int))"), F.col("a"), F.expr("repeat('}', cast(doc_id % 4 as int))"), F.lit(" " + "~" * 12 + "z"))
    return _words(spark, sf_dir).select("doc_id", latex.sanitize(raw).alias("tex"))


@query(
    _W
    + r"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN length(a) * 400 <= 800 ELSE true END AS sound,
    CASE doc_id % 6 WHEN 0 THEN a WHEN 4 THEN CASE WHEN length(a) * 400 <= 800 THEN repeat(a, 400) ELSE a || ' \\ ' || b END WHEN 5 THEN a || ' = ' || b ELSE a || ' \\ ' || b END AS tex FROM d"""
)
def formula_gate(spark, sf_dir):
    """Whether readings are sound, and the first sound one of the whole crop, its rows and its columns."""
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, F.col("a")).when(k == 1, "").when(k == 2, "~" * 12).when(k == 3, "\\hline " * 5).when(k == 4, F.repeat("a", F.lit(400))).otherwise(F.concat("a", F.lit(" = "), "b"))
    size = (F.lit(10.0), F.lit(10.0))
    first = latex.fallback_formula(raw, F.array("a", "b"), F.array("b", "a"), *size, F.lit("formula_001.png"))
    return _words(spark, sf_dir).select("doc_id", latex.passes_gate(raw, *size).alias("sound"), first.alias("tex"))


@query(_W + "SELECT doc_id, a AS bare, CASE doc_id % 5 WHEN 4 THEN a || ' ' || b ELSE a || '   ' || b END AS half FROM d WHERE doc_id % 5 <> 4 UNION ALL SELECT doc_id, a, a || ' ' || b FROM d WHERE doc_id % 5 = 4")
def formula_delimiters(spark, sf_dir):
    """Delimiters go from both ends, each on its own; then white space collapses."""
    k = F.col("doc_id") % 5
    around = [("$$", "$$"), ("$", "$"), ("\\[", "\\]"), ("\\(", "\\)")]
    wrapped = F.coalesce(*[F.when(k == i, F.concat(F.lit(x), F.col("a"), F.lit(y))) for i, (x, y) in enumerate(around)], F.concat(F.lit("$$"), F.col("a")))
    spaced = F.concat(F.lit("\\["), F.col("a"), F.lit("   "), F.col("b"))
    return _words(spark, sf_dir).select("doc_id", metrics.strip_delimiters(wrapped).alias("bare"), F.when(k == 4, metrics.without_delimiters(spaced)).otherwise(metrics.strip_delimiters(spaced)).alias("half"))


_COLLAPSE = lambda c: rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^ | $', '', 'g')"
_NO_MARKS = "plain, next"


def _undelimited(c: str) -> str:
    for d in metrics.DELIMITERS:
        mark = "".join(f"\\{x}" for x in d)
        c = f"regexp_replace(regexp_replace({c}, '^{mark}', ''), '{mark}$', '')"
    return _COLLAPSE(c)


@query(
    TURNS_SQL
    + f""", p AS (SELECT role, {_undelimited('plain')} AS x, {_undelimited('next')} AS y, lower({_COLLAPSE('plain')}) AS a, lower({_COLLAPSE('next')}) AS b FROM turns WHERE next IS NOT NULL)
  SELECT role, round(avg(CASE WHEN y = '' THEN 0e0 ELSE levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE) END), 6) AS edr,
    round(avg(CASE WHEN a = '' AND b = '' THEN 0e0 WHEN a = '' OR b = '' THEN 1e0 ELSE levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END), 6) AS folded, round(avg(CASE WHEN x = y THEN 1e0 ELSE 0e0 END) * 100, 6) AS exact, count(*) AS n FROM p GROUP BY role"""
)
def formula_distances(spark, sf_dir):
    """Edit-distance ratios without delimiters, folded distances and exact matches of consecutive turns."""
    x, y = (metrics.without_delimiters(F.col(c)) for c in ("plain", "next"))
    rows = turns(spark, sf_dir).select("role", metrics.edr(F.col("plain"), F.col("next")).alias("e"), metrics.folded_ned(F.col("plain"), F.col("next")).alias("f"), (x == y).cast("double").alias("same"))
    return rows.groupBy("role").agg(F.round(F.avg("e"), 6).alias("edr"), F.round(F.avg("f"), 6).alias("folded"), F.round(F.avg("same") * 100, 6).alias("exact"), F.count("*").alias("n"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\\[a-zA-Z]+|\\.|[a-zA-Z]|[0-9]|\S')) AS n_tokens, len(regexp_extract_all('\frac{' || text || '}', '\\[a-zA-Z]+|\\.|[a-zA-Z]|[0-9]|\S')) AS n_wrapped FROM documents")
def lex_counts(spark, sf_dir):
    wrapped = F.concat(F.lit("\\frac{"), F.col("text"), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(corpus.lex(F.col("text"))).cast("long").alias("n_tokens"), F.size(corpus.lex(wrapped)).cast("long").alias("n_wrapped"))


@query(_W + r"SELECT doc_id, '\left ( ' || a || ' \right ) \mathrm { ' || b || ' } \frac \beta ^ { \prime } ' || CASE WHEN a = 'the' THEN 'THE' ELSE a END AS tokens FROM d")
def formula_normalise(spark, sf_dir):
    """Environments, expressions, spacings, command splits, symbols and delimiters of formula lines, one after the other."""
    line = F.concat(F.lit("\\left( "), F.col("a"), F.lit(" \\right) \\, { \\rm "), F.col("b"), F.lit(" } \\frac\\alpha '' "), F.when(F.col("a") == "the", "\\the").otherwise(F.col("a")))
    symbols = F.create_map(*[F.lit(x) for x in ("\\alpha", "\\beta", "\\the", "THE")])
    got = corpus.normalised(line, symbols, {"\\rm": "\\mathrm"}, [("''", "^ { \\prime }")])
    return _words(spark, sf_dir).select("doc_id", F.array_join(got, " ").alias("tokens"))


@query(_W + r"SELECT doc_id, a || ' c' AS scoped, '{' || a || '} {' || b || '}' AS flat FROM d")
def formula_scopes(spark, sf_dir):
    """Phantoms go with their scope; groups that hold only a group lose a level."""
    rows = _words(spark, sf_dir)
    tokens = F.array(F.col("a"), F.lit("\\phantom"), F.lit("{"), F.lit("{"), F.col("b"), F.lit("}"), F.lit("x"), F.lit("}"), F.lit("c"), F.lit("\\phantom"), F.col("b"))
    nested = F.concat(F.lit("{{"), F.col("a"), F.lit("}} {"), F.col("b"), F.lit("}"))
    return rows.select("doc_id", F.array_join(corpus.drop_scopes(("\\phantom",))(tokens), " ").alias("scoped"), corpus.without_nested_braces(nested).alias("flat"))


_IDS = "CASE {0} WHEN 'en' THEN '4' WHEN 'fr' THEN '5' WHEN 'de' THEN '6' ELSE '3' END"


@query(f"SELECT doc_id, '0,' || {_IDS.format('lang')} || ',3,' || {_IDS.format('lang')} || ',2,1,1' AS ids, {_IDS.format('lang')} || ',3,' || {_IDS.format('lang')} || ',2,-100,-100,-100' AS labels, '0,' || {_IDS.format('lang')} || ',3' AS cut, CAST(4 AS BIGINT) AS label_length FROM documents")
def encode_labels(spark, sf_dir):
    """Word ids between marks, unknown words as 3, padded or cut; labels are moved by one, padding counts -100."""
    tokens = F.array("lang", "source", "lang")
    ids = corpus.encode(tokens, F.create_map(*[F.lit(x) for x in ("en", 4, "fr", 5, "de", 6)]))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("i"), (F.size(tokens) + 1).cast("long").alias("label_length"))
    return rows.select("doc_id", joined(corpus.fit_length(F.col("i"), 7)).alias("ids"), joined(corpus.labels(corpus.fit_length(F.col("i"), 7))).alias("labels"), joined(corpus.fit_length(F.col("i"), 3)).alias("cut"), "label_length")


_COMMON = "c AS (SELECT token FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY token HAVING count(*) >= 2)"


@query(f"WITH {_COMMON}, t AS (SELECT conv_id, turn, role, text, unnest(string_split(text, ' ')) AS token FROM conversations) SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn, role, text) NOT IN (SELECT conv_id, turn, role, text FROM t WHERE token NOT IN (SELECT token FROM c))")
def known_rows(spark, sf_dir):
    """Turns all of whose words the documents have twice."""
    vocabulary = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("n")).filter("n >= 2")
    rows = table(spark, sf_dir, "conversations").withColumn("words", F.split("text", " "))
    return corpus.without_unknown(rows, "words", vocabulary).select("conv_id", "turn", "role")


@query(
    """WITH l AS (SELECT doc_id, text FROM documents), t AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS token FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM l)),
  g AS (SELECT token, count(*) AS cnt, min((doc_id, pos)) AS first FROM t WHERE token <> '' AND NOT regexp_matches(token, '\\s') GROUP BY token) SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, first) AS rank FROM g"""
)
def vocab_by_appearance(spark, sf_dir):
    """Words by count, those of equal counts by where they appear first."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.posexplode(F.split("text", " ")).alias("pos", "token")).filter(r"token <> '' and not token rlike '\\s'")
    found = rows.groupBy("token").agg(F.count("*").alias("cnt"), F.min(F.struct("line_no", "pos")).alias("first_pos"))
    rank = F.row_number().over(Window.orderBy(F.col("cnt").desc(), "first_pos"))
    return found.select("token", "cnt", rank.cast("long").alias("rank"))


def _vocabulary(spark, sf_dir) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{2,}"), 0)).alias("token")).distinct()
    return words.select("token", (F.row_number().over(Window.orderBy("token")) - 1).cast("long").alias("old_id"))


_VOCAB = "WITH RECURSIVE v AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY token) - 1 AS old_id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{2,}')) AS token FROM benchmark))"
_KEEP = _VOCAB + ", listed AS (SELECT token FROM v WHERE length(token) % 3 = 0), k AS MATERIALIZED (SELECT DISTINCT token, old_id FROM v WHERE ((token IN (SELECT token FROM listed) OR old_id < 5) AND old_id % 7 <> 3) OR old_id % 50 = 3)"


@query(_KEEP + " SELECT token, old_id, row_number() OVER (ORDER BY old_id) - 1 AS new_id FROM k")
def kept_vocabulary(spark, sf_dir):
    """The tokens a reduced vocabulary keeps, numbered anew in order of their ids."""
    return corpus.renumbered(_kept(spark, sf_dir)).select("token", "old_id", F.col("new_id").cast("long").alias("new_id"))


def _kept(spark, sf_dir) -> DataFrame:
    every = _vocabulary(spark, sf_dir)
    listed = every.filter("length(token) % 3 = 0").select("token")
    return corpus.keep_set(listed, every, every.filter("old_id % 50 = 3"), every.filter("old_id % 7 = 3"), alphabet=5)


@query(_KEEP + ", p AS (SELECT DISTINCT token[1:n] AS merged FROM (SELECT token, unnest(range(2, length(token) + 1)) AS n FROM k)) SELECT merged[1:length(merged) - 1] AS left_part, merged[length(merged):length(merged)] AS right_part, merged FROM p")
def kept_merges(spark, sf_dir):
    """The merges that reach the kept tokens, parts of parts included."""
    prefixes = _vocabulary(spark, sf_dir).select(F.explode(F.transform(F.sequence(F.lit(2), F.length("token")), lambda n: F.left("token", n))).alias("merged")).distinct()
    merges = prefixes.select(F.expr("left(merged, length(merged) - 1)").alias("left"), F.right("merged", F.lit(1)).alias("right"), "merged")
    found = corpus.kept_merges(merges, _kept(spark, sf_dir))
    return found.select(F.col("left").alias("left_part"), F.col("right").alias("right_part"), "merged").distinct()


@query(_KEEP + " SELECT CAST(i AS BIGINT) AS id FROM range(0, 2000) t(i) WHERE i NOT IN (SELECT old_id FROM k)")
def unused_ids(spark, sf_dir):
    return corpus.unused_ids(_kept(spark, sf_dir).select(F.col("old_id").alias("id")), 2_000)


@query(
    _KEEP
    + """, t AS (SELECT item_id AS key, unnest(range(0, len(ws))) AS pos, unnest(ws) AS token FROM (SELECT item_id, regexp_extract_all(text, '[a-z]{2,}') AS ws FROM benchmark))
  SELECT key, CAST(count(*) FILTER (token IN (SELECT token FROM k)) AS BIGINT) AS kept, count(*) = count(*) FILTER (token IN (SELECT token FROM k)) AS same FROM t GROUP BY key"""
)
def remap_verified(spark, sf_dir):
    """Whether each line's tokens, mapped to new ids, are what the reduced vocabulary gives."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]{2,}"), 0)).alias("pos", "token"))
    mapping = corpus.renumbered(_kept(spark, sf_dir))
    ids = words.join(_vocabulary(spark, sf_dir), "token").select("key", "pos", "old_id")
    own = words.join(mapping, "token").select("key", "pos", "new_id")
    counts = own.groupBy("key").agg(F.count("*").alias("kept"))
    return corpus.verified(ids, own, mapping).join(counts, "key", "left").select("key", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"), "same")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id || '|' || source), doc_id, source) AS place FROM documents")
def seeded_shuffle(spark, sf_dir):
    """Documents in an order that their keys and a seed fix."""
    rows = S.shuffled(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id", "source"], 7)
    order = F.md5(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string"), "source").cast("binary"))
    return rows.select("doc_id", F.row_number().over(Window.orderBy(order, "doc_id", "source")).cast("long").alias("place"))


@query("SELECT doc_id, source, CAST(nth AS BIGINT) AS nth, CAST((nth - 1) // 8 AS BIGINT) AS chunk, CASE WHEN nth <= (n + 1) // 2 THEN 0 ELSE 1 END AS half FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def chunks_and_halves(spark, sf_dir):
    """Rows of each source in chunks of eight and in two halves."""
    w = Window.partitionBy("source")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(w.orderBy("doc_id")).cast("long").alias("nth"), F.count("*").over(w).alias("n"))
    return rows.select("doc_id", "source", "nth", F.floor((F.col("nth") - 1) / 8).cast("long").alias("chunk"), F.when(F.col("nth") <= F.floor((F.col("n") + 1) / 2), 0).otherwise(1).alias("half"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) BETWEEN 2 AND 4")
def head_sample(spark, sf_dir):
    """The three rows of each source after its first one: a sample after a warm-up, as its feature."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", nth.alias("nth")).filter("nth between 2 and 4").select("doc_id", "source")


_GLYPHS = "repeat(chr(20013), CAST(doc_id % 5 AS INT))"


@query(
    rf"""WITH t AS (SELECT source, {_GLYPHS} || text AS t FROM documents) SELECT source, CAST(sum(len(regexp_replace(t, '\s', '', 'g'))) AS BIGINT) AS visible, CAST(sum(len(regexp_extract_all(t, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}]'))) AS BIGINT) AS cjk,
    count(*) FILTER (len(regexp_extract_all(t, '[\x{{4E00}}-\x{{9FFF}}]')) > 0) AS pages_with FROM t GROUP BY source"""
)
def probe_totals(spark, sf_dir):
    """Visible characters, CJK characters and pages that have some, by source."""
    glyphs = F.expr("repeat('中', cast(doc_id % 5 as int))")
    rows = table(spark, sf_dir, "documents").select("source", F.concat(glyphs, F.col("text")).alias("t"))
    cjk = text.cjk_count(F.col("t"))
    return rows.groupBy("source").agg(F.sum(F.length(F.regexp_replace("t", r"\s", ""))).cast("long").alias("visible"), F.sum(cjk).alias("cjk"), F.count_if(cjk > 0).alias("pages_with"))


def _escaped(c: str) -> str:
    for a, b in text.ESCAPES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"SELECT doc_id, CASE WHEN length({_escaped('text')}) >= length(replace(text || {_GLYPHS}, chr(10), '')) THEN {_escaped('text')} ELSE replace(text || {_GLYPHS}, chr(10), '') END AS best FROM documents")
def dual_reading(spark, sf_dir):
    """Of two engines' readings the longer one, after escaping and joining."""
    glyphs = F.expr("repeat('中', cast(doc_id % 5 as int))")
    best = text.better_reading(text.escape_latex(F.col("text")), text.join_cjk(F.concat(F.col("text"), glyphs)))
    return table(spark, sf_dir, "documents").select("doc_id", best.alias("best"))


@query(
    _W
    + r"""SELECT doc_id, CASE WHEN length(a || ' ' || b) > 12 THEN (a || ' ' || b)[1:9] || '...' ELSE a || ' ' || b END AS short, '\documentclass{article}' || chr(10) || '\usepackage{amsmath}' || chr(10) || '\begin{document}' || chr(10) || '\[' || chr(10) || a || chr(10) || '\]' || chr(10) || '\end{document}' || chr(10) AS page,
    CASE doc_id % 3 WHEN 0 THEN a WHEN 1 THEN b ELSE '' END AS reading, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 1000 AS DOUBLE) / 4 END AS seconds FROM d"""
)
def previews_and_probes(spark, sf_dir):
    """Previews, one-formula documents, texts out of a model's JSON and seconds out of log lines."""
    k = F.col("doc_id") % 3
    result = F.when(k == 0, F.to_json(F.struct(F.col("a").alias("rec_formula")))).when(k == 1, F.to_json(F.struct(F.struct(F.col("b").alias("rec_formula")).alias("res")))).otherwise("{}")
    quarter = F.format_string("%.2f", (F.col("doc_id") % 1000) / 4)
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("page done in "), quarter, F.lit("s"))).otherwise("still at it")
    rows = _words(spark, sf_dir)
    return rows.select("doc_id", text.shortened(F.concat_ws(" ", "a", "b"), 12).alias("short"), latex.formula_page(F.col("a")).alias("page"), text.reading_of(result).alias("reading"), text.seconds_from_log(line).alias("seconds"))


@query(_W + r"SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN a || ' ' || b ELSE a || ' = ' || b END AS tex FROM d")
def full_page_formulas(spark, sf_dir):
    """Formulas out of full-page readings: environments, display marks, equation numbers and leading prose go."""
    k, eq = F.col("doc_id") % 5, F.concat(F.col("a"), F.lit(" = "), F.col("b"))
    raw = (
        F.when(k == 0, F.concat(F.lit("see\n\\begin{align*}\n"), eq, F.lit("\n\\end{align*} (2)")))
        .when(k == 1, F.concat(F.lit(" \\["), eq, F.lit("\\] (3)")))
        .when(k == 2, F.concat(F.lit("$$"), eq, F.lit("$$\n(4)")))
        .when(k == 3, F.concat(F.lit("as we saw\nbefore\n"), eq, F.lit("\n  (1)  ")))
        .otherwise(F.concat(F.col("a"), F.lit(" "), F.col("b")))
    )
    return _words(spark, sf_dir).select("doc_id", latex.formula_of_page_reading(raw).alias("tex"))


@query(
    _W
    + r"""SELECT doc_id, '# ' || a || chr(10) || chr(10) || '## ' || b || chr(10) || chr(10) || '**' || a || '** 5% of *' || b || '*' || chr(10) || chr(10) || '- ' || a || chr(10) || '- ' || b || chr(10) || chr(10)
    || '<table border="1"><tr><td>' || a || '</td><td>' || b || '</td></tr><tr><td>x</td><td></td></tr></table>' || chr(10) || chr(10) || '\[' || chr(10) || a || ' = 1' || chr(10) || '\]' AS md FROM d"""
)
def latex_markdown(spark, sf_dir):
    """LaTeX pages as Markdown: title, heading, emphasis, list, table, display mathematics; notes, comments and figures go."""
    parts = [
        "\\documentclass{article}\n\\begin{document}\n\\sloppy\n\\begin{center}\n\\textbf{\\large ", "a", "}\n\\end{center}\n\n\\subsection*{", "b", "}\n\n\\textbf{", "a", "} 5\\% of \\textit{", "b", "}\\footnote{gone} % note\n\n\\begin{itemize}\n\\item ", "a",
        "\n\\item ", "b", "\n\\end{itemize}\n\\begin{tabular}{ll}\n\\hline\n", "a", " & \\textit{", "b", "} \\\\\nx & \\\\\n\\hline\n\\end{tabular}\n\\includegraphics[width=1cm]{f}\n\\begin{equation}\n", "a", " = 1\n\\end{equation}\n\\end{document}\n",
    ]
    tex: list[Column] = [F.col(p) if p in ("a", "b") else F.lit(p) for p in parts]
    return _words(spark, sf_dir).select("doc_id", markdown.markdown(F.concat(*tex)).alias("md"))
