"""Registered queries over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import detections as D
from ..operators import layout as L
from . import pages, pictures, scores, words  # noqa: F401  each registers its queries
from .fixture import HEIGHT, SQL, WIDTH, detections
from .registry import AREA as _AREA
from .registry import BOTH as _BOTH
from .registry import CONFIDENT as _CONFIDENT
from .registry import ORACLES, QUERIES, TURNS_SQL, query, turns
from .registry import good as _good
from .registry import table as _table

__all__ = ["ORACLES", "QUERIES"]

@query(SQL + "SELECT * FROM dets WHERE confidence >= 0.3")
def conf_filter(spark, sf_dir):
    return _good(spark, sf_dir)


@query(SQL + f"SELECT * FROM dets WHERE NOT (class_name IN ('Section-header', 'Page-header') AND y2 <= 0.12 * {HEIGHT})")
def header_suppress(spark, sf_dir):
    return D.without_headers(detections(spark, sf_dir), HEIGHT)


@query(
    SQL + f"SELECT page_id, det_id, class_name, confidence, greatest(0e0, x1 - 2) AS x1, greatest(0e0, y1 - 2) AS y1, least({WIDTH}e0, x2 + 2) AS x2, least({HEIGHT}e0, y2 + 2) AS y2 FROM dets"
)
def pad_clamp(spark, sf_dir):
    return D.padded(detections(spark, sf_dir), 2, WIDTH, HEIGHT)


@query(
    SQL
    + "SELECT page_id, CASE WHEN class_name = 'Formula' THEN 'math' WHEN class_name = 'Table' THEN 'table' WHEN class_name = 'Picture' THEN 'image' ELSE 'text' END AS route, "
    "count(*) AS n FROM dets GROUP BY ALL"
)
def route_counts(spark, sf_dir):
    return D.routed(detections(spark, sf_dir)).groupBy("page_id", "route").agg(F.count("*").alias("n"))


@query(
    _CONFIDENT
    + f", p AS (SELECT a.page_id, a.det_id AS a_id, b.det_id AS b_id, {_BOTH} AS both_, {_AREA.format('a.')} + {_AREA.format('b.')} AS sum_ "
    "FROM good a JOIN good b ON a.page_id = b.page_id AND a.class_name = b.class_name AND a.det_id < b.det_id) "
    "SELECT page_id, a_id, b_id, round(both_ / (sum_ - both_), 6) AS iou FROM p WHERE both_ / (sum_ - both_) >= 0.4"
)
def iou_pairs(spark, sf_dir):
    found = D.pairs(_good(spark, sf_dir), same_class=True).filter(F.col("iou") >= D.NMS_IOU)
    return found.select("page_id", F.col("det_id").alias("a_id"), F.col("det_id_b").alias("b_id"), F.round("iou", 6).alias("iou"))


@query(
    _CONFIDENT
    + f", p AS (SELECT a.page_id, a.det_id AS a_id, b.det_id AS b_id, {_BOTH} AS both_, {_AREA.format('a.')} AS aa, {_AREA.format('b.')} AS ab "
    "FROM good a JOIN good b ON a.page_id = b.page_id AND a.class_name <> b.class_name AND a.det_id < b.det_id) "
    "SELECT page_id, a_id, b_id, round(both_ / aa, 6) AS a_in_b, round(both_ / ab, 6) AS b_in_a FROM p WHERE greatest(both_ / aa, both_ / ab) >= 0.8"
)
def containment_pairs(spark, sf_dir):
    found = D.pairs(_good(spark, sf_dir), same_class=False).filter(F.greatest("a_in_b", "b_in_a") >= D.CONTAINED)
    return found.select("page_id", F.col("det_id").alias("a_id"), F.col("det_id_b").alias("b_id"), F.round("a_in_b", 6).alias("a_in_b"), F.round("b_in_a", 6).alias("b_in_a"))


_PARENT = """, near AS (
  SELECT c.page_id, c.det_id, p.det_id AS parent_id, least(abs(c.y1 - p.y2), abs(c.y2 - p.y1)) AS dist, least(c.x2, p.x2) - greatest(c.x1, p.x1) AS beside
  FROM good c JOIN good p ON c.page_id = p.page_id AND c.class_name = 'Caption' AND p.class_name IN ('Picture', 'Table')
), parents AS (
  SELECT page_id, det_id, parent_id, dist FROM near WHERE dist < 150 AND (beside > 0 OR dist < 50)
  QUALIFY row_number() OVER (PARTITION BY page_id, det_id ORDER BY dist, parent_id) = 1
) """


@query(_CONFIDENT + _PARENT + "SELECT * FROM parents")
def caption_parent(spark, sf_dir):
    return L.caption_parents(_good(spark, sf_dir))


@query(
    _CONFIDENT
    + """, good2 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, det_id) AS ord FROM good), near AS (
  SELECT c.page_id, c.det_id, p.ord AS pord, least(abs(c.y1 - p.y2), abs(c.y2 - p.y1)) AS dist, least(c.x2, p.x2) - greatest(c.x1, p.x1) AS beside
  FROM good2 c JOIN good2 p ON c.page_id = p.page_id AND c.class_name = 'Caption' AND p.class_name IN ('Picture', 'Table')
), parents AS (
  SELECT page_id, det_id, pord FROM near WHERE dist < 150 AND (beside > 0 OR dist < 50)
  QUALIFY row_number() OVER (PARTITION BY page_id, det_id ORDER BY dist, pord) = 1
)
SELECT g.page_id, g.det_id, g.class_name, CAST(row_number() OVER (
  PARTITION BY g.page_id ORDER BY CASE WHEN class_name = 'Footnote' THEN 1 ELSE 0 END, greatest(ord, coalesce(pord, ord)), CASE WHEN coalesce(pord, ord) > ord THEN 1 ELSE 0 END, ord) AS BIGINT) AS reading
FROM good2 g LEFT JOIN parents p ON g.page_id = p.page_id AND g.det_id = p.det_id"""
)
def reading_order_simple(spark, sf_dir):
    """Reading order over the plain index (y1, x1, det_id)."""
    rows = _good(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("y1", "x1", "det_id")))
    return L.reading_order(rows, "ord").select("page_id", "det_id", "class_name", "reading")


@query(
    _CONFIDENT
    + f""" SELECT page_id, det_id, CASE WHEN x2 - x1 >= 0.7e0 * {WIDTH} OR (x1 < {WIDTH} / 2 - 0.2e0 * {WIDTH} AND x2 > {WIDTH} / 2 + 0.2e0 * {WIDTH}) THEN 'full'
  WHEN (x1 + x2) / 2 < {WIDTH} / 2 THEN 'left' ELSE 'right' END AS zone FROM good"""
)
def zone_assignment(spark, sf_dir):
    return L.zones(_good(spark, sf_dir), WIDTH).select("page_id", "det_id", "zone")


@query(
    _CONFIDENT
    + f""", v AS (SELECT *, x1 < {WIDTH} / 2 - 0.08e0 * {WIDTH} AND x2 > {WIDTH} / 2 + 0.08e0 * {WIDTH} AS crosses FROM good WHERE x2 - x1 < 0.7e0 * {WIDTH}), n AS (
  SELECT page_id, count(*) FILTER (crosses) AS crossing, count(*) FILTER (NOT crosses AND x2 <= {WIDTH} / 2) AS left_items,
    count(*) FILTER (NOT crosses AND NOT x2 <= {WIDTH} / 2 AND x1 >= {WIDTH} / 2) AS right_items FROM v GROUP BY page_id)
  SELECT *, crossing <= 2 AND left_items >= 3 AND right_items >= 3 AS two_columns FROM n"""
)
def two_col_vote(spark, sf_dir):
    return L.two_column_votes(_good(spark, sf_dir), WIDTH)


_COVER = (
    _CONFIDENT
    + f""", spans AS (
  SELECT page_id, greatest(0, least(199, CAST(trunc(x1 / {WIDTH} * 200) AS INT))) AS l, greatest(0, least(199, CAST(trunc(x2 / {WIDTH} * 200) AS INT))) AS r
  FROM good WHERE x2 - x1 < 0.7e0 * {WIDTH}
), bins AS (SELECT page_id, unnest(range(0, 200)) AS bin FROM (SELECT DISTINCT page_id FROM spans)
), counted AS (SELECT page_id, unnest(range(l, r + 1)) AS bin FROM spans
), cover AS (
  SELECT b.page_id, CAST(b.bin AS BIGINT) AS bin, count(c.bin) AS cover FROM bins b LEFT JOIN counted c ON b.page_id = c.page_id AND b.bin = c.bin GROUP BY ALL
) """
)


@query(_COVER + "SELECT * FROM cover")
def coverage_hist(spark, sf_dir):
    return L.coverage(_good(spark, sf_dir), WIDTH)


@query(
    _COVER
    + """, free AS (SELECT page_id, bin, bin - row_number() OVER (PARTITION BY page_id ORDER BY bin) AS run FROM cover WHERE bin >= 10 AND bin < 190 AND cover <= 0)
  SELECT page_id, min(bin) AS g_start, max(bin) AS g_end FROM free GROUP BY page_id, run HAVING count(*) >= 3"""
)
def gutters(spark, sf_dir):
    return L.gutters(L.coverage(_good(spark, sf_dir), WIDTH))


@query(
    _CONFIDENT
    + """, l AS (SELECT *, class_name = 'List-item' AS is_item, row_number() OVER w AS ord, coalesce(lag(class_name) OVER w, '') = 'List-item' AS before, coalesce(lead(class_name) OVER w, '') = 'List-item' AS after
  FROM good WINDOW w AS (PARTITION BY page_id ORDER BY y1, x1, det_id))
  SELECT page_id, det_id, is_item AND NOT before AS opens, is_item AND NOT after AS closes FROM l"""
)
def list_runs(spark, sf_dir):
    rows = _good(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("y1", "x1", "det_id"))).withColumn("is_list_item", F.col("class_name") == "List-item")
    return L.list_boundaries(rows).select("page_id", "det_id", "opens", "closes")


@query(
    _CONFIDENT
    + f""", moved AS (SELECT page_id, det_id, x1 + 3 AS x1, y1 + 2 AS y1, x2 + 3 AS x2, y2 + 2 AS y2 FROM good WHERE confidence >= 0.6), truth AS (SELECT * FROM good WHERE class_name = 'Formula'),
  p AS (SELECT a.page_id, a.det_id, coalesce({_BOTH} / ({_AREA.format('a.')} + {_AREA.format('b.')} - {_BOTH}), 0e0) AS iou FROM truth a LEFT JOIN moved b ON a.page_id = b.page_id)
  SELECT page_id, det_id, round(max(iou), 6) AS best_iou, max(iou) >= 0.5 AS hit FROM p GROUP BY page_id, det_id"""
)
def detection_recall(spark, sf_dir):
    """Best overlap of each formula with the confident boxes, moved by (3, 2)."""
    good = _good(spark, sf_dir)
    moved = good.filter("confidence >= 0.6").selectExpr("page_id", "det_id", "x1 + 3 as x1", "y1 + 2 as y1", "x2 + 3 as x2", "y2 + 2 as y2")
    return D.best_recall(good.filter("class_name = 'Formula'"), moved).withColumn("best_iou", F.round("best_iou", 6))


@query(
    SQL
    + """, grid AS (SELECT unnest([0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0]) AS least), f AS (
  SELECT class_name, least, sum(CASE WHEN confidence >= least THEN 0 ELSE 1 END) * 2 + sum(CASE WHEN confidence >= least AND y2 - y1 < 20 THEN 1 ELSE 0 END) * 3 AS cost FROM dets, grid GROUP BY ALL)
  SELECT class_name, arg_min(least, (cost, least)) AS best, CAST(min(cost) AS BIGINT) AS cost FROM f GROUP BY class_name"""
)
def sweep_argmin(spark, sf_dir):
    """The confidence threshold of a small grid that costs least for each class."""
    grid = F.explode(F.array(*[F.lit(x / 10) for x in range(2, 9)])).alias("least")
    rows = detections(spark, sf_dir).select("class_name", "confidence", (F.col("y2") - F.col("y1")).alias("h"), grid)
    cost = F.when(F.col("confidence") < F.col("least"), 2).when(F.col("h") < 20, 3).otherwise(0)
    by = rows.groupBy("class_name", "least").agg(F.sum(cost).alias("cost"))
    return by.groupBy("class_name").agg(F.min_by("least", F.struct("cost", "least")).alias("best"), F.min("cost").alias("cost"))


_WORDS_SQL = r"SELECT unnest(string_split(text, ' ')) AS token FROM {}"


@query(f"SELECT token, count(*) AS cnt FROM ({_WORDS_SQL.format('documents')}) WHERE token <> '' GROUP BY token ORDER BY cnt DESC, token")
def vocab_counts(spark, sf_dir):
    return _vocabulary(_table(spark, sf_dir, "documents")).orderBy(F.col("cnt").desc(), "token")


def _vocabulary(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(F.split("text", " ")).alias("token")).filter("token <> ''").groupBy("token").agg(F.count("*").alias("cnt"))


@query(
    f"""SELECT token, count(*) AS cnt FROM ({_WORDS_SQL.format('documents')}) WHERE token <> '' AND token NOT IN (SELECT token FROM ({_WORDS_SQL.format('benchmark')}) WHERE token <> '') GROUP BY token"""
)
def residue_tokens(spark, sf_dir):
    return _vocabulary(_table(spark, sf_dir, "documents")).join(_vocabulary(_table(spark, sf_dir, "benchmark")), "token", "left_anti")


@query(f"SELECT token FROM ({_WORDS_SQL.format('documents')}) WHERE token <> '' INTERSECT SELECT token FROM ({_WORDS_SQL.format('benchmark')})")
def common_tokens(spark, sf_dir):
    return _vocabulary(_table(spark, sf_dir, "documents")).select("token").intersect(_vocabulary(_table(spark, sf_dir, "benchmark")).select("token"))


@query(
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM l),
  t AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS token FROM n), known AS (SELECT DISTINCT token FROM ({_WORDS_SQL.format('benchmark')}))
  SELECT doc_id, CAST(count(DISTINCT line_no) AS BIGINT) AS n_lines FROM t WHERE token <> '' AND token NOT IN (SELECT token FROM known) GROUP BY doc_id"""
)
def offending_lines(spark, sf_dir):
    """How many lines of each document hold a word that the benchmark does not know."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("doc_id", "line_no", F.explode(F.split("line", " ")).alias("token")).filter("token <> ''")
    odd = words.join(_vocabulary(_table(spark, sf_dir, "benchmark")).select("token"), "token", "left_anti")
    return odd.select("doc_id", "line_no").distinct().groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(
    TURNS_SQL
    + """, n AS (SELECT role, CASE WHEN next = '' THEN CASE WHEN plain = '' THEN 0e0 ELSE 1e0 END ELSE levenshtein(plain, next) / CAST(greatest(length(plain), length(next)) AS DOUBLE) END AS ned FROM turns WHERE next IS NOT NULL)
  SELECT coalesce(role, 'all') AS role, round(avg(ned), 6) AS ned, round(1 - avg(ned), 6) AS accuracy, count(*) AS n FROM n GROUP BY ROLLUP (role)"""
)
def ned_by_role(spark, sf_dir):
    rows = turns(spark, sf_dir).select("role", metrics.ned(F.col("plain"), F.col("next")).alias("ned"))
    return rows.rollup("role").agg(F.round(F.avg("ned"), 6).alias("ned"), F.round(1 - F.avg("ned"), 6).alias("accuracy"), F.count("*").alias("n")).withColumn("role", F.coalesce("role", F.lit("all")))


@query(
    TURNS_SQL
    + r""", s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(plain, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(next, ' '), lambda x: x <> '')) AS b FROM turns WHERE next IS NOT NULL)
  SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0e0 ELSE round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) END AS overlap FROM s"""
)
def token_jaccard(spark, sf_dir):
    words = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(metrics.jaccard(words("plain"), words("next")), 6).alias("overlap"))


@query()
def token_edit_distance(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("role").agg(F.round(F.avg(metrics.token_distance(F.col("plain"), F.col("next"))), 6).alias("distance"), F.count("*").alias("n"))


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN trim(regexp_replace(regexp_replace(text, '[^\x00-\x7F]+', ' ', 'g'), '\s+', ' ', 'g')) ELSE text END AS plain FROM documents"""
)
def nonascii_strip(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.strip_nonascii(F.col("text")).alias("plain"))


def _escape_sql(column: str) -> str:
    for a, b in text.ESCAPES:
        column = f"replace({column}, '{a}', '{b}')"
    return column


@query(f"SELECT doc_id, {_escape_sql('text')} AS tex FROM documents")
def latex_escape(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.escape_latex(F.col("text")).alias("tex"))


_SHIFTED = "CASE doc_id % 7 WHEN 0 THEN repeat(chr(19968), CAST(doc_id % 90 AS INT)) || {0} WHEN 1 THEN repeat(chr(13312), length({0})) || {0} ELSE {0} END"


@query(
    rf"""WITH d AS (SELECT doc_id, {_SHIFTED.format('text')} AS t FROM documents), c AS (
  SELECT doc_id, CAST(len(regexp_extract_all(t, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}]')) AS BIGINT) AS cjk, CAST(len(regexp_replace(t, '\s', '', 'g')) AS BIGINT) AS visible FROM d)
  SELECT doc_id, cjk, CASE WHEN cjk > 0 AND (visible - cjk < 10 OR cjk > visible - cjk) THEN 'cjk' WHEN cjk > 0 THEN 'mixed' ELSE 'english' END AS language FROM c"""
)
def lang_decision(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 7 == 0, F.expr("repeat('一', cast(doc_id % 90 as int))")).when(F.col("doc_id") % 7 == 1, F.expr("repeat('㐀', length(text))")).otherwise(F.lit(""))
    rows = docs.select("doc_id", F.concat(head, F.col("text")).alias("t"))
    cjk, visible = text.cjk_count(F.col("t")), F.length(F.regexp_replace("t", r"\s", ""))
    return rows.select("doc_id", cjk.alias("cjk"), text.language(cjk, visible - cjk).alias("language"))


@query()
def ocr_clean(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_ocr(F.col("text")).alias("cleaned"))


def _plain_sql(column: str) -> str:
    for pattern, new in text.PLAIN:
        new = new.replace("$1", r"\1").replace("\n", "' || chr(10) || '")
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, url, {_plain_sql('html')} AS plain FROM pages")
def html_strip(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", "url", text.plain_text(F.col("html")).alias("plain"))


@query(
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, round(avg(value), 6) AS mean_s, quantile_cont(value, 0.5) AS median_s, max(CASE WHEN i = floor(n * 0.9e0) AND n > 1 THEN value END) AS p90_s, round(sum(value), 4) AS total_s, count(*) AS n
  FROM o GROUP BY event_type"""
)
def latency_summary(spark, sf_dir):
    return metrics.latency_summary(_table(spark, sf_dir, "events"), "event_type", "value")


@query(
    """WITH b AS (SELECT lang, CASE WHEN len(string_split(text, ' ')) < 20 THEN 'short' WHEN len(string_split(text, ' ')) <= 50 THEN 'medium' ELSE 'long' END AS bucket, n_chars, len(string_split(text, ' ')) AS n_words FROM documents)
  SELECT bucket, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, CASE WHEN count(*) >= 2 AND stddev_pop(n_words) > 0 AND stddev_pop(n_chars) > 0 THEN round(corr(n_words, n_chars), 6) END AS r FROM b GROUP BY bucket"""
)
def length_bucket_corr(spark, sf_dir):
    n = F.size(F.split("text", " "))
    rows = _table(spark, sf_dir, "documents").select(F.when(n < 20, "short").when(n <= 50, "medium").otherwise("long").alias("bucket"), "n_chars", n.alias("n_words"))
    sound = (F.count("*") >= 2) & (F.stddev_pop("n_words") > 0) & (F.stddev_pop("n_chars") > 0)
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.when(sound, F.round(F.corr("n_words", "n_chars"), 6)).alias("r"))


@query(
    """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), h AS (SELECT doc_id, ch, count(*) AS c FROM c WHERE ch <> '' GROUP BY ALL),
  p AS (SELECT doc_id, c / CAST(sum(c) OVER (PARTITION BY doc_id) AS DOUBLE) AS p FROM h)
  SELECT doc_id, round(sum(-p * log2(p)) / 8, 6) AS entropy, count(*) AS occupied FROM p GROUP BY doc_id"""
)
def hist_entropy(spark, sf_dir):
    chars = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    return metrics.entropy(chars, "doc_id", "ch").withColumn("entropy", F.round("entropy", 6))


@query(
    """SELECT d.source, round(avg(l.quality), 6) AS quality, round(avg(l.toxic), 6) AS toxic, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source"""
)
def report_by_source(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT d.source, round(avg(l.quality), 6) AS quality FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source)
  (SELECT 'best' AS side, source, quality FROM r ORDER BY quality DESC, source LIMIT 3) UNION ALL (SELECT 'worst', source, quality FROM r ORDER BY quality, source LIMIT 3)"""
)
def top3_bottom3(spark, sf_dir):
    rows = report_by_source(spark, sf_dir).select("source", "quality")
    best, worst = (rows.orderBy(k, "source").limit(3).select(F.lit(side).alias("side"), "source", "quality") for side, k in (("best", F.col("quality").desc()), ("worst", "quality")))
    return best.unionByName(worst)


@query("""PIVOT (SELECT d.source, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)) ON lang IN ('de', 'en', 'es', 'fr') USING count(quality) GROUP BY source""")
def report_pivot(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(_table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count("quality")).na.fill(0)


@query(
    """WITH e AS (SELECT label, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM e GROUP BY label, dim"""
)
def mean_pool_embeddings(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return rows.groupBy("label", (F.col("dim") + 1).cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("""SELECT doc_id, printf('%07d.png', doc_id) AS name, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def lineno_join(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.format_string("%07d.png", "doc_id").alias("name"), "n_chars")
    names = _table(spark, sf_dir, "labels").select(F.format_string("%07d.png", "doc_id").alias("name")).distinct()
    return rows.join(names, "name", "left_semi").select("doc_id", "name", "n_chars")
