"""Queries that score, summarise and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics, text
from ..operators import detections as D
from ..sources import sinks
from ..sources import tables as S
from ..streaming import feed
from .registry import BOTH, CONFIDENT, TURNS_SQL, good, query, table, turns


@query(
    r"""WITH t AS (SELECT doc_id, source, lower(regexp_replace(regexp_replace(text, '[^\x20-\x7E]+', ' ', 'g'), '\s+', ' ', 'g')) AS gold FROM documents), p AS (SELECT doc_id, gold || repeat('x', CAST(doc_id % 9 AS INT)) AS pred FROM t WHERE doc_id % 5 <> 0)
  SELECT t.source, count(*) AS n, count(*) FILTER (p.pred IS NULL) AS missed, round(avg((length(p.pred) - length(t.gold)) / CAST(length(p.pred) AS DOUBLE)), 6) AS ned FROM t LEFT JOIN p USING (doc_id) WHERE length(t.gold) > 0 GROUP BY t.source"""
)
def scored_pages(spark, sf_dir):
    """Predictions met with their truth, pages without one reported; what is added at the end is the whole distance."""
    plain = F.lower(F.regexp_replace(F.regexp_replace("text", r"[^\x20-\x7E]+", " "), r"\s+", " "))
    truth = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem"), "source", plain.alias("gold")).filter("length(gold) > 0")
    made = truth.filter("stem % 5 <> 0").select("stem", F.concat("gold", F.expr("repeat('x', cast(stem % 9 as int))")).alias("text"))
    rows = S.scored_pages(truth, made)
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("missed").alias("missed"), F.round(F.avg(metrics.ned(F.col("pred"), F.col("gold"))), 6).alias("ned"))


@query(
    r"""WITH t AS (SELECT lang, CASE WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS arm, regexp_replace(text, '[^\x20-\x7E]+', ' ', 'g') AS p, length(text) AS n FROM documents)
  SELECT lang, arm, count(*) AS n, round(avg(length(p)), 6) AS mean_chars, round(avg(CASE WHEN length(p) = 0 THEN 1e0 ELSE 0e0 END) * 100, 6) AS empty_share FROM t GROUP BY lang, arm"""
)
def arm_summary(spark, sf_dir):
    """Counts, mean lengths and empty shares by group and arm."""
    rows = table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("arm"), F.regexp_replace("text", r"[^\x20-\x7E]+", " ").alias("p"))
    return rows.groupBy("lang", "arm").agg(F.count("*").alias("n"), F.round(F.avg(F.length("p")), 6).alias("mean_chars"), F.round(F.avg((F.length("p") == 0).cast("double")) * 100, 6).alias("empty_share"))


@query(
    """WITH s AS (SELECT user_id % 20 AS page, event_type, min(value) AS v FROM events GROUP BY ALL)
  SELECT CAST(page AS BIGINT) AS page, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'view') AS view, max(v) FILTER (event_type = 'purchase') AS purchase FROM s GROUP BY page"""
)
def condition_pivot(spark, sf_dir):
    """Latencies of each page side by side for the conditions."""
    rows = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("page"), "event_type").agg(F.min("value").alias("v"))
    return metrics.side_by_side(rows, "page", "event_type", "v", ["click", "view", "purchase"])


@query(
    """WITH p AS (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) SELECT e.event_type, round(avg(value), 6) AS mean_s, min(value) AS min_s, max(value) AS max_s, count(*) AS n,
    (SELECT round(avg(m), 6) FROM p WHERE p.event_type = e.event_type) AS mean_of_batches FROM events e GROUP BY e.event_type"""
)
def condition_report(spark, sf_dir):
    """Mean, least and largest latency of each condition, and the mean of its batches' means, which differs."""
    events = table(spark, sf_dir, "events")
    by = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_s"), F.min("value").alias("min_s"), F.max("value").alias("max_s"), F.count("*").alias("n"))
    return by.join(metrics.mean_of_batches(events, "event_type", "user_id", "value").withColumn("mean_of_batches", F.round("mean_of_batches", 6)), "event_type")


@query(
    """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events), m AS (SELECT event_type, avg(value) FILTER (i > 1) AS warm, avg(value) AS every, max(value) AS peak FROM o GROUP BY event_type)
  SELECT event_type, round(warm, 6) AS warm_mean, peak, round(every / warm, 6) AS speedup, round((1 - warm / peak) * 100, 6) AS reduction FROM m"""
)
def warm_latency(spark, sf_dir):
    """Mean latency without the first sample, the peak, and what the warm mean saves."""
    return metrics.warm_summary(table(spark, sf_dir, "events"), "event_type", "value", ["ts", "event_id"])


@query(
    TURNS_SQL
    + """, g AS (SELECT unnest([1, 2, 3]) AS cut), s AS (SELECT cut, CASE WHEN length(plain) % cut = 0 THEN plain ELSE '' END AS pred, next FROM turns, g WHERE next IS NOT NULL),
  e AS (SELECT cut, pred, CASE WHEN trim(next) = '' THEN 0e0 WHEN pred = '' THEN 1e0 WHEN pred = next THEN 0e0 ELSE 0.5e0 END AS e FROM s)
  SELECT cut, round(avg(e), 6) AS mean_edr, count(*) FILTER (pred = '') AS empty, count(*) AS n FROM e GROUP BY cut"""
)
def sweep_summary(spark, sf_dir):
    """Mean score, empty results and count of each setting of a sweep."""
    grid = F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("cut")
    rows = turns(spark, sf_dir).select("plain", "next", grid).withColumn("pred", F.when(F.length("plain") % F.col("cut") == 0, F.col("plain")).otherwise(""))
    score = F.when(F.trim("next") == "", 0.0).when(F.col("pred") == "", 1.0).when(F.col("pred") == F.col("next"), 0.0).otherwise(0.5)
    return metrics.setting_summary(rows.withColumn("score", score), "cut", "score", "pred").withColumn("mean_edr", F.round("mean_edr", 6))


@query(
    CONFIDENT
    + f""", moved AS (SELECT page_id, det_id, x1 + 3 AS x1, y1 + 2 AS y1, x2 + 3 AS x2, y2 + 2 AS y2 FROM good WHERE confidence >= 0.6), truth AS (SELECT * FROM good WHERE class_name = 'Formula'),
  p AS (SELECT a.page_id, a.det_id, b.det_id AS b_id, {BOTH} AS both_, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab FROM truth a JOIN moved b ON a.page_id = b.page_id),
  best AS (SELECT t.page_id, t.det_id, coalesce(max(both_ / (aa + ab - both_)), 0e0) AS iou FROM truth t LEFT JOIN p USING (page_id, det_id) GROUP BY ALL), held AS (SELECT m.page_id, m.det_id, count(*) FILTER (p.both_ / p.aa >= 0.8) AS n FROM moved m LEFT JOIN p ON p.page_id = m.page_id AND p.b_id = m.det_id GROUP BY ALL)
  SELECT (SELECT count(*) FROM best) AS truths, round((SELECT count(*) FILTER (iou >= 0.5) FROM best) / CAST(greatest((SELECT count(*) FROM best), 1) AS DOUBLE), 6) AS recall, round((SELECT avg(iou) FILTER (iou >= 0.5) FROM best), 6) AS mean_iou,
    round((SELECT count(*) FILTER (n >= 2) FROM held) / CAST(greatest((SELECT count(*) FROM held), 1) AS DOUBLE), 6) AS merge_rate"""
)
def detection_diagnosis(spark, sf_dir):
    """Recall, mean overlap of what was hit, and the share of found boxes that hold two true ones or more."""
    rows = good(spark, sf_dir)
    moved = rows.filter("confidence >= 0.6").selectExpr("page_id", "det_id", "x1 + 3 as x1", "y1 + 2 as y1", "x2 + 3 as x2", "y2 + 2 as y2")
    return D.diagnosis(rows.filter("class_name = 'Formula'"), moved)


_RESULT = """WITH s AS (SELECT d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)), r AS (
  SELECT 'quality' AS element, 'lang: ' || lang AS key, round(avg(1 - quality), 6) AS value FROM s GROUP BY lang UNION ALL SELECT 'quality', 'source: ' || source, round(avg(1 - quality), 6) FROM s GROUP BY source
  UNION ALL SELECT 'toxic', 'lang: ' || lang, round(avg(toxic), 6) FROM s GROUP BY lang UNION ALL SELECT 'quality', 'ALL', 0e0 UNION ALL SELECT 'quality', 'ALL_page_avg', round(avg(1 - quality), 6) FROM s UNION ALL SELECT 'toxic', 'ALL', round(avg(toxic), 6) FROM s UNION ALL SELECT 'toxic', 'ALL_page_avg', 0e0) """


def _results(spark, sf_dir) -> DataFrame:
    """(element, scores): one map of scores for each element, with attribute keys and totals, some of them 0."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    bad, toxic = F.round(F.avg(1 - F.col("quality")), 6), F.round(F.avg("toxic"), 6)
    by = lambda c, e, v: rows.groupBy(F.concat(F.lit(f"{c}: "), F.col(c)).alias("key")).agg(v.alias("value")).withColumn("element", F.lit(e))
    total = lambda k, e, v: rows.agg(v.alias("value")).select(F.lit(k).alias("key"), "value", F.lit(e).alias("element"))
    zero = F.first(F.lit(0.0))
    parts = [by("lang", "quality", bad), by("source", "quality", bad), by("lang", "toxic", toxic), total("ALL", "quality", zero), total("ALL_page_avg", "quality", bad), total("ALL", "toxic", toxic), total("ALL_page_avg", "toxic", zero)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("element").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("scores"))


@query(
    _RESULT
    + """SELECT element, split_part(key, ': ', 1) AS attr, split_part(key, ': ', 2) AS label, value, CAST(row_number() OVER (PARTITION BY element, split_part(key, ': ', 1) ORDER BY value, split_part(key, ': ', 2)) AS BIGINT) AS place FROM r WHERE contains(key, ': ')"""
)
def report_rows(spark, sf_dir):
    """Scores by attribute, totals left out, in order of value."""
    return metrics.report_rows(_results(spark, sf_dir))


@query(
    _RESULT
    + """SELECT element, coalesce(nullif(max(value) FILTER (key = 'ALL_page_avg'), 0), max(value) FILTER (key = 'ALL')) AS overall, CAST(count(*) FILTER (starts_with(key, 'lang: ')) AS BIGINT) AS langs FROM r GROUP BY element"""
)
def report_totals(spark, sf_dir):
    """An element's total: the page average unless it is missing or 0; and how many keys an attribute has."""
    rows = _results(spark, sf_dir)
    overall = metrics.preferred(F.col("scores")["ALL_page_avg"], F.col("scores")["ALL"])
    return rows.select("element", overall.alias("overall"), F.size(metrics.attribute(F.col("scores"), "lang")).cast("long").alias("langs"))


@query(
    """WITH s AS (SELECT lang, avg(doc_id % 8 / 8e0 + 0.01e0) AS v FROM documents GROUP BY lang UNION ALL SELECT 'none', NULL)
  SELECT lang, CASE WHEN v IS NULL THEN 'N/A' ELSE printf('%.1f%%', (1 - v) * 100) END AS accuracy, CASE WHEN v IS NULL THEN 'N/A' ELSE printf('%.4f', v) END AS edr,
    CASE WHEN v IS NULL THEN repeat(' ', 20) ELSE repeat('█', CAST(trunc((1 - v) * 20) AS INT)) || repeat('░', 20 - CAST(trunc((1 - v) * 20) AS INT)) END AS bar FROM s"""
)
def report_cells(spark, sf_dir):
    """Scores as percentages, with four places and as bars; N/A for none."""
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg(F.col("doc_id") % 8 / 8.0 + 0.01).alias("v"))
    rows = rows.unionByName(spark.range(1).select(F.lit("none").alias("lang"), F.lit(None).cast("double").alias("v")))
    return rows.select("lang", text.accuracy(F.col("v")).alias("accuracy"), text.four_places(F.col("v")).alias("edr"), text.bar(F.col("v")).alias("bar"))


@query("""SELECT '{' || string_agg('"' || lang || '":{"n":' || n || '}', ',' ORDER BY lang) || '}' AS body FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def score_json(spark, sf_dir):
    """Counts by language as one JSON object."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).agg(sinks.as_json_map("lang", "n").alias("body"))


@query("""SELECT doc_id, cnt FROM (SELECT doc_id, n_chars AS cnt, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r > 2 ORDER BY r""")
def after_warm_up(spark, sf_dir):
    """A pulled stream of records without its first two."""
    return table(spark, sf_dir, "documents").orderBy(F.col("n_chars").desc(), "doc_id").select("doc_id", F.col("n_chars").alias("cnt")).offset(2)


@query("SELECT d.doc_id, d.lang, CAST(length(d.text) AS BIGINT) AS n FROM documents d JOIN (SELECT DISTINCT printf('%07d', doc_id) AS stem FROM labels) l ON printf('%07d', d.doc_id) = l.stem WHERE trim(d.text) <> '' UNION ALL SELECT item_id, 'benchmark', CAST(length(text) AS BIGINT) FROM benchmark WHERE trim(text) <> ''")
def merged_corpora(spark, sf_dir):
    """Two corpora one after the other: captions without text and rows without an image are dropped."""
    name = lambda c: F.format_string("%07d", c)
    first = S.with_images(table(spark, sf_dir, "documents").select("doc_id", "lang", "text", name("doc_id").alias("name")), table(spark, sf_dir, "labels").select(name("doc_id").alias("name")))
    second = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("lang"), "text")
    return S.merge_corpora(first.drop("name"), second).select("doc_id", "lang", F.length("text").cast("long").alias("n"))


@query(
    """WITH e AS (SELECT label, vec_id, embedding FROM embeddings), k AS (SELECT vec_id AS old_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM e WHERE vec_id % 3 <> 1)
  SELECT CAST(k.new_id AS BIGINT) AS new_id, e.vec_id AS old_id, round(CAST(e.embedding[1] AS DOUBLE), 6) AS first_, CAST(len(e.embedding) AS BIGINT) AS dim FROM k JOIN e ON e.vec_id = k.old_id"""
)
def gathered_rows(spark, sf_dir):
    """Embedding rows gathered by a map from old to new ids."""
    rows = table(spark, sf_dir, "embeddings")
    mapping = rows.filter("vec_id % 3 <> 1").select(F.col("vec_id").alias("old_id"), (F.row_number().over(Window.orderBy("vec_id")) - 1).cast("long").alias("new_id"))
    got = mapping.join(rows.withColumnRenamed("vec_id", "old_id"), "old_id")
    return got.select("new_id", "old_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_"), F.size("embedding").cast("long").alias("dim"))


_JOBS = """WITH j AS (SELECT 'j' || user_id AS job_id, event_id, epoch(ts) AS moment, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'done' ELSE 'error' END AS status FROM events),
  l AS (SELECT job_id, arg_max(status, (moment, event_id)) AS status, max(moment) AS moment FROM j GROUP BY job_id), n AS (SELECT max(moment) AS now FROM j) """


@query(
    _JOBS
    + """, s AS (SELECT job_id, moment, CASE WHEN status = 'processing' AND now - moment > 300000 THEN 'error' ELSE status END AS status FROM l, n WHERE NOT (status IN ('done', 'error') AND now - moment > 600000))
  SELECT job_id, status, CASE WHEN status = 'queued' THEN CAST(row_number() OVER (PARTITION BY status ORDER BY moment, job_id) AS BIGINT) END AS position FROM s"""
)
def job_board(spark, sf_dir):
    """The latest state of every job: overdue work is an error, finished jobs are forgotten after a while, waiting ones have a position."""
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "done").otherwise("error")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("j"), "user_id").alias("job_id"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), status.alias("status"))
    rows = rows.withColumn("at", F.col("micros") / 1e6).drop("micros")
    return feed.board(rows, patience=300_000, keep=600_000)
