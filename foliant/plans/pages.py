"""Queries over pages of boxes and tokens: sequential rules, columns, documents, lines and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import latex
from ..operators import detections as D
from ..operators import layout as L
from ..operators import tables as T
from .fixture import HEIGHT, SQL, WIDTH, detections
from .registry import BOX, CONFIDENT, good, query, table

_RECURSIVE = CONFIDENT.replace("\nWITH ", "\nWITH RECURSIVE ", 1)


def _area(b: str) -> str:
    return f"(greatest(0e0, {b}.x2 - {b}.x1) * greatest(0e0, {b}.y2 - {b}.y1))"


def _both(a: str, b: str) -> str:
    return f"(greatest(0e0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0e0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _iou(a: str, b: str) -> str:
    union = f"({_area(a)} + {_area(b)} - {_both(a, b)})"
    return f"(CASE WHEN {union} > 0 THEN {_both(a, b)} / {union} ELSE 0e0 END)"


_STRUCT = "{{'det_id': {0}.det_id, 'class_name': {0}.class_name, 'confidence': {0}.confidence, 'x1': {0}.x1, 'y1': {0}.y1, 'x2': {0}.x2, 'y2': {0}.y2}}"


def _greedy(source: str, out: str, by: str, refused: str) -> str:
    """CTEs: boxes of each group ``by`` in order of confidence join ``out`` unless a kept one ``k`` refuses the new one ``n``."""
    on = " AND ".join(f"n.{c} = s.{c}" for c in by.split(", "))
    keys = ", ".join(f"n.{c}" for c in by.split(", "))
    own = _STRUCT.format("n")
    return f""", {out}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY confidence DESC, det_id) AS r, count(*) OVER (PARTITION BY {by}) AS m FROM {source}),
  {out}_s AS (
    SELECT {keys}, n.r, n.m, [{own}] AS kept FROM {out}_r n WHERE r = 1
    UNION ALL
    SELECT {keys}, n.r, n.m, CASE WHEN len(list_filter(s.kept, lambda k: {refused})) = 0 THEN list_append(s.kept, {own}) ELSE s.kept END
    FROM {out}_s s JOIN {out}_r n ON {on} AND n.r = s.r + 1
  ), {out} AS MATERIALIZED (SELECT page_id, unnest(kept, max_depth := 2) FROM {out}_s WHERE r = m)"""


_NMS = _greedy("good", "nms", "page_id, class_name", f"{_iou('k', 'n')} >= 0.4")


@query(_RECURSIVE + _NMS + f" SELECT {BOX} FROM nms")
def nms_keep(spark, sf_dir):
    return D.by_page(good(spark, sf_dir), D.nms_page)


@query(
    _RECURSIVE
    + ", near AS MATERIALIZED (SELECT * FROM dets WHERE confidence >= 0.25)"
    + _greedy("near", "kept_", "page_id", f"{_both('k', 'n')} / ({_area('k')} + {_area('n')} - {_both('k', 'n')} + 1e-9) > 0.7")
    + f" SELECT {BOX} FROM kept_ QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, det_id) <= 300"
)
def detector_nms(spark, sf_dir):
    return D.by_page(detections(spark, sf_dir).filter("confidence >= 0.25"), D.detector_nms_page)


def _resolved(source: str, out: str) -> str:
    """CTEs for overlaps: the pairs of a page that touch at first, in order, act on a list of its boxes, largest first."""
    side = lambda fits, box: f"CASE WHEN {fits} THEN {box} END"
    made = "{{'x1': {0}, 'y1': {1}, 'x2': {2}, 'y2': {3}}}"

    def clip(a: str, b: str) -> str:
        options = [
            side(f"{a}.y1 < {b}.y2 AND {b}.y2 < {a}.y2", made.format(f"{a}.x1", f"{b}.y2", f"{a}.x2", f"{a}.y2")),
            side(f"{a}.y1 < {b}.y1 AND {b}.y1 < {a}.y2", made.format(f"{a}.x1", f"{a}.y1", f"{a}.x2", f"{b}.y1")),
            side(f"{a}.x1 < {b}.x2 AND {b}.x2 < {a}.x2", made.format(f"{b}.x2", f"{a}.y1", f"{a}.x2", f"{a}.y2")),
            side(f"{a}.x1 < {b}.x1 AND {b}.x1 < {a}.x2", made.format(f"{a}.x1", f"{a}.y1", f"{b}.x1", f"{a}.y2")),
        ]
        return f"list_filter([{', '.join(options)}], lambda c: c IS NOT NULL AND {_area('c')} > 0)"

    return f""", {out}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {_area('z').replace('z.', '')} DESC, det_id) AS i FROM {source}),
  {out}_p AS MATERIALIZED (SELECT a.page_id, a.i, b.i AS j, row_number() OVER (PARTITION BY a.page_id ORDER BY a.i, b.i) AS t FROM {out}_o a JOIN {out}_o b ON a.page_id = b.page_id AND a.i < b.i AND {_both('a', 'b')} > 0),
  {out}_s AS (
    SELECT page_id, CAST(0 AS BIGINT) AS t, list({{'det_id': det_id, 'class_name': class_name, 'confidence': confidence, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'gone': false}} ORDER BY i) AS boxes FROM {out}_o GROUP BY page_id
    UNION ALL
    SELECT page_id, t, CASE WHEN a.gone OR b.gone THEN boxes
      WHEN inside >= 0.8 THEN CASE WHEN b.class_name IN ('Section-header', 'Page-header', 'Title', 'Caption') THEN boxes
        ELSE list_transform(boxes, lambda x, n: CASE WHEN n = j THEN {{'det_id': x.det_id, 'class_name': x.class_name, 'confidence': x.confidence, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 'gone': true}} ELSE x END) END
      WHEN iou > 0.3 AND len(left_) > 0 THEN list_transform(boxes, lambda x, n: CASE WHEN n = CASE WHEN b.confidence <= a.confidence THEN j ELSE i END
        THEN {{'det_id': x.det_id, 'class_name': x.class_name, 'confidence': x.confidence, 'x1': best.x1, 'y1': best.y1, 'x2': best.x2, 'y2': best.y2, 'gone': false}} ELSE x END)
      ELSE boxes END
    FROM (
      SELECT *, left_[list_position(list_transform(left_, lambda c: {_area('c')}), list_max(list_transform(left_, lambda c: {_area('c')})))] AS best FROM (
        SELECT *, CASE WHEN {_area('b')} > 0 THEN {_both('a', 'b')} / {_area('b')} ELSE 0e0 END AS inside, {_iou('a', 'b')} AS iou,
          CASE WHEN b.confidence <= a.confidence THEN {clip('b', 'a')} ELSE {clip('a', 'b')} END AS left_
        FROM (SELECT s.page_id, p.t, s.boxes, p.i, p.j, s.boxes[p.i] AS a, s.boxes[p.j] AS b FROM {out}_s s JOIN {out}_p p ON p.page_id = s.page_id AND p.t = s.t + 1)))
  ), {out} AS MATERIALIZED (
    SELECT page_id, u.det_id, u.class_name, u.confidence, u.x1, u.y1, u.x2, u.y2 FROM (SELECT page_id, unnest(boxes) AS u FROM {out}_s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY t DESC) = 1) WHERE NOT u.gone)"""


def _last_step(sql: str) -> str:
    """The unnesting must come after the last step is chosen."""
    return sql.replace("(SELECT page_id, unnest(boxes) AS u FROM resolved_s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY t DESC) = 1)", "(SELECT page_id, unnest(boxes) AS u FROM (SELECT * FROM resolved_s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY t DESC) = 1))")


def _merged(source: str, out: str) -> str:
    """CTEs for merging: boxes of a class from top to bottom, each with the box that those before it have become."""
    narrow = "least(s.x2 - s.x1, n.x2 - n.x1)"
    shared = f"(CASE WHEN {narrow} > 0 THEN greatest(0e0, least(s.x2, n.x2) - greatest(s.x1, n.x1)) / {narrow} ELSE 0e0 END)"
    joins = f"(n.y1 - s.y2 >= 0 AND n.y1 - s.y2 < 8 AND {shared} > 0.5)"
    return f""", {out}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id, class_name ORDER BY (y1 + y2) / 2, det_id) AS r FROM {source} WHERE class_name NOT IN ('List-item', 'Section-header', 'Title', 'Caption')),
  {out}_s AS (
    SELECT page_id, class_name, r, r AS start, det_id, confidence, x1, y1, x2, y2 FROM {out}_r WHERE r = 1
    UNION ALL
    SELECT n.page_id, n.class_name, n.r, CASE WHEN {joins} THEN s.start ELSE n.r END, CASE WHEN {joins} THEN s.det_id ELSE n.det_id END,
      CASE WHEN {joins} THEN greatest(s.confidence, n.confidence) ELSE n.confidence END, CASE WHEN {joins} THEN least(s.x1, n.x1) ELSE n.x1 END,
      CASE WHEN {joins} THEN least(s.y1, n.y1) ELSE n.y1 END, CASE WHEN {joins} THEN greatest(s.x2, n.x2) ELSE n.x2 END, CASE WHEN {joins} THEN greatest(s.y2, n.y2) ELSE n.y2 END
    FROM {out}_s s JOIN {out}_r n ON n.page_id = s.page_id AND n.class_name = s.class_name AND n.r = s.r + 1
  ), {out} AS MATERIALIZED (
    SELECT {BOX} FROM {source} WHERE class_name IN ('List-item', 'Section-header', 'Title', 'Caption')
    UNION ALL SELECT {BOX} FROM (SELECT * FROM {out}_s QUALIFY row_number() OVER (PARTITION BY page_id, class_name, start ORDER BY r DESC) = 1))"""


@query(_RECURSIVE + _last_step(_resolved("good", "resolved")) + f" SELECT {BOX} FROM resolved")
def overlap_resolve(spark, sf_dir):
    return D.by_page(good(spark, sf_dir), D.resolve_page)


@query(_RECURSIVE + _merged("good", "merged") + f" SELECT {BOX} FROM merged")
def merge_boxes(spark, sf_dir):
    return D.by_page(good(spark, sf_dir), D.merge_page)


@query(
    _RECURSIVE
    + _NMS
    + _last_step(_resolved("nms", "resolved"))
    + _merged("resolved", "merged")
    + f" SELECT page_id, det_id, class_name, confidence, greatest(0e0, x1 - 2) AS x1, greatest(0e0, y1 - 2) AS y1, least({WIDTH}e0, x2 + 2) AS x2, least({HEIGHT}e0, y2 + 2) AS y2 FROM merged"
)
def postprocess(spark, sf_dir):
    return D.by_page(detections(spark, sf_dir), lambda rows: D.postprocess_page(rows, float(WIDTH), float(HEIGHT)))


def _lines(source: str, out: str) -> str:
    joins = "(greatest(0e0, least(n.y2, s.high) - greatest(n.y1, s.low)) / greatest(n.y2 - n.y1, 1) >= 0.3)"
    return f""", {out}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, det_id) AS r FROM {source}),
  {out}_s AS (
    SELECT page_id, r, y1 AS low, y2 AS high, CAST(0 AS BIGINT) AS line FROM {out}_r WHERE r = 1
    UNION ALL
    SELECT n.page_id, n.r, CASE WHEN {joins} THEN least(s.low, n.y1) ELSE n.y1 END, CASE WHEN {joins} THEN greatest(s.high, n.y2) ELSE n.y2 END, s.line + CASE WHEN {joins} THEN 0 ELSE 1 END
    FROM {out}_s s JOIN {out}_r n ON n.page_id = s.page_id AND n.r = s.r + 1
  ), {out} AS MATERIALIZED (SELECT r.* EXCLUDE (r), s.line, row_number() OVER (PARTITION BY r.page_id ORDER BY s.line, r.x1, r.r) - 1 AS ord FROM {out}_r r JOIN {out}_s s ON r.page_id = s.page_id AND r.r = s.r)"""


_READING = """, near AS (
  SELECT c.page_id, c.det_id, p.ord AS pord, least(abs(c.y1 - p.y2), abs(c.y2 - p.y1)) AS dist, least(c.x2, p.x2) - greatest(c.x1, p.x1) AS beside
  FROM lined c JOIN lined p ON c.page_id = p.page_id AND c.class_name = 'Caption' AND p.class_name IN ('Picture', 'Table')
), parents AS (
  SELECT page_id, det_id, pord FROM near WHERE dist < 150 AND (beside > 0 OR dist < 50) QUALIFY row_number() OVER (PARTITION BY page_id, det_id ORDER BY dist, pord) = 1
), ordered AS MATERIALIZED (
  SELECT g.*, CAST(row_number() OVER (PARTITION BY g.page_id ORDER BY CASE WHEN class_name = 'Footnote' THEN 1 ELSE 0 END, greatest(ord, coalesce(pord, ord)), CASE WHEN coalesce(pord, ord) > ord THEN 1 ELSE 0 END, ord) AS BIGINT) AS reading
  FROM lined g LEFT JOIN parents p ON g.page_id = p.page_id AND g.det_id = p.det_id
)"""


@query(_RECURSIVE + _lines("good", "lined") + f" SELECT {BOX}, line, ord FROM lined")
def visual_lines(spark, sf_dir):
    return L.visual_lines(good(spark, sf_dir))


@query(_RECURSIVE + _lines("good", "lined") + _READING + " SELECT page_id, det_id, class_name, line, ord, reading FROM ordered")
def reading_order(spark, sf_dir):
    """Reading order over visual lines."""
    return L.reading_pages(good(spark, sf_dir)).select("page_id", "det_id", "class_name", "line", "ord", "reading")


@query(
    _RECURSIVE
    + ", base AS (SELECT * FROM good WHERE confidence >= 0.6), offered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id, class_name ORDER BY det_id) AS r, count(*) OVER (PARTITION BY page_id, class_name) AS m FROM dets WHERE confidence < 0.3)"
    + f""", tried AS (
    SELECT o.page_id, o.class_name, CAST(0 AS BIGINT) AS r, o.m, coalesce((SELECT list({_STRUCT.format('b')}) FROM base b WHERE b.page_id = o.page_id AND b.class_name = o.class_name), []) AS kept, 0 AS base_n FROM offered o WHERE o.r = 1
    UNION ALL
    SELECT n.page_id, n.class_name, n.r, n.m, CASE WHEN len(list_filter(s.kept, lambda k: {_iou('k', 'n')} > 0.4)) = 0 THEN list_append(s.kept, {_STRUCT.format('n')}) ELSE s.kept END, 0
    FROM tried s JOIN offered n ON n.page_id = s.page_id AND n.class_name = s.class_name AND n.r = s.r + 1)
  SELECT {BOX} FROM (SELECT page_id, unnest(kept, max_depth := 2) FROM tried WHERE r = m) WHERE confidence < 0.3"""
)
def supplement_accept(spark, sf_dir):
    """Boxes under the confidence threshold that overlap no confident one of their class, nor one accepted before."""
    dets = detections(spark, sf_dir)
    return D.accepted(dets.filter("confidence >= 0.6"), dets.filter("confidence < 0.3"))


@query(
    SQL
    + f""", kept AS (SELECT * FROM dets WHERE NOT (class_name IN ('Section-header', 'Page-header') AND y2 <= 0.12 * {HEIGHT})),
  free AS (SELECT page_id, max(det_id) + 1 AS det_id FROM kept GROUP BY page_id HAVING count(*) FILTER (class_name = 'Picture' AND x2 > 750 AND y1 < 91) = 0)
  SELECT page_id, det_id, 'Picture' AS class_name, CAST(NULL AS DOUBLE) AS confidence, 750e0 AS x1, 0e0 AS y1, 1000e0 AS x2, 91e0 AS y2 FROM free"""
)
def logo_pictures(spark, sf_dir):
    return D.logo_rows(D.without_headers(detections(spark, sf_dir), HEIGHT), WIDTH, HEIGHT)


_COVER = f""", spans AS (
  SELECT page_id, greatest(0, least(199, CAST(trunc(x1 / {WIDTH} * 200) AS INT))) AS l, greatest(0, least(199, CAST(trunc(x2 / {WIDTH} * 200) AS INT))) AS r FROM good WHERE x2 - x1 < 0.7e0 * {WIDTH}
), bins AS (SELECT page_id, unnest(range(0, 200)) AS bin FROM (SELECT DISTINCT page_id FROM spans)
), counted AS (SELECT page_id, unnest(range(l, r + 1)) AS bin FROM spans
), cover AS MATERIALIZED (SELECT b.page_id, b.bin, count(c.bin) AS cover FROM bins b LEFT JOIN counted c ON b.page_id = c.page_id AND b.bin = c.bin GROUP BY ALL
), narrow AS MATERIALIZED (SELECT *, (x1 + x2) / 2 / {WIDTH} * 200 AS c200, (x1 + x2) / {2 * WIDTH} AS c FROM good WHERE x2 - x1 < 0.7e0 * {WIDTH}
)"""


def _gutters(most: int, out: str) -> str:
    return f""", {out}_f AS (SELECT page_id, bin, bin - row_number() OVER (PARTITION BY page_id ORDER BY bin) AS run FROM cover WHERE bin >= 10 AND bin < 190 AND cover <= {most}),
  {out} AS MATERIALIZED (SELECT page_id, min(bin) AS g0, max(bin) AS g1 FROM {out}_f GROUP BY page_id, run HAVING count(*) >= 3)"""


def _by_gutters(out: str) -> str:
    """Columns between gutters."""
    return f""", {out}_c AS (SELECT n.page_id, n.det_id, count(g.page_id) AS col FROM narrow n JOIN (SELECT DISTINCT page_id FROM {out}) p ON p.page_id = n.page_id LEFT JOIN {out} g ON g.page_id = n.page_id AND g.g1 + 1 <= n.c200 WHERE n.c200 >= 0 AND n.c200 < 200 GROUP BY ALL),
  {out}_n AS (SELECT page_id, max(col) - min(col) + 1 AS wide, count(*) AS filled, min(n) AS least_ FROM (SELECT page_id, col, count(*) AS n FROM {out}_c GROUP BY ALL) GROUP BY page_id),
  {out}_cols AS (SELECT page_id, CAST(least(wide, 8) AS BIGINT) AS cols FROM {out}_n WHERE wide >= 3 AND filled = wide AND least_ >= 2)"""


_COLUMNS = (
    _COVER
    + _gutters(0, "strict")
    + _gutters(1, "relaxed")
    + _by_gutters("strict")
    + _by_gutters("relaxed")
    + f""", placed AS MATERIALIZED (SELECT page_id, det_id, c, row_number() OVER (PARTITION BY page_id ORDER BY c, det_id) AS i, count(*) OVER (PARTITION BY page_id) AS n FROM narrow),
  gaps AS MATERIALIZED (SELECT a.page_id, a.i, a.n, b.c - a.c AS gap, (a.c + b.c) / 2 * {WIDTH} AS middle, row_number() OVER (PARTITION BY a.page_id ORDER BY b.c - a.c DESC, a.i) AS rank FROM placed a JOIN placed b ON a.page_id = b.page_id AND b.i = a.i + 1),
  tried AS (SELECT page_id, unnest(range(3, 9)) AS cols FROM (SELECT DISTINCT page_id FROM gaps WHERE n >= 6)),
  cuts AS (SELECT t.page_id, t.cols, g.n, g.i, g.gap, g.i - coalesce(lag(g.i) OVER w, 0) AS size, count(*) OVER (PARTITION BY t.page_id, t.cols) AS found, lead(g.i) OVER w IS NULL AS last_ FROM tried t JOIN gaps g ON g.page_id = t.page_id AND g.rank < t.cols AND t.cols < g.n WINDOW w AS (PARTITION BY t.page_id, t.cols ORDER BY g.i)),
  fit AS (SELECT page_id, cols FROM cuts GROUP BY page_id, cols HAVING min(found) = cols - 1 AND min(gap) >= 0.15 AND min(size) >= 2 AND max(CASE WHEN last_ THEN n - i END) >= 2),
  spread AS MATERIALIZED (SELECT page_id, CAST(min(cols) AS BIGINT) AS cols FROM fit GROUP BY page_id),
  crossing AS (SELECT *, x1 < {WIDTH} / 2 - 0.08e0 * {WIDTH} AND x2 > {WIDTH} / 2 + 0.08e0 * {WIDTH} AS crosses FROM narrow),
  votes AS (SELECT page_id FROM crossing GROUP BY page_id HAVING count(*) FILTER (crosses) <= 2 AND count(*) FILTER (NOT crosses AND x2 <= {WIDTH} / 2) >= 3 AND count(*) FILTER (NOT crosses AND NOT x2 <= {WIDTH} / 2 AND x1 >= {WIDTH} / 2) >= 3),
  counts AS MATERIALIZED (SELECT p.page_id, coalesce(s.cols, r.cols, d.cols, CASE WHEN v.page_id IS NOT NULL THEN 2 END, 1) AS columns FROM (SELECT DISTINCT page_id FROM good) p
    LEFT JOIN strict_cols s USING (page_id) LEFT JOIN relaxed_cols r USING (page_id) LEFT JOIN spread d USING (page_id) LEFT JOIN votes v USING (page_id))"""
)


@query(CONFIDENT + _COLUMNS + " SELECT page_id, CAST(columns AS BIGINT) AS columns FROM counts")
def column_count(spark, sf_dir):
    return L.column_counts(good(spark, sf_dir), WIDTH)


_GROUPS = (
    _COLUMNS
    + f""", own AS MATERIALIZED (SELECT g.*, c.columns, g.x2 - g.x1 >= 0.7e0 * {WIDTH} AS wide, (g.x1 + g.x2) / 2 AS centre FROM good g JOIN counts c USING (page_id)),
  first_ AS MATERIALIZED (SELECT o.page_id, o.det_id, count(s.page_id) AS col FROM own o LEFT JOIN strict s ON s.page_id = o.page_id AND o.centre > (s.g0 + s.g1) / 2e0 / 200 * {WIDTH} WHERE o.columns >= 3 GROUP BY ALL),
  filled AS (SELECT page_id, count(DISTINCT f.col) AS filled FROM own o JOIN first_ f USING (page_id, det_id) WHERE NOT o.wide GROUP BY page_id),
  spare AS MATERIALIZED (SELECT o.page_id, o.det_id, count(g.page_id) AS col FROM own o JOIN spread s USING (page_id) LEFT JOIN gaps g ON g.page_id = o.page_id AND g.rank < s.cols AND o.centre > g.middle WHERE o.columns >= 3 GROUP BY ALL),
  grouped AS MATERIALIZED (SELECT o.* EXCLUDE (wide, centre), CAST(CASE WHEN o.columns = 1 THEN 0
      WHEN o.columns = 2 THEN CASE WHEN o.wide OR (o.x1 < {WIDTH} / 2 - 0.2e0 * {WIDTH} AND o.x2 > {WIDTH} / 2 + 0.2e0 * {WIDTH}) THEN 0 WHEN o.centre < {WIDTH} / 2 THEN 1 ELSE 2 END
      WHEN o.wide THEN 0
      WHEN o.page_id IN (SELECT page_id FROM strict) AND l.filled < 3 AND s.col IS NOT NULL THEN 1 + s.col ELSE 1 + f.col END AS BIGINT) AS grp
    FROM own o LEFT JOIN first_ f USING (page_id, det_id) LEFT JOIN filled l USING (page_id) LEFT JOIN spare s USING (page_id, det_id))"""
)


@query(CONFIDENT + _GROUPS + " SELECT page_id, det_id, CAST(columns AS BIGINT) AS columns, grp FROM grouped")
def column_groups(spark, sf_dir):
    """The group of its page's document that each box belongs to: what is wide, then column by column."""
    return L.placed(good(spark, sf_dir), WIDTH).select("page_id", "det_id", "columns", "grp")


_PLACED = (
    _GROUPS
    + """, lined_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id, grp ORDER BY y1, det_id) AS r FROM grouped),
  lined_s AS (
    SELECT page_id, grp, r, y1 AS low, y2 AS high, CAST(0 AS BIGINT) AS line FROM lined_r WHERE r = 1
    UNION ALL
    SELECT n.page_id, n.grp, n.r, CASE WHEN j THEN least(low, n.y1) ELSE n.y1 END, CASE WHEN j THEN greatest(high, n.y2) ELSE n.y2 END, line + CASE WHEN j THEN 0 ELSE 1 END
    FROM (SELECT n.*, s.low, s.high, s.line, greatest(0e0, least(n.y2, s.high) - greatest(n.y1, s.low)) / greatest(n.y2 - n.y1, 1) >= 0.3 AS j FROM lined_s s JOIN lined_r n ON n.page_id = s.page_id AND n.grp = s.grp AND n.r = s.r + 1) n
  ), lined AS MATERIALIZED (SELECT r.*, row_number() OVER (PARTITION BY r.page_id, r.grp ORDER BY s.line, r.x1, r.r) - 1 AS ord FROM lined_r r JOIN lined_s s ON r.page_id = s.page_id AND r.grp = s.grp AND r.r = s.r
  ), near AS (
  SELECT c.page_id, c.det_id, p.ord AS pord, least(abs(c.y1 - p.y2), abs(c.y2 - p.y1)) AS dist, least(c.x2, p.x2) - greatest(c.x1, p.x1) AS beside
  FROM lined c JOIN lined p ON c.page_id = p.page_id AND c.grp = p.grp AND c.class_name = 'Caption' AND p.class_name IN ('Picture', 'Table')
), parents AS (
  SELECT page_id, det_id, pord FROM near WHERE dist < 150 AND (beside > 0 OR dist < 50) QUALIFY row_number() OVER (PARTITION BY page_id, det_id ORDER BY dist, pord) = 1
), ordered AS MATERIALIZED (
  SELECT g.*, row_number() OVER (PARTITION BY g.page_id, g.grp ORDER BY CASE WHEN class_name = 'Footnote' THEN 1 ELSE 0 END, greatest(ord, coalesce(pord, ord)), CASE WHEN coalesce(pord, ord) > ord THEN 1 ELSE 0 END, ord) AS reading
  FROM lined g LEFT JOIN parents p ON g.page_id = p.page_id AND g.det_id = p.det_id
), steps AS (SELECT page_id, grp, (y1 + y2) / 2 < lag((y1 + y2) / 2) OVER (PARTITION BY page_id, grp ORDER BY reading) - 50 AS back FROM ordered
), smooth AS (SELECT page_id, grp, count(*) < 3 OR count(*) FILTER (back) / (count(*) - 1e0) <= 0.25 AS smooth FROM steps GROUP BY page_id, grp
), places AS MATERIALIZED (SELECT o.*, CASE WHEN o.columns = 1 OR s.smooth THEN o.reading ELSE o.ord + 1 END AS place FROM ordered o JOIN smooth s USING (page_id, grp))"""
)


@query(_RECURSIVE + _PLACED + " SELECT page_id, det_id, CAST(columns AS BIGINT) AS columns, grp, CAST(place AS BIGINT) AS place FROM places")
def group_places(spark, sf_dir):
    """The order of boxes within the groups of a page."""
    return L.placed(good(spark, sf_dir), WIDTH).select("page_id", "det_id", "columns", "grp", "place")


_LETTERS = "translate(CAST(det_id AS VARCHAR), '0123456789', 'abcdefghij')"
_TEX = r"""CASE class_name
  WHEN 'Title' THEN chr(10) || '\begin{center}' || chr(10) || '\textbf{\large ' || c || '}' || chr(10) || '\end{center}' || chr(10)
  WHEN 'Section-header' THEN chr(10) || '\subsection*{' || c || '}' || chr(10)
  WHEN 'Caption' THEN chr(10) || '\textit{' || c || '}' || chr(10)
  WHEN 'Footnote' THEN '\footnote{' || c || '}'
  WHEN 'Page-footer' THEN '% [footer: ' || c || ']'
  WHEN 'Page-header' THEN '% [header: ' || c || ']'
  WHEN 'List-item' THEN '\item ' || c || chr(10)
  WHEN 'Formula' THEN chr(10) || '\begin{equation}' || chr(10) || c || chr(10) || '\end{equation}' || chr(10)
  WHEN 'Table' THEN chr(10) || '\begin{center}' || chr(10) || '\resizebox{\columnwidth}{!}{' || chr(10) || c || chr(10) || '}' || chr(10) || '\end{center}' || chr(10)
  WHEN 'Picture' THEN chr(10) || '\begin{center}' || chr(10) || '\includegraphics[width=0.8\linewidth]{' || c || '}' || chr(10) || '\end{center}' || chr(10)
  ELSE chr(10) || c || chr(10) END"""


def _with_content(rows: DataFrame) -> DataFrame:
    """Each box with a word of its own; every third table is empty."""
    word = F.concat(F.lit("box "), F.translate(F.col("det_id").cast("string"), "0123456789", "abcdefghij"))
    return rows.withColumn("content", F.when((F.col("class_name") == "Table") & (F.col("det_id") % 3 == 0), "").otherwise(word))


@query(CONFIDENT + f" SELECT page_id, det_id, {_TEX} AS tex FROM (SELECT *, 'box ' || {_LETTERS} AS c FROM good)")
def template_projection(spark, sf_dir):
    word = F.concat(F.lit("box "), F.translate(F.col("det_id").cast("string"), "0123456789", "abcdefghij"))
    return good(spark, sf_dir).select("page_id", "det_id", latex.template(F.col("class_name"), word).alias("tex"))


_PARTS = (
    _PLACED
    + rf""", counted_ AS (SELECT *, CASE WHEN columns = 2 THEN grp ELSE 0 END AS zone, grp * 1000000 + place AS pos,
    sum(CASE WHEN class_name = 'Picture' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY grp, place) AS nth FROM places WHERE NOT (class_name = 'Table' AND det_id % 3 = 0)),
  worded AS (SELECT *, CASE WHEN class_name = 'Picture' THEN printf('assets/figures/figure_%03d.png', CAST(nth AS BIGINT)) ELSE 'box ' || {_LETTERS} END AS c FROM counted_),
  parted AS (SELECT page_id, columns, zone, pos, class_name = 'List-item' AS item, {_TEX} AS tex FROM worded),
  listed AS (SELECT *, item AND NOT coalesce(lag(item) OVER w, false) AS opens, item AND NOT coalesce(lead(item) OVER w, false) AS closes FROM parted WINDOW w AS (PARTITION BY page_id, zone ORDER BY pos)),
  bodies AS (SELECT page_id, columns, zone, string_agg(CASE WHEN opens THEN '\begin{{itemize}}' || chr(10) ELSE '' END || tex || CASE WHEN closes THEN chr(10) || '\end{{itemize}}' ELSE '' END, chr(10) ORDER BY pos) AS body FROM listed GROUP BY ALL),
  sides AS (SELECT c.page_id, c.columns, coalesce(max(body) FILTER (zone = 0), '') AS f, coalesce(max(body) FILTER (zone = 1), '') AS l, coalesce(max(body) FILTER (zone = 2), '') AS r FROM counts c LEFT JOIN bodies b USING (page_id) GROUP BY ALL)"""
)
_HEAD = r"'\documentclass{article}' || chr(10) || '\usepackage[margin=2cm]{geometry}' || chr(10) || '\usepackage{amsmath}' || chr(10) || '\usepackage{graphicx}' || chr(10) || '\usepackage{booktabs}' || chr(10) || '\usepackage[utf8]{inputenc}' || chr(10) || '\usepackage{ragged2e}' || chr(10) || '\setlength{\emergencystretch}{3em}' || chr(10)"


@query(
    _RECURSIVE
    + _PARTS
    + rf""" SELECT page_id, {_HEAD} || CASE WHEN columns = 2 THEN '\usepackage{{paracol}}' || chr(10) ELSE '' END || '\begin{{document}}' || chr(10) || '\sloppy' || chr(10)
    || CASE WHEN columns = 2 THEN f || chr(10) || '\begin{{paracol}}{{2}}' || chr(10) || '\RaggedRight' || chr(10) || l || chr(10) || '\switchcolumn' || chr(10) || '\RaggedRight' || chr(10) || r || chr(10) || '\end{{paracol}}' || chr(10) ELSE f END
    || chr(10) || '\end{{document}}' || chr(10) AS tex FROM sides"""
)
def page_documents(spark, sf_dir):
    """One LaTeX document a page: columns counted, boxes grouped and ordered, fragments and lists assembled."""
    return latex.page_documents(_with_content(L.placed(good(spark, sf_dir), WIDTH)))


@query(
    SQL
    + f""", g AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM dets)
  SELECT page_id, det_id, round(greatest(0e0, w) * greatest(0e0, h), 6) AS area, CAST(trunc(greatest(0e0, x1)) AS INT) AS crop_left, CAST(trunc(least({WIDTH}e0, x2)) AS INT) AS crop_right,
    round(x1 + w / 2 - w / 2, 6) AS back_x1, round(y1 + h / 2 + h / 2, 6) AS back_y2, greatest(0e0, x1 - 4) AS pad_x1, least({HEIGHT}e0, y2 + 4) AS pad_y2,
    round(CASE WHEN least(w, 300) > 0 THEN greatest(0e0, least(x2, 500) - greatest(x1, 200)) / least(w, 300) ELSE 0e0 END, 6) AS beside,
    least(x1, x2) AS poly_x1, greatest(y1, y2) AS poly_y2, round(w * h, 6) AS quad, w * h >= 0.15e0 * {WIDTH * HEIGHT} AS large_quad FROM g"""
)
def box_scalars(spark, sf_dir):
    """Areas, crops, pads, centres, one-dimensional overlaps and outlines of boxes."""
    x1, y1, x2, y2 = G.box()
    w, h = x2 - x1, y2 - y1
    left, _, right, _ = G.crop_box(G.box(), WIDTH, HEIGHT)
    padded = G.pad_clamp(G.box(), 4, WIDTH, HEIGHT)
    back = G.corners(x1 + w / 2, y1 + h / 2, w, h)
    poly = F.array(x1, y1, x2, y1, x2, y2, x1, y2)
    corner = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])
    rows = detections(spark, sf_dir).withColumn("poly", poly)
    outline = G.polygon_box("poly")
    return rows.select(
        "page_id", "det_id", F.round(G.area(G.box()), 6).alias("area"), left.alias("crop_left"), right.alias("crop_right"), F.round(back[0], 6).alias("back_x1"), F.round(back[3], 6).alias("back_y2"),
        padded[0].alias("pad_x1"), padded[3].alias("pad_y2"), F.round(G.overlap_1d(x1, x2, F.lit(200.0), F.lit(500.0)), 6).alias("beside"), outline[0].alias("poly_x1"), outline[3].alias("poly_y2"),
        F.round(G.quad_area(corner), 6).alias("quad"), G.valid_quad(corner, WIDTH, HEIGHT).alias("large_quad"),
    )


@query(
    """WITH o AS (SELECT o_orderkey, CAST(200 + o_orderkey * 37 % 3000 AS DOUBLE) AS w, CAST(300 + o_orderkey * 53 % 3400 AS DOUBLE) AS h FROM orders),
  s AS (SELECT *, least(w, h) AS short FROM o), r AS (SELECT *, CASE WHEN short >= 1200 THEN CASE WHEN short > 1800 THEN 1800e0 / short ELSE 1e0 END ELSE 250e0 / 96 END AS raw, least(640e0 / h, 640e0 / w) AS ratio FROM s),
  g AS (SELECT *, greatest(0.5e0, raw) AS scale, (640 - floor(w * ratio + 0.5)) % 32 / 2 AS gx, (640 - floor(h * ratio + 0.5)) % 32 / 2 AS gy FROM r)
  SELECT o_orderkey, round(CASE WHEN abs(scale - 1) < 0.05 THEN 1e0 ELSE scale END, 6) AS resize, round(least(1e0, 1800e0 / short), 6) AS cap, round(ratio, 6) AS ratio,
    CAST(floor(gx - 0.1 + 0.5) AS INT) AS pad_left, CAST(floor(gy - 0.1 + 0.5) AS INT) AS pad_top FROM g"""
)
def page_scales(spark, sf_dir):
    """Resize, cap and letterbox decisions over page sizes derived from orders."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (200 + key * 37 % 3000).cast("double").alias("w"), (300 + key * 53 % 3400).cast("double").alias("h"))
    ratio, left, top = G.letterbox(F.col("w"), F.col("h"))
    return rows.select(
        "o_orderkey", F.round(G.resize_scale(F.col("w"), F.col("h")), 6).alias("resize"), F.round(G.cap_scale(F.col("w"), F.col("h")), 6).alias("cap"),
        F.round(ratio, 6).alias("ratio"), left.alias("pad_left"), top.alias("pad_top"),
    )


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 997 AS DOUBLE) AS r1, CAST(o_orderkey % 90 AS DOUBLE) / 57 AS t1, CAST(o_custkey % 991 AS DOUBLE) AS r2, CAST(o_custkey % 90 AS DOUBLE) / 57 AS t2 FROM orders),
  d AS (SELECT *, cos(t1) * sin(t2) - sin(t1) * cos(t2) AS det FROM o)
  SELECT o_orderkey, CASE WHEN abs(det) >= 1e-6 THEN round((sin(t2) * r1 - sin(t1) * r2) / det, 4) + 0e0 END AS x, CASE WHEN abs(det) >= 1e-6 THEN round((cos(t1) * r2 - cos(t2) * r1) / det, 4) + 0e0 END AS y FROM d"""
)
def line_crossings(spark, sf_dir):
    """Where two lines in polar form cross; null for parallel ones."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", *[(F.col(k) % m).cast("double").alias(n) for k, m, n in (("o_orderkey", 997, "r1"), ("o_custkey", 991, "r2"))], *[((F.col(k) % 90).cast("double") / 57).alias(n) for k, n in (("o_orderkey", "t1"), ("o_custkey", "t2"))])
    x, y = G.line_crossing(*[F.col(c) for c in ("r1", "t1", "r2", "t2")])
    return rows.select("o_orderkey", (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


@query(
    SQL
    + """, s AS (SELECT page_id, det_id, list_transform([det_id % 7, det_id % 5, det_id % 3, page_id % 4], lambda v: CAST(v AS DOUBLE)) AS z FROM dets),
  e AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS p FROM s), n AS (SELECT *, list_transform(p, lambda v: v / list_sum(p)) AS q FROM e),
  b AS (SELECT *, list_max(q[1:3]) AS score FROM n)
  SELECT page_id, det_id, CAST(list_position(q[1:3], score) - 1 AS INT) AS label, round(score, 6) AS score FROM b WHERE score > 0.5"""
)
def score_head(spark, sf_dir):
    """Detector heads: softmax over classes with a last one for nothing, which is dropped; scores over one half stay."""
    logits = F.transform(F.array(F.col("det_id") % 7, F.col("det_id") % 5, F.col("det_id") % 3, F.col("page_id") % 4), lambda v: v.cast("double"))
    rows = detections(spark, sf_dir).select("page_id", "det_id", logits.alias("logits"))
    return D.scored(rows, "logits", 0.5).select("page_id", "det_id", "label", F.round("score", 6).alias("score"))


_TOKENS = """WITH w AS (SELECT conv_id AS page_id, turn AS det_id, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1),
  t AS (SELECT page_id, det_id, unnest(range(0, len(string_split(text, ' ')))) AS tok_id, unnest(string_split(text, ' ')) AS text FROM w),
  tokens AS MATERIALIZED (SELECT page_id, det_id, tok_id, text, CAST(tok_id % 10 * 60 + tok_id * 7 % 5 AS DOUBLE) AS x1, CAST(tok_id % 10 * 60 + tok_id * 7 % 5 + least(8 * length(text), 200) AS DOUBLE) AS x2,
    CAST(tok_id // 10 * 20 + tok_id * 3 % 4 AS DOUBLE) AS y1, CAST(tok_id // 10 * 20 + tok_id * 3 % 4 + 12 AS DOUBLE) AS y2 FROM t WHERE text <> '' AND NOT regexp_matches(text, '\\s') AND regexp_full_match(text, '[\\x20-\\x7E]+')) """


def tokens(spark, sf_dir) -> DataFrame:
    """ASCII words of turns laid out ten a line, slightly out of step."""
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    turns = table(spark, sf_dir, "conversations").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    words = turns.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("det_id"), F.posexplode(F.split("text", " ")).alias("tok_id", "text"))
    words = words.withColumn("tok_id", F.col("tok_id").cast("long")).filter(r"text <> '' and not text rlike '\\s' and text rlike '^[\\x20-\\x7E]+$'")
    left, top = F.expr("tok_id % 10 * 60 + tok_id * 7 % 5"), F.expr("tok_id div 10 * 20 + tok_id * 3 % 4")
    wide = F.least(8 * F.length("text"), F.lit(200))
    return words.select("page_id", "det_id", "tok_id", "text", left.cast("double").alias("x1"), (left + wide).cast("double").alias("x2"), top.cast("double").alias("y1"), (top + 12).cast("double").alias("y2"))


@query(_TOKENS + "SELECT * FROM tokens WHERE trim(text) <> '' AND NOT regexp_full_match(trim(text), '[-_=.]+') AND x2 - x1 <= 0.8e0 * 200")
def table_token_filter(spark, sf_dir):
    return T.table_tokens(tokens(spark, sf_dir), 200)


_AXES = """, boxes AS (SELECT DISTINCT page_id, det_id, unnest(range(0, 6)) AS k FROM tokens), axes AS MATERIALIZED (
  SELECT page_id, det_id, 'row' AS axis, row_number() OVER (PARTITION BY page_id, det_id ORDER BY k) - 1 AS idx, CAST(k * 20 AS DOUBLE) AS lo, CAST(k * 20 + 15 AS DOUBLE) AS hi FROM boxes WHERE k < 5
  UNION ALL SELECT page_id, det_id, 'column', k, CAST(k * 120 AS DOUBLE), CAST(k * 120 + 100 AS DOUBLE) FROM boxes WHERE k < 5)"""


def _axes(spark, sf_dir) -> DataFrame:
    """Five rows and five columns for each region, told apart by labels; headers, a wide column and an unsure row fall out."""
    regions = tokens(spark, sf_dir).select("page_id", "det_id").distinct()
    k = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")
    row = [F.lit("table row").alias("label"), F.when(F.col("k") < 5, 0.9).otherwise(0.5).alias("score"), F.lit(0.0).alias("x1"), (F.col("k") * 20).cast("double").alias("y1"), F.lit(600.0).alias("x2"), (F.col("k") * 20 + 15).cast("double").alias("y2")]
    col = [F.when(F.col("k") == 1, "table column header").otherwise("table column").alias("label"), F.lit(0.8).alias("score"), F.when(F.col("k") < 5, F.col("k") * 120).otherwise(0).cast("double").alias("x1"), F.lit(0.0).alias("y1"), F.when(F.col("k") < 5, F.col("k") * 120 + 100).otherwise(590).cast("double").alias("x2"), F.lit(100.0).alias("y2")]
    head = [F.lit("table row header").alias("label"), F.lit(0.9).alias("score"), *[F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 90.0), ("y2", 15.0))]]
    keyed = regions.select("page_id", "det_id", k)
    parts = [keyed.select("page_id", "det_id", *cols) for cols in (row, col)] + [regions.select("page_id", "det_id", *head)]
    return T.axes(parts[0].unionByName(parts[1]).unionByName(parts[2]), 600)


@query(_TOKENS + _AXES + "SELECT * FROM axes")
def table_axes(spark, sf_dir):
    return _axes(spark, sf_dir).select("page_id", "det_id", "axis", F.col("idx").cast("long").alias("idx"), "lo", "hi")


def _assigned(axis: str, a: str, b: str, name: str) -> str:
    share = f"CASE WHEN least(t.{b} - t.{a}, x.hi - x.lo) > 0 THEN greatest(0e0, least(t.{b}, x.hi) - greatest(t.{a}, x.lo)) / least(t.{b} - t.{a}, x.hi - x.lo) ELSE 0e0 END"
    return f"{name} AS (SELECT t.page_id, t.det_id, t.tok_id, arg_max(x.idx, ({share}, -x.idx)) AS {name} FROM tokens t JOIN axes x ON x.page_id = t.page_id AND x.det_id = t.det_id AND x.axis = '{axis}' GROUP BY ALL)"


_GRID = _TOKENS + _AXES + f""", {_assigned('row', 'y1', 'y2', 'r')}, {_assigned('column', 'x1', 'x2', 'c')},
  cells AS MATERIALIZED (SELECT t.page_id, t.det_id, r.r, c.c, string_agg(t.text, ' ' ORDER BY t.y1, t.x1, t.text) AS cell FROM tokens t JOIN r USING (page_id, det_id, tok_id) JOIN c USING (page_id, det_id, tok_id) GROUP BY ALL)"""


@query(_GRID + " SELECT page_id, det_id, CAST(r AS BIGINT) AS row_no, CAST(c AS BIGINT) AS col_no, cell FROM cells")
def token_grid_assign(spark, sf_dir):
    cells = T.grid(tokens(spark, sf_dir), _axes(spark, sf_dir))
    return cells.select("page_id", "det_id", F.col("row").cast("long").alias("row_no"), F.col("col").cast("long").alias("col_no"), "cell")


@query(
    _GRID
    + r""", wide AS (SELECT page_id, det_id, max(c) AS last FROM cells GROUP BY ALL), full_ AS (SELECT w.page_id, w.det_id, r.r, unnest(range(0, w.last + 1)) AS c FROM wide w JOIN (SELECT DISTINCT page_id, det_id, r FROM cells WHERE trim(cell) <> '') r USING (page_id, det_id)),
  lines AS (SELECT f.page_id, f.det_id, f.r, string_agg('<td>' || coalesce(x.cell, '') || '</td>', '' ORDER BY f.c) AS tds, string_agg(coalesce(x.cell, ''), ' & ' ORDER BY f.c) AS amps, count(*) AS n FROM full_ f LEFT JOIN cells x ON x.page_id = f.page_id AND x.det_id = f.det_id AND x.r = f.r AND x.c = f.c GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, det_id ORDER BY r) AS k FROM lines)
  SELECT page_id, det_id, '<table border="1">' || string_agg('<tr>' || tds || '</tr>', '' ORDER BY r) || '</table>' AS html,
    '\begin{tabular}{' || repeat('l', CAST(max(n) AS INT)) || '}' || chr(10) || '\toprule' || chr(10) || string_agg(amps || ' \\' || CASE WHEN k = 1 THEN chr(10) || '\midrule' ELSE '' END, chr(10) ORDER BY r) || chr(10) || '\bottomrule' || chr(10) || '\end{tabular}' AS tex
  FROM ranked GROUP BY page_id, det_id"""
)
def table_markup(spark, sf_dir):
    """Grids as HTML and as LaTeX tables, rows without text left out."""
    cells = T.grid(tokens(spark, sf_dir), _axes(spark, sf_dir))
    return T.grid_html(cells).join(T.grid_tex(cells), ["page_id", "det_id"])


@query(
    _TOKENS
    + """, keyed AS (SELECT *, CAST(round_even((y1 + y2) / 2 / greatest(200 * 0.015e0, 1), 0) AS BIGINT) AS k FROM tokens), rows_ AS (SELECT page_id, det_id, k, string_agg(text, ' & ' ORDER BY x1, tok_id) AS line FROM keyed GROUP BY ALL)
  SELECT page_id, det_id, string_agg(line, ' \\\\' || chr(10) ORDER BY k) AS body FROM rows_ GROUP BY ALL"""
)
def table_rows_by_height(spark, sf_dir):
    return T.rows_by_height(tokens(spark, sf_dir), 200)


@query(
    _TOKENS
    + """, s AS (SELECT *, (y1 + y2) / 2 AS cy, y2 - y1 AS h FROM tokens), j AS (SELECT *, coalesce(abs(cy - lag(cy) OVER w) > 0.6e0 * least(h, lag(h) OVER w), false) AS fresh FROM s WINDOW w AS (PARTITION BY page_id, det_id ORDER BY cy, x1, tok_id)),
  l AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, det_id ORDER BY cy, x1, tok_id) AS BIGINT) AS line FROM j),
  m AS (SELECT page_id, det_id, line, quantile_cont((x2 - x1) / greatest(length(text), 1), 0.5) AS med FROM l GROUP BY ALL),
  g AS (SELECT l.*, m.med, row_number() OVER v AS i, x1 - lag(x2) OVER v AS gap FROM l JOIN m USING (page_id, det_id, line) WINDOW v AS (PARTITION BY page_id, det_id, line ORDER BY x1, tok_id))
  SELECT page_id, det_id, line, string_agg(CASE WHEN gap >= 0.35e0 * med THEN ' ' ELSE '' END || text, '' ORDER BY i) AS text FROM g GROUP BY page_id, det_id, line"""
)
def ocr_lines(spark, sf_dir):
    """Words grouped into lines by their heights and spaced by their gaps."""
    return T.ocr_lines(tokens(spark, sf_dir)).withColumn("line", F.col("line").cast("long"))


@query(
    _TOKENS
    + """, spans AS (SELECT page_id, det_id, CAST(greatest(0, trunc(x1)) AS BIGINT) AS l, CAST(least(600, trunc(x2)) AS BIGINT) AS r FROM tokens WHERE x2 - x1 <= 240),
  cover AS (SELECT DISTINCT page_id, det_id, unnest(range(l, r)) AS x FROM spans), runs AS (SELECT *, x - row_number() OVER (PARTITION BY page_id, det_id ORDER BY x) AS run FROM cover),
  segs AS (SELECT page_id, det_id, min(x) AS lo, max(x) + 1 AS hi FROM runs GROUP BY page_id, det_id, run)
  SELECT page_id, det_id, CAST(row_number() OVER (PARTITION BY page_id, det_id ORDER BY lo) - 1 AS BIGINT) AS idx, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM segs"""
)
def column_segments(spark, sf_dir):
    """Runs of pixel columns under some word."""
    return T.column_segments(tokens(spark, sf_dir), 600).select("page_id", "det_id", F.col("idx").cast("long").alias("idx"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))


@query(
    _TOKENS.replace("WITH w AS", "WITH RECURSIVE w AS", 1)
    + """, o AS MATERIALIZED (SELECT *, (y1 + y2) / 2 AS cy, y2 - y1 AS h, row_number() OVER (PARTITION BY page_id, det_id ORDER BY (y1 + y2) / 2, tok_id) AS k FROM tokens),
  f AS (SELECT page_id, det_id, tok_id, k, CAST(0 AS BIGINT) AS row_no, cy AS mean, CAST(1 AS BIGINT) AS n FROM o WHERE k = 1
    UNION ALL SELECT o.page_id, o.det_id, o.tok_id, o.k, f.row_no + CASE WHEN abs(o.cy - f.mean) < greatest(o.h, 10) * 0.6e0 THEN 0 ELSE 1 END,
      CASE WHEN abs(o.cy - f.mean) < greatest(o.h, 10) * 0.6e0 THEN (f.mean * f.n + o.cy) / (f.n + 1) ELSE o.cy END, CASE WHEN abs(o.cy - f.mean) < greatest(o.h, 10) * 0.6e0 THEN f.n + 1 ELSE 1 END
    FROM f JOIN o ON o.page_id = f.page_id AND o.det_id = f.det_id AND o.k = f.k + 1)
  SELECT page_id, det_id, tok_id, row_no FROM f"""
)
def running_rows(spark, sf_dir):
    """Table rows by distance to the running mean of a row's heights."""
    return T.running_rows(tokens(spark, sf_dir)).select("page_id", "det_id", "tok_id", F.col("row").alias("row_no"))


_SEGMENT = """, segs AS MATERIALIZED (SELECT page_id, det_id, k AS idx, CAST(k * 150 AS DOUBLE) AS lo, CAST(k * 150 + 90 AS DOUBLE) AS hi FROM (SELECT DISTINCT page_id, det_id, unnest(range(0, 4)) AS k FROM tokens))"""


@query(
    _TOKENS
    + _SEGMENT
    + """, d AS (SELECT t.page_id, t.det_id, t.tok_id, s.idx, greatest(0e0, least(t.x2, s.hi) - greatest(t.x1, s.lo)) AS over_, CASE WHEN (t.x1 + t.x2) / 2 BETWEEN s.lo AND s.hi THEN 0e0 ELSE least(abs((t.x1 + t.x2) / 2 - s.lo), abs((t.x1 + t.x2) / 2 - s.hi)) END AS dist FROM tokens t JOIN segs s USING (page_id, det_id))
  SELECT page_id, det_id, tok_id, CAST(arg_min(idx, (-over_, CASE WHEN over_ > 0 THEN 0e0 ELSE dist END, idx)) AS BIGINT) AS col_no FROM d GROUP BY page_id, det_id, tok_id"""
)
def nearest_columns(spark, sf_dir):
    """Each word's column: the one it overlaps most, else the nearest."""
    words = tokens(spark, sf_dir)
    segments = words.select("page_id", "det_id").distinct().select("page_id", "det_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx"))
    segments = segments.select("page_id", "det_id", "idx", (F.col("idx") * 150).cast("double").alias("lo"), (F.col("idx") * 150 + 90).cast("double").alias("hi"))
    return T.nearest(words, segments).select("page_id", "det_id", "tok_id", F.col("col").cast("long").alias("col_no"))


@query(
    CONFIDENT
    + """, words AS (SELECT page_id, det_id AS word_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM dets WHERE class_name = 'Text'), regions AS (SELECT * FROM good WHERE class_name IN ('Picture', 'Table', 'Caption'))
  SELECT r.page_id, r.det_id, count(w.word_id) AS n_words, coalesce(string_agg(CAST(w.word_id AS VARCHAR), ' ' ORDER BY w.word_id), '') AS words FROM regions r LEFT JOIN words w ON w.page_id = r.page_id AND w.cx >= r.x1 AND w.cx <= r.x2 AND w.cy >= r.y1 AND w.cy <= r.y2 GROUP BY ALL"""
)
def words_in_regions(spark, sf_dir):
    """Which word centres lie in which regions, borders included; a word may lie in several, a region may be empty."""
    words = detections(spark, sf_dir).filter("class_name = 'Text'").select("page_id", F.col("det_id").alias("word_id"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    inside = T.words_inside(good(spark, sf_dir).filter(F.col("class_name").isin("Picture", "Table", "Caption")), words)
    by = inside.groupBy("page_id", "det_id").agg(F.count("word_id").alias("n_words"), F.sort_array(F.collect_list("word_id")).alias("w"))
    return by.select("page_id", "det_id", "n_words", F.array_join(F.transform("w", lambda x: x.cast("string")), " ").alias("words"))


@query(
    SQL
    + """, strips AS (SELECT page_id, det_id, floor(y2 - y1) AS h, sum(floor(y2 - y1) + 20) OVER (PARTITION BY page_id ORDER BY det_id) - floor(y2 - y1) - 20 AS s FROM dets),
  hits AS (SELECT page_id, det_id AS hit_id, x1 + y1 AS cy FROM dets)
  SELECT h.page_id, h.hit_id, s.det_id, round(h.cy - s.s, 6) AS y FROM hits h JOIN strips s ON s.page_id = h.page_id AND h.cy >= s.s AND h.cy < s.s + s.h"""
)
def strip_lookup(spark, sf_dir):
    """Readings of a stitched image back in their crops: intervals with gaps of 20 pixels, readings in a gap dropped."""
    dets = detections(spark, sf_dir)
    strips = T.strips(dets.select("page_id", "det_id", F.floor(F.col("y2") - F.col("y1")).alias("height")))
    hits = dets.select("page_id", F.col("det_id").alias("hit_id"), (F.col("x1") + F.col("y1")).alias("cy"))
    return T.unstitched(hits, strips).select("page_id", "hit_id", "det_id", F.round("y", 6).alias("y"))


@query(
    CONFIDENT
    + """, n AS (SELECT page_id, det_id, row_number() OVER (PARTITION BY page_id ORDER BY det_id) AS nth FROM good WHERE class_name = 'Formula' AND det_id % 2 = 0)
  SELECT page_id, det_id, printf('formula_%03d.png', nth) AS file FROM n"""
)
def failed_formulas(spark, sf_dir):
    """Names of the formula crops that no recogniser could read."""
    from ..operators.inference import failures

    rows = good(spark, sf_dir).filter("class_name = 'Formula'").select("page_id", "det_id", F.when(F.col("det_id") % 2 == 0, "").otherwise("x").alias("raw_content"), F.lit(None).cast("string").alias("error"))
    return failures(rows).select("page_id", "det_id", "file")


@query(
    CONFIDENT
    + """, t AS (SELECT page_id, CASE WHEN det_id % 3 = 0 THEN NULL WHEN det_id % 3 = 1 THEN '' ELSE 'grid' END AS a, CASE WHEN det_id % 2 = 0 THEN 'rows' END AS b FROM good WHERE class_name = 'Table')
  SELECT page_id, coalesce(nullif(a, ''), b, '') AS content, count(*) AS n FROM t GROUP BY ALL"""
)
def table_fallback(spark, sf_dir):
    """Table content from the structure model, else from coordinates, else none."""
    a = F.when(F.col("det_id") % 3 == 1, "").when(F.col("det_id") % 3 == 2, "grid")
    rows = good(spark, sf_dir).filter("class_name = 'Table'").select("page_id", T.first_table(a, F.when(F.col("det_id") % 2 == 0, "rows")).alias("content"))
    return rows.groupBy("page_id", "content").agg(F.count("*").alias("n"))
