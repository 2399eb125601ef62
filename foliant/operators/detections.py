"""Filters, pair joins and sequential box rules over a detections table.

detections(page_id, det_id, class_name, confidence, x1, y1, x2, y2). Everything
is partitioned by page_id; det_id is the unique tie-breaker of every order. The
sequential rules (each step sees what earlier ones changed) run page after page over sorted
partitions, many pages to an Arrow batch; pages hold at most a few hundred boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, containment, iou, pad_clamp, softmax

# Label sets and thresholds that results depend on.
TEXT_CLASSES = ("Text", "Title", "Section-header", "Caption", "List-item", "Footnote", "Page-header", "Page-footer")
ROUTES = {**dict.fromkeys(TEXT_CLASSES, "text"), "Formula": "math", "Table": "table", "Picture": "image"}
PROTECTED = ("Section-header", "Page-header", "Title", "Caption")
NEVER_MERGED = ("List-item", "Section-header", "Title", "Caption")
LEAST_CONFIDENCE = 0.3
NMS_IOU = 0.4
DETECTOR_IOU = 0.7
CONTAINED = 0.80
CLIP_IOU = 0.3
MERGE_GAP = 8

COLUMNS = ["page_id", "det_id", "class_name", "confidence", "x1", "y1", "x2", "y2"]
_ARROW = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
SCHEMA = "page_id long, det_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def confident(dets: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    return dets.filter(F.col("confidence") >= least)


def without_headers(dets: DataFrame, height: float) -> DataFrame:
    """Drop section and page headers that end in the top 12 % of the page."""
    return dets.filter(~(F.col("class_name").isin("Section-header", "Page-header") & (F.col("y2") <= 0.12 * height)))


def scored(rows: DataFrame, logits: str, least: float) -> DataFrame:
    """Add ``label`` and ``score``: the best class of a softmax whose last class is none; scores over ``least`` stay."""
    shares = F.slice(softmax(F.col(logits)), F.lit(1), F.size(logits) - 1)
    found = rows.withColumn("_s", shares).withColumn("score", F.array_max("_s"))
    return found.withColumn("label", (F.array_position("_s", F.col("score")) - 1).cast("int")).filter(F.col("score") > least).drop("_s")


def sound_boxes(dets: DataFrame) -> DataFrame:
    return dets.filter("x2 > x1 and y2 > y1")


def routed(dets: DataFrame) -> DataFrame:
    """Add ``route``; rows of unknown classes are dropped."""
    route = F.coalesce(*[F.when(F.col("class_name") == k, F.lit(v)) for k, v in ROUTES.items()])
    return dets.withColumn("route", route).filter("route is not null")


def logo_remap(dets: DataFrame, white_share: str = "white_share", spread: str = "rgb_std") -> DataFrame:
    """Page headers whose crop looks like a logo become pictures."""
    logo = (F.col("class_name") == "Page-header") & ((1 - F.col(white_share)) < 0.15) & (F.col(spread) > 8)
    return dets.withColumn("class_name", F.when(logo, "Picture").otherwise(F.col("class_name")))


def padded(dets: DataFrame, pad: float, width: float, height: float) -> DataFrame:
    return dets.select("page_id", "det_id", "class_name", "confidence", *pad_clamp(box(), pad, width, height))


def pairs(dets: DataFrame, same_class: bool) -> DataFrame:
    """Unordered pairs of boxes of a page, with IoU and both containments."""
    other = dets.select("page_id", *[F.col(c).alias(f"{c}_b") for c in dets.columns if c != "page_id"])
    match = (F.col("class_name") == F.col("class_name_b")) if same_class else (F.col("class_name") != F.col("class_name_b"))
    found = dets.join(other, "page_id").filter((F.col("det_id") < F.col("det_id_b")) & match)
    a, b = box(), box("_b")
    return found.withColumns({"iou": iou(a, b), "a_in_b": containment(a, b), "b_in_a": containment(b, a)})


def best_recall(truth: DataFrame, found: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """For each true box the best IoU of a found box of its page; 0 where there is none."""
    other = found.select("page_id", *[F.col(c).alias(f"{c}_b") for c in ("x1", "y1", "x2", "y2")])
    best = truth.join(other, "page_id", "left").groupBy("page_id", "det_id").agg(F.max(F.coalesce(iou(box(), box("_b")), F.lit(0.0))).alias("best_iou"))
    return best.withColumn("hit", F.col("best_iou") >= least_iou)


def diagnosis(truth: DataFrame, found: DataFrame, least_iou: float = 0.5, held: float = 0.8) -> DataFrame:
    """One row: truths, recall, mean_iou of those hit, merge_rate: the share of found boxes that hold two true ones or more."""
    best = best_recall(truth, found, least_iou)
    own = truth.select("page_id", F.col("det_id").alias("t_id"), *[F.col(c).alias(f"{c}_b") for c in ("x1", "y1", "x2", "y2")])
    inside = found.select("page_id", "det_id", "x1", "y1", "x2", "y2").join(own, "page_id", "left").withColumn("in", F.coalesce(containment(box("_b"), box()) >= held, F.lit(False)))
    merged = inside.groupBy("page_id", "det_id").agg(F.count_if("in").alias("n"))
    share = lambda hits: F.round(hits / F.greatest(F.count("*"), F.lit(1)), 6)
    left = best.agg(F.count("*").alias("truths"), share(F.count_if("hit")).alias("recall"), F.round(F.avg(F.when(F.col("hit"), F.col("best_iou"))), 6).alias("mean_iou"), F.lit(1).alias("_k"))
    right = merged.agg(share(F.count_if(F.col("n") >= 2)).alias("merge_rate"), F.lit(1).alias("_k"))
    return left.join(right, "_k").drop("_k")


def _iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = _area(a) + _area(b) - both
    return both / union if union > 0 else 0.0


def _area(a) -> float:
    return max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1])


def _inside(inner, outer) -> float:
    own = _area(inner)
    w, h = min(inner[2], outer[2]) - max(inner[0], outer[0]), min(inner[3], outer[3]) - max(inner[1], outer[1])
    return max(0.0, w) * max(0.0, h) / own if own > 0 else 0.0


def by_page(dets: DataFrame, rule: Callable[[list[dict]], list[dict]], schema: str = SCHEMA, columns: tuple[str, ...] = tuple(COLUMNS), order: str = "det_id") -> DataFrame:
    """Apply a rule (list of row dicts in ``order`` -> list of row dicts) to every page.

    Partitions are sorted by page and read as a stream: one page at a time is
    held, and results leave with the batch in which a page ends.
    """
    names = [part.split()[0] for part in schema.split(", ")]
    target = pa.schema([(part.split()[0], _ARROW[part.split()[1]]) for part in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if page and row["page_id"] != page[0]["page_id"]:
                    out += rule(page)
                    page = []
                page.append(row)
            yield _batch(out)
        if page:
            yield _batch(rule(page))

    def _batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, target.types, strict=True)], schema=target)

    return dets.select(*columns).repartition("page_id").sortWithinPartitions("page_id", order).mapInArrow(run, schema)


def _box(d: dict) -> tuple:
    return d["x1"], d["y1"], d["x2"], d["y2"]


def nms_page(rows: list[dict], least_iou: float = NMS_IOU) -> list[dict]:
    """Greedy suppression within a class: by confidence, ties by ordinal; overlaps of ``least_iou`` or more go."""
    kept: list[dict] = []
    for d in sorted(rows, key=lambda r: (-r["confidence"], r["det_id"])):
        if all(k["class_name"] != d["class_name"] or _iou(_box(k), _box(d)) < least_iou for k in kept):
            kept.append(d)
    return kept


def detector_nms_page(rows: list[dict], most_iou: float = DETECTOR_IOU, most: int = 300) -> list[dict]:
    """The detector's own suppression: an overlap of exactly ``most_iou`` stays; the best 300 remain."""
    kept: list[dict] = []
    for d in sorted(rows, key=lambda r: (-r["confidence"], r["det_id"])):
        b = _box(d)
        for k in kept:
            a = _box(k)
            both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            if both / (_area(a) + _area(b) - both + 1e-9) > most_iou:
                break
        else:
            kept.append(d)
    return kept[:most]


def clip(own: tuple, other: tuple) -> tuple:
    """Cut the other box off on the side that leaves the most; unchanged if no side does."""
    x1, y1, x2, y2 = own
    sides = [
        (y1 < other[3] < y2, (x1, other[3], x2, y2)),
        (y1 < other[1] < y2, (x1, y1, x2, other[1])),
        (x1 < other[2] < x2, (other[2], y1, x2, y2)),
        (x1 < other[0] < x2, (x1, y1, other[0], y2)),
    ]
    left = [b for fits, b in sides if fits and _area(b) > 0]
    return max(left, key=_area) if left else own


def resolve_page(rows: list[dict]) -> list[dict]:
    """Largest first: drop boxes mostly inside a larger one (headings stay), clip the less confident of other overlaps."""
    left = sorted(rows, key=lambda r: (-_area(_box(r)), r["det_id"]))
    gone: set[int] = set()
    for i in range(len(left)):
        for j in range(i + 1, len(left)):
            if i in gone:
                break
            if j in gone:
                continue
            a, b = _box(left[i]), _box(left[j])
            if _inside(b, a) >= CONTAINED:
                if left[j]["class_name"] not in PROTECTED:
                    gone.add(j)
            elif _iou(a, b) > CLIP_IOU:
                k, new = (j, clip(b, a)) if left[j]["confidence"] <= left[i]["confidence"] else (i, clip(a, b))
                left[k] = left[k] | dict(zip(("x1", "y1", "x2", "y2"), new, strict=True))
    return [d for i, d in enumerate(left) if i not in gone]


def merge_page(rows: list[dict], gap: float = MERGE_GAP) -> list[dict]:
    """Join boxes of a class that stand closely below each other; headings, captions and list items never."""
    out: list[dict] = []
    for kind in dict.fromkeys(r["class_name"] for r in rows):
        own = [r for r in rows if r["class_name"] == kind]
        if kind in NEVER_MERGED:
            out += own
            continue
        run: list[dict] = []
        for d in sorted(own, key=lambda r: ((r["y1"] + r["y2"]) / 2, r["det_id"])):
            if run:
                p = run[-1]
                narrow = min(p["x2"] - p["x1"], d["x2"] - d["x1"])
                shared = max(0.0, min(p["x2"], d["x2"]) - max(p["x1"], d["x1"])) / narrow if narrow > 0 else 0.0
                if 0 <= d["y1"] - p["y2"] < gap and shared > 0.5:
                    run[-1] = p | {"x1": min(p["x1"], d["x1"]), "y1": min(p["y1"], d["y1"]), "x2": max(p["x2"], d["x2"]), "y2": max(p["y2"], d["y2"]), "confidence": max(p["confidence"], d["confidence"])}
                    continue
            run.append(d)
        out += run
    return out


def postprocess_page(rows: list[dict], width: float, height: float) -> list[dict]:
    """Confidence, suppression, overlap resolution, merging and padding, in that order."""
    left = merge_page(resolve_page(nms_page([r for r in rows if r["confidence"] >= LEAST_CONFIDENCE])))
    return [r | {"x1": max(0.0, r["x1"] - 2), "y1": max(0.0, r["y1"] - 2), "x2": min(width, r["x2"] + 2), "y2": min(height, r["y2"] + 2)} for r in left]


def accept_new_page(rows: list[dict], most_iou: float = 0.4) -> list[dict]:
    """Of rows marked ``offered`` those that overlap no box of their class by more than ``most_iou``; accepted ones count for the next."""
    kept, added = [r for r in rows if not r["offered"]], []
    for d in (r for r in rows if r["offered"]):
        if all(k["class_name"] != d["class_name"] or _iou(_box(k), _box(d)) <= most_iou for k in kept):
            kept.append(d)
            added.append(d)
    return added


def accepted(dets: DataFrame, offered: DataFrame, most_iou: float = 0.4) -> DataFrame:
    """Supplementary boxes that may join a page's detections, in order of their ids."""
    both = dets.select(*COLUMNS, F.lit(False).alias("offered")).unionByName(offered.select(*COLUMNS, F.lit(True).alias("offered")))
    return by_page(both, lambda rows: accept_new_page(rows, most_iou), columns=(*COLUMNS, "offered"))


def logo_rows(dets: DataFrame, width: float, height: float) -> DataFrame:
    """A synthetic picture in the top right corner (25 % by 6.5 %) of every page that has none there."""
    x1, y2 = 0.75 * width, 0.065 * height
    taken = dets.filter((F.col("class_name") == "Picture") & (F.col("x2") > x1) & (F.col("y1") < y2)).select("page_id").distinct()
    free = dets.groupBy("page_id").agg(F.max("det_id").alias("last")).join(taken, "page_id", "left_anti")
    corner: list[Column] = [F.lit(v).alias(c) for c, v in (("x1", x1), ("y1", 0.0), ("x2", float(width)), ("y2", y2))]
    return free.select("page_id", (F.col("last") + 1).alias("det_id"), F.lit("Picture").alias("class_name"), F.lit(None).cast("double").alias("confidence"), *corner)
