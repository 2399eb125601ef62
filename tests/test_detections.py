import math

import pytest

from foliant.functions import geometry as G
from foliant.operators import detections as D
from foliant.operators import layout as L
from foliant.plans.fixture import HEIGHT, WIDTH, detections

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def good(spark):
    return D.confident(detections(spark, SF)).cache()


def det(i, kind, conf, x1, y1, x2, y2):
    return {"page_id": 1, "det_id": i, "class_name": kind, "confidence": conf, "x1": float(x1), "y1": float(y1), "x2": float(x2), "y2": float(y2)}


def test_confidence_is_inclusive(spark):
    df = spark.createDataFrame([det(1, "Text", 0.3, 0, 0, 1, 1), det(2, "Text", 0.29999, 0, 0, 1, 1)])
    assert [r["det_id"] for r in D.confident(df).collect()] == [1]


def test_suppression_boundaries():
    a, b = det(1, "Text", 0.9, 0, 0, 10, 10), det(2, "Text", 0.8, 0, 0, 10, 4)
    assert [d["det_id"] for d in D.nms_page([a, b])] == [1]  # 0.4 goes
    assert len(D.nms_page([a, b | {"class_name": "Table"}])) == 2
    assert len(D.detector_nms_page([a, b | {"y2": 7.0}])) == 2  # 0.7 stays
    assert [d["det_id"] for d in D.nms_page([b | {"confidence": 0.9}, a])] == [1]  # ties by ordinal
    assert len(D.detector_nms_page([det(i, "Text", 0.5, 20 * i, 0, 20 * i + 5, 5) for i in range(400)])) == 300


def test_overlaps_clip_and_protect():
    big, head = det(1, "Text", 0.9, 0, 0, 100, 100), det(2, "Section-header", 0.5, 10, 10, 50, 20)
    assert len(D.resolve_page([big, head])) == 2
    assert len(D.resolve_page([big, head | {"class_name": "List-item"}])) == 1
    low = det(3, "Table", 0.5, 0, 50, 100, 145)
    assert [(d["y1"], d["y2"]) for d in D.resolve_page([big, low]) if d["det_id"] == 3] == [(100.0, 145.0)]
    assert D.clip((0, 0, 10, 10), (20, 20, 30, 30)) == (0, 0, 10, 10)


def test_merging_by_gap():
    a = det(1, "Text", 0.5, 0, 0, 10, 10)
    for gap, n in ((0, 1), (7.9, 1), (8, 2), (-1, 2)):
        assert len(D.merge_page([a, det(2, "Text", 0.9, 0, 10 + gap, 10, 20 + gap)])) == n
    assert D.merge_page([a, det(2, "Text", 0.9, 0, 12, 10, 20)])[0]["confidence"] == 0.9
    assert len(D.merge_page([a | {"class_name": "List-item"}, det(2, "List-item", 0.9, 0, 12, 10, 20)])) == 2


def test_pages_equal_a_plain_run(spark, good):
    pages = {}
    for r in good.collect():
        pages.setdefault(r["page_id"], []).append(r.asDict())
    for rule in (D.nms_page, D.resolve_page, D.merge_page):
        want = {(d["page_id"], d["det_id"], d["x1"], d["y1"], d["x2"], d["y2"]) for rows in pages.values() for d in rule(sorted(rows, key=lambda r: r["det_id"]))}
        assert {(r["page_id"], r["det_id"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in D.by_page(good, rule).collect()} == want


def kahn(rows):
    """Smallest free index first; captions wait for their picture or table; footnotes sink."""
    parent = {}
    for i, d in enumerate(rows):
        if d["class_name"] == "Caption":
            best = math.inf
            for j, p in enumerate(rows):
                if p["class_name"] in ("Picture", "Table"):
                    dist = min(abs(d["y1"] - p["y2"]), abs(d["y2"] - p["y1"]))
                    beside = min(d["x2"], p["x2"]) - max(d["x1"], p["x1"])
                    if dist < 150 and (beside > 0 or dist < 50) and dist < best:
                        best, parent[i] = dist, j
    out, left = [], set(range(len(rows)))
    while left:
        i = min(x for x in left if parent.get(x) not in left)
        out.append(i)
        left.discard(i)
    return [rows[i]["det_id"] for i in out if rows[i]["class_name"] != "Footnote"] + [rows[i]["det_id"] for i in out if rows[i]["class_name"] == "Footnote"]


def test_reading_order_equals_a_topological_sort(spark, good):
    lines = L.visual_lines(good)
    pages = {}
    for r in lines.collect():
        pages.setdefault(r["page_id"], []).append(r.asDict())
    got = {}
    for r in sorted(L.reading_order(lines, "ord").collect(), key=lambda r: r["reading"]):
        got.setdefault(r["page_id"], []).append(r["det_id"])
    for page, rows in pages.items():
        assert got[page] == kahn(sorted(rows, key=lambda r: r["ord"]))


def test_columns(spark):
    def page(n, columns, rows=4):
        width = WIDTH / columns
        return [det(c * rows + r, "Text", 0.9, c * width + 12, 40 * r, (c + 1) * width - 12, 40 * r + 20) | {"page_id": n} for c in range(columns) for r in range(rows)]

    df = spark.createDataFrame([d for n in range(1, 6) for d in page(n, n)])
    got = {r["page_id"]: r["columns"] for r in L.column_counts(df, WIDTH).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}


def test_logo_only_where_the_corner_is_free(spark):
    df = spark.createDataFrame([det(1, "Text", 0.9, 0, 0, 10, 10), det(1, "Picture", 0.9, 800, 0, 900, 50) | {"page_id": 2}])
    rows = D.logo_rows(df, WIDTH, HEIGHT).collect()
    assert [(r["page_id"], r["det_id"], r["confidence"]) for r in rows] == [(1, 2, None)]


def test_geometry(spark):
    row = spark.range(1).select(
        G.iou(*[tuple(map(G.F.lit, b)) for b in ((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0))]).alias("iou"),
        G.containment(*[tuple(map(G.F.lit, b)) for b in ((0.0, 0.0, 0.0, 2.0), (1.0, 1.0, 3.0, 3.0))]).alias("none"),
        G.overlap_1d(*map(G.F.lit, (0.0, 4.0, 3.0, 5.0))).alias("half"),
        G.softmax(G.F.array(G.F.lit(1000.0), G.F.lit(1000.0))).alias("even"),
        G.resize_scale(G.F.lit(500), G.F.lit(700)).alias("up"), G.resize_scale(G.F.lit(3600), G.F.lit(3600)).alias("down"),
        G.cap_scale(G.F.lit(900), G.F.lit(3000)).alias("cap"),
    ).first()
    assert row["iou"] == pytest.approx(1 / 7) and row["none"] == 0 and row["half"] == 0.5 and row["even"] == [0.5, 0.5]
    assert row["up"] == pytest.approx(250 / 96) and row["down"] == 0.5 and row["cap"] == 1
