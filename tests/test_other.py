import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import imaging, inference, tables
from foliant.sources import sinks
from foliant.sources import tables as sources
from foliant.streaming import feed


def test_sources(spark, tmp_path):
    page = {"page_info": {"image_path": "a.png", "width": 10, "height": 20, "page_attribute": "{'language': 'english', 'layout': 'x'}"},
            "layout_dets": [{"category_type": "equation_isolated", "poly": [1, 2, 5, 2, 5, 8, 1, 8], "latex": "x", "ignore": False}, {"category_type": "text", "poly": [], "latex": "", "ignore": False}]}
    (tmp_path / "gt.json").write_text(json.dumps([page]))
    row = sources.gt_formulas(sources.gt_pages(spark, str(tmp_path / "gt.json"))).first()
    assert tuple(row) == ("a.png", "x", 1.0, 2.0, 5.0, 8.0)
    (tmp_path / "fox.json").write_text(json.dumps([{"image": "i", "conversations": [{"value": "q"}, {"value": f" {v}\n"}]} for v in "ab"]))
    assert [tuple(r) for r in sources.answers(spark, str(tmp_path / "fox.json")).collect()] == [("i", "b")]
    (tmp_path / "c.txt").write_text(" a b \nc\n")
    assert [tuple(r) for r in sources.corpus_lines(spark, str(tmp_path / "c.txt")).collect()] == [(0, "a b"), (1, "c")]
    (tmp_path / "d.tsv").write_text("x\tNone\ny\t1\ny\t2\n")
    assert {r["token"]: r["replacement"] for r in sources.dictionary(spark, str(tmp_path / "d.tsv")).collect()} == {"x": "", "y": "2"}
    lines = spark.createDataFrame(list(enumerate(["G", "  a", "H", "  b"])), "line_no long, text string")
    assert [tuple(r) for r in sources.design_tokens(lines, ("H",)).collect()] == [("G", "a")]


def test_sinks(spark, tmp_path):
    sinks.write_documents(spark.createDataFrame([(1, "a"), (2, None)], "page_id long, tex string"), str(tmp_path / "o"))
    assert {r["page_id"]: r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()} == {1: "a"} or spark.read.text(str(tmp_path / "o")).count() == 2
    lines = spark.createDataFrame([(0, "a", "A", None), (1, "b", None, "bad")], "line_no long, text string, result string, error string")
    sinks.write_with_errors(lines, str(tmp_path / "l"), str(tmp_path / "e"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["A", "b"] and spark.read.text(str(tmp_path / "e")).first()[0] == "1\tbad"


def test_table_grid(spark):
    tokens = spark.createDataFrame([(1, 1, i, t, *map(float, b)) for i, (t, b) in enumerate([("a", (0, 10, 0, 10)), ("b", (52, 60, 0, 10)), ("c", (0, 10, 30, 40)), ("c2", (12, 20, 30, 40)), ("---", (0, 9, 50, 60))])], "page_id long, det_id long, tok_id long, text string, x1 double, x2 double, y1 double, y2 double")
    boxes = [("table row", 0.9, 0, 0, 100, 20), ("table row", 0.9, 0, 25, 100, 45), ("table column header", 0.9, 50, 0, 100, 45), ("table column", 0.9, 0, 0, 45, 45), ("table column", 0.9, 0, 0, 99, 45), ("table row", 0.5, 0, 60, 100, 80)]
    axes = tables.axes(spark.createDataFrame([(1, 1, *map(float_or, b)) for b in boxes], "page_id long, det_id long, label string, score double, x1 double, y1 double, x2 double, y2 double"), 100)
    cells = tables.grid(tables.table_tokens(tokens, 100), axes)
    assert tables.grid_html(cells).first()["html"] == '<table border="1"><tr><td>a</td><td>b</td></tr><tr><td>c c2</td><td></td></tr></table>'
    assert {r["tok_id"]: r["row"] for r in tables.running_rows(tokens).collect()} == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}
    assert [r["text"] for r in tables.ocr_lines(tokens).orderBy("line").collect()] == ["a b", "cc2", "---"]


def float_or(x):
    return float(x) if isinstance(x, int) else x


def test_images(spark):
    rng = np.random.default_rng(0)
    photo, flat = rng.integers(0, 256, (32, 32), dtype=np.uint8), np.full((32, 32), 255, np.uint8)
    rows = [(i, int(v)) for i, image in enumerate((photo, flat)) for v in image.ravel()]
    got = {r["image_id"]: r for r in imaging.capture_modality(spark.createDataFrame(rows, "image_id long, grey int")).collect()}
    assert got[0]["modality"] == "camera" and got[1]["modality"] == "screenshot" and got[1]["occupied_bins"] == 1
    two = np.where(np.indices((20, 20))[0] < 10, 30, 220)
    threshold = imaging.otsu(spark.createDataFrame([(1, int(v)) for v in two.ravel()], "image_id long, grey int")).first()["threshold"]
    assert 30 <= threshold < 220
    bars = np.full((60, 40), 255, np.uint8)
    bars[10:20], bars[35:50] = 0, 0
    pixels = spark.createDataFrame([(1, y, x, int(bars[y, x])) for y in range(60) for x in range(40)], "image_id long, y int, x int, grey int")
    assert sorted((r["lo"], r["hi"]) for r in imaging.row_bands(pixels).collect()) == [(10, 19), (35, 49)]
    assert tuple(imaging.ink_box(pixels).first())[1:] == (0, 10, 39, 49)
    table = spark.createDataFrame([(1, 32, 32, 1, photo.tobytes())], imaging.IMAGE)
    assert imaging.apply(table, imaging.sauvola).first()["data"] == imaging.sauvola(photo).tobytes()


def test_pixel_operators():
    text = np.full((80, 120), 255, np.uint8)
    text[20:60:10, 20:100] = 0
    turned = imaging.rotate(text, -4)
    assert imaging.skew_angle(turned, 6) == pytest.approx(4, abs=1)
    glare = np.full((40, 40), 100, np.uint8)
    glare[10:25, 10:25] = 255
    assert imaging.remove_glare(glare).max() < 200
    rgb = np.dstack([np.full((8, 8), v, np.uint8) for v in (50, 100, 150)])
    assert np.ptp(imaging.white_balance(rgb).reshape(-1, 3).mean(0)) <= 1
    assert imaging.perspective(text, np.array([[0, 0], [119, 0], [119, 79], [0, 79]])).shape == (79, 119)
    for f in (imaging.remove_shadows, imaging.remove_moire, imaging.equalise, imaging.erode, imaging.dilate, imaging.bitmap, imaging.fog, imaging.rain, imaging.specular, imaging.gradient):
        assert f(text).shape == text.shape and f(text).dtype == np.uint8
    assert (imaging.specular(text, seed=3) == imaging.specular(text, seed=3)).all() and imaging.fit_square(text, 64).shape == (64, 64)
    page, spans = imaging.stitch([text, text[:10]])
    assert page.shape == (110, 120) and spans == [(0, 80), (100, 110)]


def test_inference_boundary(spark):
    def model():
        def run(crops):
            if any(c == b"bad" for c in crops):
                raise ValueError("bad crop")
            return inference.stub(crops)

        return run

    crops = spark.createDataFrame([(1, i, "math", bytearray(b"bad" if i == 2 else b"ok")) for i in range(5)], "page_id long, det_id long, route string, data binary")
    got = inference.recognise(crops, model).collect()
    assert [bool(r["error"]) for r in sorted(got, key=lambda r: r["det_id"])] == [False, False, True, False, False]
    assert inference.failures(inference.recognise(crops, model)).first()["file"] == "formula_001.png"
    assert inference.routed_recognise(crops, {"math": model}).count() == 5


def test_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.png", "b.JPG", "c.txt"):
        (tmp_path / "in" / name).write_bytes(b"x")
    work = lambda jobs: jobs.select("job_id", F.lit("done").alias("status"), F.lit("").alias("message"), F.lit("tex").alias("tex"))
    for n in (2, 3):
        feed.run_jobs(feed.uploads(spark, str(tmp_path / "in")), work, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / "d.webp").write_bytes(b"y")
    table = spark.createDataFrame([("j1", "done", 1), ("j2", "queued", 3), ("j3", "queued", 2)], "job_id string, status string, queued_at long")
    assert {r["job_id"]: r["position"] for r in feed.positions(table).collect()} == {"j3": 1, "j2": 2}


def test_more_pixel_operators():
    text = np.full((80, 120), 255, np.uint8)
    text[20:60:10, 20:100] = 0
    mask = np.zeros((30, 30), bool)
    mask[2:6, 2:6], mask[6, 6], mask[20:29, 10:29] = True, True, True
    label = imaging.regions(mask)
    assert label.max() == 2 and (label[mask] > 0).all() and len(set(label[2:7, 2:7][mask[2:7, 2:7]])) == 1 and (imaging.regions(~np.zeros((3, 3), bool)) == 1).all()
    spots = np.full((60, 60), 100, np.uint8)
    spots[5:8, 5:8], spots[30:50, 30:50] = 255, 255
    found = imaging.glare_mask(spots, least=200)
    assert found[40, 40] and not found[6, 6]
    for f in (imaging.frost, imaging.shadow, imaging.suppress_glare, lambda x: imaging.zoom(x, 1.5)):
        assert f(text).shape == text.shape and f(text).dtype == np.uint8
    assert imaging.prepare_crop(text, True).shape == (100, 140) and imaging.prepare_crop(np.dstack([text] * 3), False).shape == (140, 180)
    assert max(imaging.prepare_crop(np.full((2_000, 300), 9, np.uint8), True).shape) == 960
    assert imaging.tensor(text).shape == (3, 384, 384) and imaging.table_tensor(text).shape == (3, 533, 800)
    assert imaging.thumbnail(text, 40, 200).shape == (40, 200) and (imaging.thumbnail(text, 90, 130, seed=1) == imaging.thumbnail(text, 90, 130, seed=1)).all()
    assert imaging.training_view(text, 5).shape == (384, 384) and imaging.evaluation_view(text).max() == 255
    assert imaging.disk(2).sum() == pytest.approx(1) and (imaging.disk(2) > 0).sum() == 13
    assert imaging.illumination_spread(text) < imaging.illumination_spread(imaging.gradient(np.full((80, 120), 255, np.uint8)) // 2)
    assert imaging.line_clusters([(10, 0.0), (30, 0.1), (100, 0.0), (12, 3.14)]) == [(pytest.approx(52 / 3), pytest.approx(3.24 / 3)), (100.0, 0.0)]


def test_more_sources(spark, tmp_path):
    page = {"page_info": {"image_path": "a.png", "width": 10, "height": 20, "page_attribute": "{'language': 'english'}"},
            "layout_dets": [{"category_type": "equation_isolated", "poly": [1, 2, 50, 2, 50, 80, 1, 80], "latex": x, "ignore": False} for x in "xyz"] + [{"category_type": "equation_isolated", "poly": [1, 2, 5, 2, 5, 8, 1, 8], "latex": "s", "ignore": False}]}
    (tmp_path / "gt.json").write_text(json.dumps([page]))
    assert [tuple(r)[:3] for r in sources.formula_crops(sources.gt_pages(spark, str(tmp_path / "gt.json")), 2).collect()] == [("f0000", "a.png", "x"), ("f0001", "a.png", "y")]
    (tmp_path / "sets" / "one").mkdir(parents=True)
    (tmp_path / "sets" / "two").mkdir()
    (tmp_path / "sets" / "one" / "a.txt").write_text("x\n y \n")
    (tmp_path / "sets" / "two" / "a.txt").write_text("z\n")
    assert sorted(map(tuple, sources.named_sets(spark, str(tmp_path / "sets")).collect())) == [("one", "x"), ("one", "y"), ("two", "z")]
    lines = sources.corpus_lines(spark, [str(tmp_path / "sets" / d / "a.txt") for d in ("one", "two")])
    assert sorted(map(tuple, lines.collect())) == [(0, "x"), (1, "y"), (2, "z")]
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}}))
    vocabulary, merges = sources.tokenizer_parts(spark, str(tmp_path / "t.json"))
    assert {tuple(r) for r in vocabulary.collect()} == {("a", 0), ("b", 1), ("ab", 2)} and [tuple(r) for r in merges.collect()] == [(0, "a", "b", "ab")]
    (tmp_path / "k.txt").write_text("a\n\nb\na\n")
    assert sorted(r["token"] for r in sources.keep_list(spark, str(tmp_path / "k.txt")).collect()) == ["a", "b"]
    (tmp_path / "c.tsv").write_text("i1\tone\ni2\ttwo\n")
    first, again = ([tuple(r) for r in sources.captions(spark, str(tmp_path / "c.tsv"), 3).collect()] for _ in range(2))
    assert first == again and sorted(first) == [("i1", "one"), ("i2", "two")]
    (tmp_path / "0000001.png").write_bytes(b"p")
    images = sources.images(spark, str(tmp_path / "*.png"))
    pairs = sources.image_text_pairs(images, spark.createDataFrame([(0, "a"), (1, "b")], "line_no long, text string"))
    assert [tuple(r) for r in pairs.collect()] == [(bytearray(b"p"), "b")]


def test_job_states(spark, tmp_path):
    start, dated = 1_700_000_000, []
    files = [
        [("j1", 1, 0, "queued"), ("j2", 1, 0, "queued"), ("j1", 2, 1, "processing")],
        [("j3", 1, 400, "queued"), ("j2", 2, 390, "processing"), ("j2", 3, 390, "done")],
        [("j4", 1, 1000, "queued")],
        [("j5", 1, 1001, "queued")],
    ]
    for i, rows in enumerate(files):
        frame = spark.createDataFrame([(j, s, t + start, x) for j, s, t, x in rows], "job_id string, seq long, at long, status string")
        frame.withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for made in set((tmp_path / "in").glob("part-*")) - set(dated):
            os.utime(made, (start + i, start + i))
            dated.append(made)
    changes = spark.readStream.schema("job_id string, seq long, at timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = feed.job_states(changes).writeStream.format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "cp"))
    out.trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.table("job_states").select("job_id", "status", (F.unix_millis("at") / 1000 - start).cast("long")).collect()}
    assert got >= {("j1", "processing", 1), ("j1", "error", 301), ("j1", "forgotten", 901), ("j2", "queued", 0), ("j2", "done", 390), ("j2", "forgotten", 990)}
    assert got - {(f"j{n}", "queued", t) for n, t in ((3, 400), (4, 1000), (5, 1001))} == {r for r in got if r[0] in ("j1", "j2")} and len(got) == 9
