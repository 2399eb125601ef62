"""Columns, gutters, visual lines and reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .detections import COLUMNS, SCHEMA, by_page

# Layout thresholds that results depend on.
BINS = 200
FULL_WIDTH = 0.70
LINE_OVERLAP = 0.30
CAPTION_REACH, CAPTION_TOUCH = 150, 50
INNER = (0.05, 0.95)
LEAST_GUTTER_BINS = 3
MOST_COLUMNS = 8

LINE_SCHEMA = SCHEMA + ", line long, ord long"


def visual_lines_page(rows: list[dict]) -> list[dict]:
    """Lines by running vertical extent: a box joins if 30 % of its own height lies in it; then left to right."""
    lines: list[list[dict]] = []
    low = high = 0.0
    for d in sorted(rows, key=lambda r: (r["y1"], r["det_id"])):
        share = max(0.0, min(d["y2"], high) - max(d["y1"], low)) / max(d["y2"] - d["y1"], 1) if lines else -1.0
        if share >= LINE_OVERLAP:
            lines[-1].append(d)
            low, high = min(low, d["y1"]), max(high, d["y2"])
        else:
            lines.append([d])
            low, high = d["y1"], d["y2"]
    place = {id(d): i for i, d in enumerate(sorted(rows, key=lambda r: (r["y1"], r["det_id"])))}
    out = []
    for n, line in enumerate(lines):
        for d in sorted(line, key=lambda r: (r["x1"], place[id(r)])):
            out.append(d | {"line": n, "ord": len(out)})
    return out


def visual_lines(dets: DataFrame) -> DataFrame:
    """detections with ``line`` and ``ord``, the geometric order within the page."""
    return by_page(dets, visual_lines_page, LINE_SCHEMA)


def reading_page(rows: list[dict]) -> list[dict]:
    """Visual lines of a page and, over them, the reading order, in one pass: captions wait for their nearest picture or table, footnotes come last."""
    placed = visual_lines_page(rows)
    holders = [d for d in placed if d["class_name"] in ("Picture", "Table")]
    keys = {}
    for d in placed:
        due = d["ord"]
        if d["class_name"] == "Caption":
            near = [(min(abs(d["y1"] - p["y2"]), abs(d["y2"] - p["y1"])), p["ord"]) for p in holders if min(abs(d["y1"] - p["y2"]), abs(d["y2"] - p["y1"])) < (CAPTION_REACH if min(d["x2"], p["x2"]) > max(d["x1"], p["x1"]) else CAPTION_TOUCH)]
            due = max(due, min(near)[1]) if near else due
        keys[d["ord"]] = (d["class_name"] == "Footnote", due, due > d["ord"], d["ord"])
    order = {k: n for n, k in enumerate(sorted(keys, key=keys.__getitem__), 1)}
    return [d | {"reading": order[d["ord"]]} for d in placed]


def reading_pages(dets: DataFrame) -> DataFrame:
    """detections with ``line``, ``ord`` and ``reading``."""
    return by_page(dets, reading_page, LINE_SCHEMA + ", reading long")


def caption_parents(dets: DataFrame, order: str = "det_id") -> DataFrame:
    """(page_id, det_id, parent_id, dist): the nearest picture or table of each caption that has one in reach; ``order`` breaks ties."""
    captions = dets.filter(F.col("class_name") == "Caption")
    holders = dets.filter(F.col("class_name").isin("Picture", "Table")).select(
        "page_id", F.col("det_id").alias("parent_id"), F.col(order).alias("parent_ord"), *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    dist = F.least(F.abs(F.col("y1") - F.col("py2")), F.abs(F.col("y2") - F.col("py1")))
    beside = F.least("x2", "px2") - F.greatest("x1", "px1")
    near = captions.join(holders, "page_id").withColumn("dist", dist).filter((F.col("dist") < CAPTION_REACH) & ((beside > 0) | (F.col("dist") < CAPTION_TOUCH)))
    best = near.groupBy("page_id", "det_id").agg(F.min(F.struct("dist", "parent_ord", "parent_id")).alias("best"))
    return best.select("page_id", "det_id", "best.parent_id", "best.dist")


def reading_order(dets: DataFrame, index: str = "ord") -> DataFrame:
    """Add ``reading``: boxes by ``index``, a caption right when its parent and it are both due, footnotes last.

    A topological order that always takes the smallest free index has a closed
    form here, as only captions have a parent and no parent is a caption: a
    caption goes at the larger of its own index and its parent's.
    """
    parents = caption_parents(dets, index).select("page_id", "det_id", "parent_id")
    held = dets.select("page_id", F.col("det_id").alias("parent_id"), F.col(index).alias("parent_index"))
    joined = dets.join(parents, ["page_id", "det_id"], "left").join(held, ["page_id", "parent_id"], "left")
    joined = joined.withColumn("due", F.greatest(F.col(index), F.coalesce("parent_index", F.col(index))))
    late = (F.col("due") > F.col(index)).cast("int")
    order = Window.partitionBy("page_id").orderBy((F.col("class_name") == "Footnote").cast("int"), "due", late, index)
    return joined.withColumn("reading", F.row_number().over(order).cast("long")).drop("due", "parent_index", "parent_id")


def zones(dets: DataFrame, width: float) -> DataFrame:
    """Add ``zone`` of the two-column split: full, left or right."""
    middle = width / 2
    wide = (F.col("x2") - F.col("x1") >= FULL_WIDTH * width) | ((F.col("x1") < middle - 0.2 * width) & (F.col("x2") > middle + 0.2 * width))
    centre = (F.col("x1") + F.col("x2")) / 2
    return dets.withColumn("zone", F.when(wide, "full").when(centre < middle, "left").otherwise("right"))


def narrow(dets: DataFrame, width: float) -> DataFrame:
    return dets.filter(F.col("x2") - F.col("x1") < FULL_WIDTH * width)


def covers(dets: DataFrame, width: float) -> DataFrame:
    """(page_id, covers): an array of how many narrow boxes lie over each of 200 vertical strips."""
    at = lambda c: F.greatest(F.lit(0), F.least(F.lit(BINS - 1), (F.col(c) / width * BINS).cast("int")))
    spans = narrow(dets, width).select("page_id", at("x1").alias("l"), at("x2").alias("r")).filter("r >= l")
    pages = spans.groupBy("page_id").agg(F.collect_list(F.struct("l", "r")).alias("spans"))
    count = lambda b: F.size(F.filter("spans", lambda s: (s["l"] <= b) & (s["r"] >= b)))
    return pages.select("page_id", F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), count).alias("covers"))


def coverage(dets: DataFrame, width: float) -> DataFrame:
    """(page_id, bin, cover): the same with a row for each strip, empty strips included."""
    rows = covers(dets, width).select("page_id", F.posexplode("covers").alias("bin", "cover"))
    return rows.select("page_id", F.col("bin").cast("long").alias("bin"), F.col("cover").cast("long").alias("cover"))


def gutters(cover: DataFrame, most: int = 0) -> DataFrame:
    """(page_id, g_start, g_end): runs of three or more strips with at most ``most`` boxes, within the inner 90 %."""
    low, high = int(BINS * INNER[0]), int(BINS * INNER[1])
    free = cover.filter((F.col("bin") >= low) & (F.col("bin") < high) & (F.col("cover") <= most))
    runs = free.withColumn("run", F.col("bin") - F.row_number().over(Window.partitionBy("page_id").orderBy("bin")))
    found = runs.groupBy("page_id", "run").agg(F.min("bin").alias("g_start"), F.max("bin").alias("g_end"), F.count("*").alias("n"))
    return found.filter(F.col("n") >= LEAST_GUTTER_BINS).select("page_id", "g_start", "g_end")


def two_column_votes(dets: DataFrame, width: float) -> DataFrame:
    """Votes of each page's narrow boxes: crossings of the middle band, boxes left and right; two columns if 3 and 3 with 2 crossings at most."""
    middle, band = width / 2, 0.08 * width
    crosses = (F.col("x1") < middle - band) & (F.col("x2") > middle + band)
    left = ~crosses & (F.col("x2") <= middle)
    right = ~crosses & ~left & (F.col("x1") >= middle)
    votes = narrow(dets, width).groupBy("page_id").agg(F.count_if(crosses).alias("crossing"), F.count_if(left).alias("left_items"), F.count_if(right).alias("right_items"))
    return votes.withColumn("two_columns", F.expr("crossing <= 2 and left_items >= 3 and right_items >= 3"))


def _free_runs(cover: list[int], most: int) -> list[tuple[int, int]]:
    """First and last strip of the runs of three or more with at most ``most`` boxes, within the inner 90 %."""
    runs, start = [], None
    low, high = int(BINS * INNER[0]), int(BINS * INNER[1])
    for b in range(low, high + 1):
        free = b < high and cover[b] <= most
        if free and start is None:
            start = b
        elif not free and start is not None:
            if b - start >= LEAST_GUTTER_BINS:
                runs.append((start, b - 1))
            start = None
    return runs


def _between(runs: list[tuple[int, int]], centres: list[float]) -> int | None:
    """Columns between gutters: empty edges trimmed; three or more, each with two boxes, or none."""
    filled: dict[int, int] = {}
    for c in centres:
        if 0 <= c < BINS:
            col = sum(last + 1 <= c for _, last in runs)
            filled[col] = filled.get(col, 0) + 1
    if not runs or not filled:
        return None
    wide = max(filled) - min(filled) + 1
    return min(wide, MOST_COLUMNS) if wide >= 3 and len(filled) == wide and min(filled.values()) >= 2 else None


def _apart(rows: list[dict], width: float, least_gap: float = 0.15, least_boxes: int = 2) -> tuple[int | None, list[float]]:
    """The fewest columns, three or more, whose n-1 largest centre gaps are wide enough and all hold two boxes; and the middles of those gaps in pixels."""
    centres = [c for c, _ in sorted(((r["x1"] + r["x2"]) / (2 * width), r["det_id"]) for r in rows)]
    if len(centres) < 6:
        return None, []
    ranked = sorted(range(len(centres) - 1), key=lambda i: (-(centres[i + 1] - centres[i]), i))
    for cols in range(3, 9):
        cut = sorted(ranked[: cols - 1])
        edges = [0, *[i + 1 for i in cut], len(centres)]
        if cols < len(centres) and len(cut) == cols - 1 and centres[ranked[cols - 2] + 1] - centres[ranked[cols - 2]] >= least_gap and min(y - x for x, y in zip(edges, edges[1:], strict=False)) >= least_boxes:
            return cols, [(centres[i] + centres[i + 1]) / 2 * width for i in cut]
    return None, []


def columns_of(rows: list[dict], width: float) -> tuple[int, list[float], list[float]]:
    """Columns of a page, 1 to 8: by empty gutters, then gutters with one box, then centre gaps, then the two-column vote.

    Also the middles of the empty gutters and of the centre gaps, in pixels.
    """
    slim = [r for r in rows if r["x2"] - r["x1"] < FULL_WIDTH * width]
    at = lambda x: max(0, min(BINS - 1, int(x / width * BINS)))
    cover = [0] * BINS
    for r in slim:
        for b in range(at(r["x1"]), at(r["x2"]) + 1):
            cover[b] += 1
    strict, relaxed = (_free_runs(cover, most) if slim else [] for most in (0, 1))
    centres = [(r["x1"] + r["x2"]) / 2 / width * BINS for r in slim]
    spread, gaps = _apart(slim, width)
    middle, band = width / 2, 0.08 * width
    crossing = [r["x1"] < middle - band and r["x2"] > middle + band for r in slim]
    left = sum(not x and r["x2"] <= middle for r, x in zip(slim, crossing, strict=True))
    right = sum(not x and r["x2"] > middle and r["x1"] >= middle for r, x in zip(slim, crossing, strict=True))
    voted = 2 if sum(crossing) <= 2 and left >= 3 and right >= 3 else 1
    return _between(strict, centres) or _between(relaxed, centres) or spread or voted, [(a + b) / 2 / BINS * width for a, b in strict], gaps


def column_counts(dets: DataFrame, width: float) -> DataFrame:
    """(page_id, columns) of every page, see ``columns_of``."""
    return by_page(dets, lambda rows: [{"page_id": rows[0]["page_id"], "columns": columns_of(rows, width)[0]}], "page_id long, columns long")


def place_page(rows: list[dict], width: float) -> list[dict]:
    """Rows with ``columns``, ``grp`` and ``place``: the group of its page's document that a box belongs to and its place there.

    Pages of one column have group 0 only. With two, group 0 is what spans the
    page, 1 and 2 are left and right. With more, group 0 is what is wide, then
    one for each column between the empty gutters; where those leave fewer than
    three columns with boxes, between the widest centre gaps, if there are any.
    Within a group boxes stand in reading order, or on pages of several columns
    in the geometric one where the former jumps back too often.
    """
    columns, gutters_at, gaps_at = columns_of(rows, width)
    middle = width / 2
    centre = lambda r: (r["x1"] + r["x2"]) / 2
    wide = lambda r: r["x2"] - r["x1"] >= FULL_WIDTH * width
    if columns == 1:
        group = lambda r: 0
    elif columns == 2:
        group = lambda r: 0 if wide(r) or (r["x1"] < middle - 0.2 * width and r["x2"] > middle + 0.2 * width) else 1 if centre(r) < middle else 2
    else:
        bounds = gutters_at
        if gutters_at and gaps_at and len({sum(centre(r) > b for b in bounds) for r in rows if not wide(r)}) < 3:
            bounds = gaps_at
        group = lambda r: 0 if wide(r) else 1 + sum(centre(r) > b for b in bounds)
    own: dict[int, list[dict]] = {}
    for r in rows:
        own.setdefault(group(r), []).append(r)
    out: list[dict] = []
    for g, members in sorted(own.items()):
        placed = reading_page(members)
        by = sorted(placed, key=lambda x: x["reading"])
        if columns > 1 and not monotonic_rows(by):
            by = sorted(placed, key=lambda x: x["ord"])
        out += [x | {"columns": columns, "grp": g, "place": i} for i, x in enumerate(by, 1)]
    return out


def placed(dets: DataFrame, width: float) -> DataFrame:
    """detections with ``columns``, ``grp`` and ``place``, see ``place_page``."""
    return by_page(dets, lambda rows: place_page(rows, width), SCHEMA + ", columns long, grp long, place long")


def monotonic_rows(rows: list[dict], most_back: float = 0.25, jump: float = 50.0) -> bool:
    """Whether at most a quarter of the steps jump back up by over 50 pixels; true under three boxes."""
    centres = [(d["y1"] + d["y2"]) / 2 for d in rows]
    back = sum(b < a - jump for a, b in zip(centres, centres[1:], strict=False))
    return len(rows) < 3 or back / (len(rows) - 1) <= most_back


def monotonic(dets: DataFrame, order: str, most_back: float = 0.25, jump: float = 50.0) -> DataFrame:
    """(page_id, monotonic): whether at most a quarter of the steps jump back up by over 50 pixels; true under three boxes."""
    centre = (F.col("y1") + F.col("y2")) / 2
    back = (centre < F.lag(centre).over(Window.partitionBy("page_id").orderBy(order)) - jump).cast("int")
    steps = dets.withColumn("back", back).groupBy("page_id").agg(F.count("*").alias("n"), F.sum("back").alias("back"))
    return steps.select("page_id", F.expr(f"n < 3 or coalesce(back, 0) / (n - 1) <= {most_back}").alias("monotonic"))


def assign_columns(dets: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add ``col``: how many of the page's sorted ``bounds`` lie left of the box centre."""
    centre = (F.col("x1") + F.col("x2")) / 2
    return dets.join(bounds, "page_id", "left").withColumn("col", F.coalesce(F.size(F.filter("bounds", lambda b: centre > b)), F.lit(0))).select(*COLUMNS, "col")


def list_boundaries(fragments: DataFrame, flag: str = "is_list_item", group: str = "page_id", order: str = "ord") -> DataFrame:
    """Add ``opens`` and ``closes``: where runs of list items begin and end."""
    w = Window.partitionBy(group).orderBy(order)
    before, after = (F.coalesce(f(flag).over(w), F.lit(False)) for f in (F.lag, F.lead))
    return fragments.withColumn("opens", F.col(flag) & ~before).withColumn("closes", F.col(flag) & ~after)
