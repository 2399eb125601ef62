"""Box geometry as pure column expressions. A box is four columns: x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(suffix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{c}{suffix}") for c in ("x1", "y1", "x2", "y2"))


def area(b: tuple[Column, ...]) -> Column:
    """Area, 0 for a degenerate box."""
    x1, y1, x2, y2 = b
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; 0 where the union is empty."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def containment(inner: tuple[Column, ...], outer: tuple[Column, ...]) -> Column:
    """Share of ``inner`` that lies in ``outer``; 0 for a degenerate ``inner``."""
    own = area(inner)
    return F.when(own > 0, intersection(inner, outer) / own).otherwise(F.lit(0.0))


def overlap_1d(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Overlap of two intervals over the shorter one; 0 where that is empty."""
    shorter = F.least(a2 - a1, b2 - b1)
    return F.when(shorter > 0, F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1)) / shorter).otherwise(F.lit(0.0))


def pad_clamp(b: tuple[Column, ...], pad: float, width: float, height: float) -> list[Column]:
    """The box grown by ``pad`` on every side, within the page."""
    x1, y1, x2, y2 = b
    low, right, bottom = F.lit(0.0), F.lit(float(width)), F.lit(float(height))
    return [F.greatest(low, x1 - pad).alias("x1"), F.greatest(low, y1 - pad).alias("y1"), F.least(right, x2 + pad).alias("x2"), F.least(bottom, y2 + pad).alias("y2")]


def polygon_box(poly: str) -> list[Column]:
    """Bounding box of a flat [x, y, x, y, ...] array."""
    xs = F.filter(poly, lambda _, i: i % 2 == 0)
    ys = F.filter(poly, lambda _, i: i % 2 == 1)
    return [F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")]


def resize_scale(width: Column, height: Column, target_dpi: float = 250.0, source_dpi: float = 96.0) -> Column:
    """Scale that brings a page near the target density without growing large pages past 1,800 pixels.

    Pages whose shorter side has 1,200 pixels or more are not scaled up, but
    down to 1,800; scales under 0.5 stop there; scales within 5 % of 1 are 1.
    """
    shorter = F.least(width, height).cast("double")
    wanted = F.lit(target_dpi / source_dpi)
    scale = F.when((shorter >= 1200) & (wanted > 1), F.when(shorter > 1800, F.lit(1800.0) / shorter).otherwise(F.lit(1.0))).otherwise(wanted)
    scale = F.greatest(F.lit(0.5), scale)
    return F.when(F.abs(scale - 1) < 0.05, F.lit(1.0)).otherwise(scale)


def cap_scale(width: Column, height: Column, most: float = 1800.0) -> Column:
    """Scale that caps the shorter side, never above 1."""
    return F.least(F.lit(1.0), F.lit(most) / F.least(width, height))


def letterbox(width: Column, height: Column, side: int = 640, stride: int = 32) -> list[Column]:
    """Ratio and the two paddings of a stride-aligned letterbox."""
    ratio = F.least(F.lit(float(side)) / height, F.lit(float(side)) / width)
    gaps = [(F.lit(float(side)) - F.round(x * ratio)) % stride / 2 for x in (width, height)]
    return [ratio.alias("ratio"), F.round(gaps[0] - 0.1).cast("int").alias("left"), F.round(gaps[1] - 0.1).cast("int").alias("top")]


def softmax(scores: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def quad_area(points: Column) -> Column:
    """Shoelace area of an array of struct(x, y)."""
    n = F.size(points)
    turns = F.transform(F.sequence(F.lit(0), n - 1), lambda i: points[i]["x"] * points[(i + 1) % n]["y"] - points[(i + 1) % n]["x"] * points[i]["y"])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda a, x: a + x)) / 2


def corners(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    """A box from its centre and extent."""
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def crop_box(b: tuple[Column, ...], width: float, height: float) -> list[Column]:
    """Whole pixels of a crop, within the page."""
    low, right, bottom = F.lit(0.0), F.lit(float(width)), F.lit(float(height))
    return [F.greatest(low, b[0]).cast("int"), F.greatest(low, b[1]).cast("int"), F.least(right, b[2]).cast("int"), F.least(bottom, b[3]).cast("int")]


def valid_quad(points: Column, width: float, height: float, least: float = 0.15) -> Column:
    """Whether four corners cover at least 15 % of the page."""
    return (F.size(points) == 4) & (quad_area(points) >= least * width * height)


def corner_order(points: Column) -> Column:
    """Corners of struct(x, y) from the top left on: least sum, least difference y - x, largest sum, largest difference."""
    by = lambda key, sign: F.element_at(F.array_sort(F.transform(points, lambda p, i: F.struct((sign * key(p)).alias("k"), i.alias("i"), p.alias("p")))), 1)["p"]
    total, lean = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(by(total, 1), by(lean, 1), by(total, -1), by(lean, -1))


def line_crossing(rho1: Column, theta1: Column, rho2: Column, theta2: Column) -> tuple[Column, Column]:
    """Where two lines in polar form meet; null for parallel ones."""
    det = F.cos(theta1) * F.sin(theta2) - F.sin(theta1) * F.cos(theta2)
    apart = F.abs(det) >= 1e-6
    return F.when(apart, (F.sin(theta2) * rho1 - F.sin(theta1) * rho2) / det), F.when(apart, (F.cos(theta1) * rho2 - F.cos(theta2) * rho1) / det)


def scaled_box(b: tuple[Column, ...], sx: Column, sy: Column, pad: float, width: Column, height: Column) -> list[Column]:
    """A box moved to another resolution, padded and clamped."""
    low = F.lit(0.0)
    return [F.greatest(low, b[0] * sx - pad), F.greatest(low, b[1] * sy - pad), F.least(width, b[2] * sx + pad), F.least(height, b[3] * sy + pad)]
