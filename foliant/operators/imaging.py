"""Image statistics and pixel operators over decoded arrays.

Pixels travel as binary (row-major bytes, height, width, channels); numpy does
the work in Arrow batches. Equalisation, inpainting and contour search follow
the published methods and are approximate: their results are close to, not bit
for bit those of a given imaging library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the page-capture decisions.
PHOTO_ENTROPY = 0.55
LEAST_BIN_SHARE = 1e-4
GLARE, GLARE_SHARE = 230, 0.001
WHITE, CLEAN_WHITE = 250, 0.02
SKEW_LIMIT, SKEW_STEP, LEAST_SKEW = 15.0, 0.5, 0.5

IMAGE = "image_id long, height int, width int, channels int, data binary"


def decode(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    shape = (height, width) if channels == 1 else (height, width, channels)
    return np.frombuffer(data, np.uint8).reshape(shape)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB array, rounded; a grey array as it is."""
    if image.ndim == 2:
        return image
    return np.clip(np.rint(image[..., 0] * 0.299 + image[..., 1] * 0.587 + image[..., 2] * 0.114), 0, 255).astype(np.uint8)


def apply(images: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """One image operator over a table of decoded images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                out = work(decode(r.data, r.height, r.width, r.channels))
                rows.append((r.image_id, out.shape[0], out.shape[1], 1 if out.ndim == 2 else out.shape[2], out.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "height", "width", "channels", "data"])

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, IMAGE)


def capture_modality(pixels: DataFrame) -> DataFrame:
    """Per image of pixels(image_id, grey): occupied bins, their share, normalised entropy, modality and confidence.

    A bin counts as occupied from max(1, 0.01 % of the pixels); an entropy of
    0.55 or more is a photograph.
    """
    counts = pixels.groupBy("image_id", "grey").agg(F.count("*").alias("c"))
    totals = counts.groupBy("image_id").agg(F.sum("c").alias("n"))
    joined = counts.join(totals, "image_id").withColumn("p", F.col("c") / F.col("n"))
    occupied = F.count_if(F.col("c") >= F.greatest(F.lit(1), F.floor(F.col("n") * LEAST_BIN_SHARE)))
    entropy = F.sum(-F.col("p") * F.log2("p")) / 8
    out = joined.groupBy("image_id").agg(occupied.alias("occupied_bins"), entropy.alias("histogram_entropy"))
    away = F.least(F.lit(1.0), F.abs(F.col("histogram_entropy") - PHOTO_ENTROPY) / 0.5)
    return out.select(
        "image_id", F.when(F.col("histogram_entropy") >= PHOTO_ENTROPY, "camera").otherwise("screenshot").alias("modality"), "occupied_bins",
        F.lit(256).alias("total_bins"), (F.col("occupied_bins") / 256).alias("bin_occupancy_ratio"), "histogram_entropy", (0.5 + 0.5 * away).alias("confidence"),
    )


def pixel_report(pixels: DataFrame) -> DataFrame:
    """White share, glare share, RMS contrast and 90th percentile of the grey levels of each image."""
    g = F.col("grey")
    return pixels.groupBy("image_id").agg(
        F.avg((g > WHITE).cast("int")).alias("white_share"), F.avg((g > GLARE).cast("int")).alias("glare_share"), F.stddev_pop("grey").alias("contrast"), F.percentile("grey", 0.9).alias("background")
    )


def crop_branch(contrast: Column, background: Column) -> Column:
    """How a photographed crop is prepared: flat ones are binarised, dark ones equalised."""
    return F.when(contrast < 40, "binarise").when(background < 200, "equalise").otherwise("plain")


def channel_means(pixels: DataFrame) -> DataFrame:
    """(image_id, m0, m1, m2, gain0, gain1, gain2) of pixels(image_id, channel, grey): means, and what scales each to their common mean."""
    means = pixels.groupBy("image_id").agg(*[F.avg(F.when(F.col("channel") == i, F.col("grey"))).alias(f"m{i}") for i in range(3)]).na.drop(subset=["m0", "m1", "m2"])
    common = (F.col("m0") + F.col("m1") + F.col("m2")) / 3
    return means.select("*", *[(common / F.greatest(F.col(f"m{i}"), F.lit(1e-6))).alias(f"gain{i}") for i in range(3)])


def otsu(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold): the grey level that separates the two classes best."""
    from pyspark.sql import Window

    counts = pixels.groupBy("image_id", "grey").agg(F.count("*").alias("c"))
    low = Window.partitionBy("image_id").orderBy("grey")
    whole = Window.partitionBy("image_id")
    rows = counts.withColumn("w0", F.sum("c").over(low)).withColumn("s0", F.sum(F.col("c") * F.col("grey")).over(low))
    rows = rows.withColumn("w", F.sum("c").over(whole)).withColumn("s", F.sum(F.col("c") * F.col("grey")).over(whole)).filter("w0 < w")
    between = F.col("w0").cast("double") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), 2)
    return rows.groupBy("image_id").agg(F.max_by("grey", F.struct(F.round(between, 3), -F.col("grey"))).alias("threshold"))


def ink_box(pixels: DataFrame, dark: int = 200) -> DataFrame:
    """Bounding box of the pixels under ``dark`` after stretching each image's levels to 0-255; pixels(image_id, y, x, grey)."""
    ends = pixels.groupBy("image_id").agg(F.min("grey").alias("lo"), F.max("grey").alias("hi"))
    stretched = pixels.join(ends, "image_id").filter("hi > lo").withColumn("v", (F.col("grey") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo")))
    return stretched.filter(F.col("v") < dark).groupBy("image_id").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


def row_bands(pixels: DataFrame, axis: str = "y", least: int = 8, share: float = 0.05, merge: int = 0, dark: int = 128) -> DataFrame:
    """(image_id, lo, hi): bands of rows (or columns) with ink over ``share`` of the fullest; gaps under ``merge`` close."""
    from pyspark.sql import Window

    ink = pixels.groupBy("image_id", axis).agg(F.count_if(F.col("grey") < dark).alias("n"))
    most = F.max("n").over(Window.partitionBy("image_id"))
    full = ink.withColumn("_most", most).filter((F.col("n") >= share * F.col("_most")) & (F.col("n") > 0))
    w = Window.partitionBy("image_id").orderBy(axis)
    jump = F.col(axis) - F.lag(axis).over(w) > F.lit(max(1, merge))
    runs = full.withColumn("_f", F.coalesce(jump, F.lit(True)).cast("int")).withColumn("band", F.sum("_f").over(w))
    bands = runs.groupBy("image_id", "band").agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    return bands.filter(F.col("hi") - F.col("lo") + 1 >= least).select("image_id", "lo", "hi")


def box_mean(image: np.ndarray, size: int) -> np.ndarray:
    """Local mean over a square window, by an integral image with mirrored edges."""
    r = size // 2
    padded = np.pad(image.astype(np.float64), r, mode="reflect" if min(image.shape) > r else "edge")
    total = np.pad(padded, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / (size * size)


def gaussian(image: np.ndarray, size: int, sigma: float | None = None) -> np.ndarray:
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(size // 2, size // 2) if a == axis else (0, 0) for a in range(out.ndim)]
        out = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, np.pad(out, pad, mode="reflect" if out.shape[axis] > size // 2 else "edge"))
    return out


def _channels(image: np.ndarray, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return work(image) if image.ndim == 2 else np.dstack([work(image[..., c]) for c in range(image.shape[2])])


def remove_shadows(image: np.ndarray, size: int = 51, smooth: int = 5) -> np.ndarray:
    """Divide by a wide blur, scale to 128, smooth lightly."""
    return _channels(image, lambda c: gaussian(np.clip(c / np.maximum(gaussian(c, size), 1) * 128, 0, 255).astype(np.uint8), smooth).clip(0, 255).astype(np.uint8))


def remove_moire(image: np.ndarray, radius: int = 30, level: float = 97) -> np.ndarray:
    """Damp spectral spikes above the percentile beyond the radius, with a smoothed mask."""

    def one(channel: np.ndarray) -> np.ndarray:
        spectrum = np.fft.fftshift(np.fft.fft2(channel.astype(np.float64)))
        size = np.log1p(np.abs(spectrum))
        y, x = np.indices(channel.shape)
        far = np.hypot(y - channel.shape[0] // 2, x - channel.shape[1] // 2) > radius
        if not far.any():
            return channel
        mask = gaussian(1.0 - (far & (size > np.percentile(size[far], level))), 19, 3.0)
        return np.clip(np.abs(np.fft.ifft2(np.fft.ifftshift(spectrum * mask))), 0, 255).astype(np.uint8)

    return _channels(image, one)


def moire_score(image: np.ndarray, radius: int = 30) -> float:
    """Peak over mean of the high-frequency magnitudes of the green (or only) channel."""
    channel = image if image.ndim == 2 else image[..., 1]
    size = np.abs(np.fft.fftshift(np.fft.fft2(channel.astype(np.float64))))
    y, x = np.indices(channel.shape)
    far = size[np.hypot(y - channel.shape[0] // 2, x - channel.shape[1] // 2) > radius]
    return float(far.max() / far.mean()) if far.size and far.mean() > 0 else 0.0


def white_balance(image: np.ndarray) -> np.ndarray:
    """Gray world: channel means are scaled to their common mean."""
    means = image.reshape(-1, 3).mean(0)
    return np.clip(image * (means.mean() / np.maximum(means, 1e-6)), 0, 255).astype(np.uint8)


def regions(mask: np.ndarray) -> np.ndarray:
    """A number for each connected region of the mask (corners connect), from 1; 0 outside."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        padded = np.pad(label, 1)
        most = np.max([padded[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(3) for j in range(3)], axis=0)
        grown = np.where(mask, most, 0)
        # follow each region's number to the one that its own first pixel has by now
        grown = np.where(grown > 0, np.maximum(grown, np.append(0, grown.ravel())[grown]), 0)
        if (grown == label).all():
            break
        label = grown
    _, out = np.unique(label, return_inverse=True)
    return out.reshape(mask.shape) + (0 if (label == 0).any() else 1)


def glare_mask(image: np.ndarray, level: int = GLARE, least: int = 100) -> np.ndarray:
    """Bright regions, closed twice and grown once by a 5 by 5 window; each counts from ``least`` pixels on."""
    bright = (grey(image) > level).astype(np.uint8)
    for work in (dilate, dilate, erode, erode, dilate):
        bright = work(bright, 5)
    label = regions(bright > 0)
    sizes = np.bincount(label.ravel())
    return (label > 0) & (sizes[label] >= least)


def illumination_spread(image: np.ndarray, size: int = 51) -> float:
    """How unevenly a page is lit: the spread of the ratio of its wide blur to that blur's mean."""
    blur = gaussian(grey(image), size)
    return float(np.std(blur / max(blur.mean(), 1e-6)))


def suppress_glare(image: np.ndarray) -> np.ndarray:
    """Glare filled, then contrast equalised."""
    return equalise(remove_glare(image))


def remove_glare(image: np.ndarray, level: int = GLARE, size: int = 5) -> np.ndarray:
    """Fill glare from its surroundings, ring by ring; images with under 0.1 % glare stay."""
    mask = glare_mask(image, level)
    if mask.mean() < GLARE_SHARE or mask.all():
        return image

    def one(channel: np.ndarray) -> np.ndarray:
        out, known = channel.astype(np.float64), ~mask
        while not known.all():
            weight = box_mean(known.astype(np.float64), size)
            ring = ~known & (weight > 1e-9)
            if not ring.any():
                break
            out[ring] = (box_mean(out * known, size) / np.maximum(weight, 1e-9))[ring]
            known = known | ring
        return out.clip(0, 255).astype(np.uint8)

    return _channels(image, one)


def equalise(image: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of each channel, tiles blended bilinearly."""

    def one(channel: np.ndarray) -> np.ndarray:
        h, w = channel.shape
        th, tw = -(-h // tiles), -(-w // tiles)
        padded = np.pad(channel, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
        maps = np.zeros((tiles, tiles, 256))
        for i in range(tiles):
            for j in range(tiles):
                hist = np.bincount(padded[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256).astype(np.float64)
                most = max(1.0, clip * th * tw / 256)
                hist = np.minimum(hist, most) + np.maximum(hist - most, 0).sum() / 256
                maps[i, j] = hist.cumsum() * 255 / (th * tw)
        y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        fy, fx = (y - y0)[:, None], (x - x0)[None]
        at = lambda a, b: maps[np.clip(a, 0, tiles - 1)[:, None], np.clip(b, 0, tiles - 1)[None], channel]
        return np.clip((at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy, 0, 255).astype(np.uint8)

    return _channels(image, one)


def sauvola(image: np.ndarray, size: int = 31, k: float = 0.2, span: float = 128.0) -> np.ndarray:
    """Binarise by the local mean and spread."""
    g = grey(image).astype(np.float64)
    mean = box_mean(g, size)
    spread = np.sqrt(np.maximum(box_mean(g * g, size) - mean**2, 0))
    return np.where(g > mean * (1 + k * (spread / span - 1)), 255, 0).astype(np.uint8)


def rotate(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turn about the centre on a canvas that holds all of it, nearest pixel."""
    h, w = image.shape[:2]
    a = np.deg2rad(degrees)
    c, s = abs(np.cos(a)), abs(np.sin(a))
    nh, nw = int(h * c + w * s), int(h * s + w * c)
    y, x = np.indices((nh, nw))
    y, x = y - (nh - 1) / 2, x - (nw - 1) / 2
    sx = np.rint(np.cos(a) * x - np.sin(a) * y + (w - 1) / 2).astype(int)
    sy = np.rint(np.sin(a) * x + np.cos(a) * y + (h - 1) / 2).astype(int)
    out = np.full((nh, nw, *image.shape[2:]), fill, np.uint8)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def skew_angle(image: np.ndarray, limit: float = SKEW_LIMIT, step: float = SKEW_STEP) -> float:
    """The angle whose row sums change most sharply; the first of equals."""
    ink = 255 - grey(image)
    angles = np.arange(-limit, limit + step / 2, step)
    scores = [np.var(np.diff(rotate(ink, x, 0).sum(1).astype(np.float64))) for x in angles]
    return float(angles[int(np.argmax(scores))])


def deskew(image: np.ndarray) -> np.ndarray:
    angle = skew_angle(image)
    return image if abs(angle) < LEAST_SKEW else rotate(image, angle)


def perspective(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """Warp the quadrilateral (any corner order) onto an upright rectangle."""
    sums, diffs = quad.sum(1), np.diff(quad, axis=1)[:, 0]
    tl, br, tr, bl = quad[sums.argmin()], quad[sums.argmax()], quad[diffs.argmin()], quad[diffs.argmax()]
    w = int(max(np.linalg.norm(br - bl), np.linalg.norm(tr - tl)))
    h = int(max(np.linalg.norm(tr - br), np.linalg.norm(tl - bl)))
    target = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    rows = []
    for (x, y), (u, v) in zip(target, (tl, tr, br, bl), strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    m = np.append(np.linalg.solve(np.array(rows), np.array([tl, tr, br, bl], float).ravel()), 1).reshape(3, 3)
    y, x = np.indices((h, w))
    p = m @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    sx = np.clip(np.rint(p[0] / p[2]).astype(int), 0, image.shape[1] - 1)
    sy = np.clip(np.rint(p[1] / p[2]).astype(int), 0, image.shape[0] - 1)
    return image[sy, sx].reshape(h, w, *image.shape[2:])


def specular(image: np.ndarray, strength: float = 0.65, seed: int = 0) -> np.ndarray:
    """A synthetic bright spot at a place fixed by the seed."""
    h, w = image.shape[:2]
    rng = np.random.default_rng(seed)
    cy, cx = rng.uniform(0.2, 0.8) * h, rng.uniform(0.2, 0.8) * w
    y, x = np.indices((h, w))
    spot = strength * np.exp(-(((y - cy) / (0.25 * h)) ** 2 + ((x - cx) / (0.25 * w)) ** 2))
    spot = spot if image.ndim == 2 else spot[..., None]
    return np.clip(image + (255 - image.astype(np.float64)) * spot, 0, 255).astype(np.uint8)


def gradient(image: np.ndarray, strength: float = 0.5) -> np.ndarray:
    """A synthetic shadow that deepens along the diagonal."""
    y, x = np.indices(image.shape[:2])
    shade = 1 - strength * (y / max(1, image.shape[0] - 1) + x / max(1, image.shape[1] - 1)) / 2
    return np.clip(image * (shade if image.ndim == 2 else shade[..., None]), 0, 255).astype(np.uint8)


def _neighbourhood(image: np.ndarray, size: int, pick: Callable) -> np.ndarray:
    r = size // 2
    padded = np.pad(image, [(r, r), (r, r)] + [(0, 0)] * (image.ndim - 2), mode="edge")
    return pick(np.stack([padded[i : i + image.shape[0], j : j + image.shape[1]] for i in range(size) for j in range(size)]), axis=0)


def erode(image: np.ndarray, size: int = 3) -> np.ndarray:
    return _neighbourhood(image, size, np.min)


def dilate(image: np.ndarray, size: int = 3) -> np.ndarray:
    return _neighbourhood(image, size, np.max)


def bitmap(image: np.ndarray, level: int = 200) -> np.ndarray:
    return np.where(image < level, 0, image).astype(np.uint8)


def plasma(size: int, decay: float = 3.0, seed: int = 0) -> np.ndarray:
    """Diamond-square noise in [0, 1] on a power-of-two torus."""
    rng = np.random.default_rng(seed)
    field = np.zeros((size, size))
    step, spread = size, 1.0
    while step >= 2:
        half = step // 2
        corners = field[::step, ::step]
        around = corners + np.roll(corners, -1, 0)
        field[half::step, half::step] = (around + np.roll(around, -1, 1)) / 4 + spread * rng.uniform(-1, 1, corners.shape)
        centres = field[half::step, half::step]
        field[::step, half::step] = (corners + np.roll(corners, -1, 1) + centres + np.roll(centres, 1, 0)) / 4 + spread * rng.uniform(-1, 1, corners.shape)
        field[half::step, ::step] = (corners + np.roll(corners, -1, 0) + centres + np.roll(centres, 1, 1)) / 4 + spread * rng.uniform(-1, 1, corners.shape)
        step, spread = half, spread / decay
    field -= field.min()
    return field / max(field.max(), 1e-12)


def fog(image: np.ndarray, strength: float = 0.4, seed: int = 0) -> np.ndarray:
    side = 1 << int(np.ceil(np.log2(max(2, *image.shape[:2]))))
    veil = strength * plasma(side, seed=seed)[: image.shape[0], : image.shape[1]]
    veil = veil if image.ndim == 2 else veil[..., None]
    return np.clip(image * (1 - strength) + 255 * veil + image * 0.0 + (strength - veil) * image, 0, 255).astype(np.uint8)


def rain(image: np.ndarray, drops: int = 60, length: int = 8, seed: int = 0) -> np.ndarray:
    rng, out = np.random.default_rng(seed), image.copy()
    for y, x in zip(rng.integers(0, image.shape[0], drops), rng.integers(0, image.shape[1], drops), strict=True):
        out[y : y + length, x] = 200
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest-pixel resize."""
    y = np.minimum((np.arange(height) * image.shape[0] / height).astype(int), image.shape[0] - 1)
    x = np.minimum((np.arange(width) * image.shape[1] / width).astype(int), image.shape[1] - 1)
    return image[y][:, x]


def fit_square(image: np.ndarray, side: int = 384, fill: int = 0) -> np.ndarray:
    """Longest side to ``side``, centred on a square."""
    scale = side / max(image.shape[:2])
    small = resize(image, max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale)))
    out = np.full((side, side, *image.shape[2:]), fill, np.uint8)
    y, x = (side - small.shape[0]) // 2, (side - small.shape[1]) // 2
    out[y : y + small.shape[0], x : x + small.shape[1]] = small
    return out


def stitch(crops: list[np.ndarray], gap: int = 20) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Crops below each other on white, and each one's vertical span."""
    width = max(c.shape[1] for c in crops)
    parts, spans, at = [], [], 0
    for c in crops:
        parts += [np.pad(c, ((0, 0), (0, width - c.shape[1])), constant_values=255), np.full((gap, width), 255, np.uint8)]
        spans.append((at, at + c.shape[0]))
        at += c.shape[0] + gap
    return np.vstack(parts[:-1]), spans


def normalise(image: np.ndarray, entropy: float, white: float) -> np.ndarray:
    """The page clean-up: deskewed; screenshots and clean pages stop there, photographs get all corrections."""
    upright = deskew(image)
    if entropy < PHOTO_ENTROPY or white >= CLEAN_WHITE:
        return upright
    for step in (remove_glare, remove_shadows, remove_moire, equalise):
        upright = step(upright)
    return white_balance(upright) if upright.ndim == 3 else upright


def frame(image: np.ndarray, border: int, fill: int = 255) -> np.ndarray:
    return np.pad(image, [(border, border), (border, border)] + [(0, 0)] * (image.ndim - 2), constant_values=fill)


def prepare_crop(image: np.ndarray, screenshot: bool) -> np.ndarray:
    """A crop as a reader takes it: framed and capped; photographed ones in grey, binarised or equalised by their contrast and background."""
    border, most = (10, 960) if screenshot else (30, 1500)
    if not screenshot:
        image = grey(image)
        contrast, background = float(image.std()), float(np.percentile(image, 90))
        image = sauvola(image) if contrast < 40 else equalise(image) if background < 200 else image
    out = frame(image, border)
    scale = min(1.0, most / max(out.shape[:2]))
    return out if scale == 1 else resize(out, max(1, round(out.shape[0] * scale)), max(1, round(out.shape[1] * scale)))


def tensor(image: np.ndarray, side: int = 384, mean: float = 0.7931, spread: float = 0.1738) -> np.ndarray:
    """A formula crop as three equal normalised channels."""
    one = (fit_square(grey(image), side).astype(np.float32) / 255 - mean) / spread
    return np.repeat(one[None], 3, axis=0)


def table_tensor(image: np.ndarray, side: int = 800, means: tuple = (0.485, 0.456, 0.406), spreads: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    """A table crop with its longest side at ``side``, channels normalised."""
    scale = side / max(image.shape[:2])
    small = resize(image, max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale)))
    rgb = small if small.ndim == 3 else np.dstack([small] * 3)
    return ((rgb.astype(np.float32) / 255 - np.array(means, np.float32)) / np.array(spreads, np.float32)).transpose(2, 0, 1)


def thumbnail(image: np.ndarray, height: int, width: int, fill: int = 0, seed: int | None = None) -> np.ndarray:
    """Shrunk to fit and padded, centred or at a place fixed by the seed."""
    scale = min(1.0, height / image.shape[0], width / image.shape[1])
    small = resize(image, max(1, int(image.shape[0] * scale)), max(1, int(image.shape[1] * scale)))
    room = height - small.shape[0], width - small.shape[1]
    rng = None if seed is None else np.random.default_rng(seed)
    y, x = (n // 2 if rng is None else int(rng.integers(0, n + 1)) for n in room)
    out = np.full((height, width, *image.shape[2:]), fill, np.uint8)
    out[y : y + small.shape[0], x : x + small.shape[1]] = small
    return out


def training_view(image: np.ndarray, seed: int, side: int = 384) -> np.ndarray:
    """A training sample: trimmed to its ink, changed by one augmentation drawn by the seed, padded at random."""
    g = grey(image)
    dark = np.argwhere(g < 200)
    if len(dark):
        (y0, x0), (y1, x1) = dark.min(0), dark.max(0) + 1
        g = g[y0:y1, x0:x1]
    work = (lambda x: x, erode, dilate, bitmap, fog, rain, frost, shadow)[int(np.random.default_rng(seed).integers(0, 8))]
    return thumbnail(255 - work(g), side, side, seed=seed)


def evaluation_view(image: np.ndarray, side: int = 384) -> np.ndarray:
    """The same without chance."""
    g = grey(image)
    dark = np.argwhere(g < 200)
    if len(dark):
        (y0, x0), (y1, x1) = dark.min(0), dark.max(0) + 1
        g = g[y0:y1, x0:x1]
    return thumbnail(255 - g, side, side)


def disk(radius: int) -> np.ndarray:
    """A round kernel that sums to one."""
    y, x = np.indices((2 * radius + 1, 2 * radius + 1)) - radius
    kernel = (y * y + x * x <= radius * radius).astype(float)
    return kernel / kernel.sum()


def zoom(image: np.ndarray, factor: float) -> np.ndarray:
    """The middle of the image, enlarged to its size."""
    h, w = (max(1, int(np.ceil(n / factor))) for n in image.shape[:2])
    y, x = (image.shape[0] - h) // 2, (image.shape[1] - w) // 2
    return resize(image[y : y + h, x : x + w], *image.shape[:2])


def frost(image: np.ndarray, strength: float = 0.4, seed: int = 0) -> np.ndarray:
    """Crystals: thresholded noise blended over the image."""
    side = 1 << int(np.ceil(np.log2(max(2, *image.shape[:2]))))
    ice = 255 * (plasma(side, 1.7, seed)[: image.shape[0], : image.shape[1]] > 0.5)
    return np.clip(image * (1 - strength) + strength * (ice if image.ndim == 2 else ice[..., None]), 0, 255).astype(np.uint8)


def shadow(image: np.ndarray, strength: float = 0.5, seed: int = 0) -> np.ndarray:
    """A dark band from top to bottom, at places fixed by the seed."""
    h, w = image.shape[:2]
    edges = np.sort(np.random.default_rng(seed).uniform(0, w, (2, 2)), axis=1)
    y, x = np.indices((h, w))
    left, right = (edges[0, i] + (edges[1, i] - edges[0, i]) * y / max(1, h - 1) for i in (0, 1))
    dark = np.where((x >= left) & (x <= right), 1 - strength, 1.0)
    return (image * (dark if image.ndim == 2 else dark[..., None])).astype(np.uint8)


def line_clusters(lines: list[tuple[float, float]], angle: float = 15.0, apart: float = 50.0) -> list[tuple[float, float]]:
    """Lines (rho, theta) gathered around the first of each cluster, within 15 degrees and 50 pixels of it; the means stand for them."""
    seeds: list[list[tuple[float, float]]] = []
    for rho, theta in lines:
        for own in seeds:
            turn = abs(np.degrees(theta - own[0][1])) % 180
            if min(turn, 180 - turn) < angle and abs(rho - own[0][0]) < apart:
                own.append((rho, theta))
                break
        else:
            seeds.append([(rho, theta)])
    return [(float(np.mean([r for r, _ in own])), float(np.mean([t for _, t in own]))) for own in seeds]
