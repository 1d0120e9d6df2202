"""Neighbourhood operators beyond rectangles: blurs, gradients, elliptic kernels, borders, holes and resampling.

Rasters are sparse (raster_id, y, x, v) and an absent pixel is 0. Kernels run on tiles with a
border of neighbours (tiles.py). Outside the raster a blur mirrors (the edge pixel itself isn't
repeated), a median repeats the edge, and minimum and maximum ignore what is outside.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .components import component_pixels, exploded, label_given, label_runs, runs
from .pixels import KEY, close_rect, erode_rect, gray, without

#: The derivative and smoothing taps of the gradient kernels, by size.
SOBEL = {3: ([-1, 0, 1], [1, 2, 1]), 5: ([-1, -2, 0, 2, 1], [1, 4, 6, 4, 1])}

#: The steps of the 3 x 3 chamfer measure.
STRAIGHT, DIAGONAL = 0.955, 1.3693


def taps(k: int, sigma: float) -> list[float]:
    """Weights of a Gaussian of k taps; sigma 0 gives the binomial row for 3 and 5, as blurs without a sigma use."""
    if sigma == 0:
        row = [math.comb(k - 1, i) for i in range(k)]
    else:
        row = [math.exp(-((i - k // 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [w / sum(row) for w in row]


def gaussian_blur(p: DataFrame, k: int, sigma: float, width: int, height: int) -> DataFrame:
    t = taps(k, sigma)
    return tiles.on_tiles(p, k // 2, width, height, lambda a: tiles.weighed(t, 0)(tiles.weighed(t, 1)(a)))


def pyr_down(p: DataFrame, width: int, height: int) -> DataFrame:
    """Blurred, and every second row and column of it: half the side, a quarter of the pixels."""
    return gaussian_blur(p, 5, 0, width, height).where("x % 2 = 0 AND y % 2 = 0").select("raster_id", (F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), "v")


def median_blur(p: DataFrame, k: int, width: int, height: int) -> DataFrame:
    """Median over a k x k square; the edge is repeated outside."""
    return tiles.on_tiles(p, k // 2, width, height, tiles.median(k))


def sobel_gradient(p: DataFrame, k: int, cutoff: float, width: int, height: int) -> DataFrame:
    """Pixels whose horizontal and vertical gradients add up to more than the cutoff, as 255."""
    slope, smooth = SOBEL[k]

    def steep(a):
        across = tiles.weighed(smooth, 0)(tiles.weighed(slope, 1)(a))
        down = tiles.weighed(slope, 0)(tiles.weighed(smooth, 1)(a))
        return (across + down > cutoff) * 255.0

    return tiles.on_tiles(p, k // 2, width, height, steep)


def gradient_closed(p: DataFrame, size: int, iterations: int, width: int, height: int) -> DataFrame:
    g = sobel_gradient(p, 5, 3, width, height)
    return close_rect(erode_rect(g, 5, 1, width, height), size, iterations, width, height)


def height_quantise(p: DataFrame, low: float, high: float, close_size: int, close_iterations: int, width: int, height: int, cutoff: float = 50) -> DataFrame:
    """(raster_id, y, x, label): 0 below `low`, else 1 up to `high` and 2 above it, plus 2 where the blurred raster is steep.

    Steep is where the gradients of size 5 add up to more than the cutoff, eroded and closed.
    """
    steep = sobel_gradient(gaussian_blur(p, 5, 0, width, height), 5, cutoff, width, height)
    steep = close_rect(erode_rect(steep, 5, 1, width, height), close_size, close_iterations, width, height).select(*KEY, F.lit(2).alias("steep"))
    label = F.when(F.col("v") < low, 0).otherwise(F.when(F.col("v") > high, 2).otherwise(1) + F.coalesce("steep", F.lit(0)))
    return p.join(steep, KEY, "left").select(*KEY, label.alias("label"))


def ellipse(k: int) -> list[tuple[int, int]]:
    """Offsets (dx, dy) of the elliptic kernel of side k."""
    r = k // 2
    reach = {dy: round(r * math.sqrt((r * r - dy * dy) / (r * r))) if r else 0 for dy in range(-r, r + 1)}
    return [(dx, dy) for dy, n in reach.items() for dx in range(-n, n + 1)]


def _side(offsets: list[tuple[int, int]]) -> int:
    return max(max(abs(dx), abs(dy)) for dx, dy in offsets)


def dilate_kernel(p: DataFrame, offsets: list[tuple[int, int]], width: int, height: int, iterations: int = 1) -> DataFrame:
    return tiles.on_tiles(p, _side(offsets) * iterations, width, height, tiles.dilated(offsets, iterations))


def erode_kernel(p: DataFrame, offsets: list[tuple[int, int]], width: int, height: int, iterations: int = 1) -> DataFrame:
    """Minimum under a symmetric kernel; a place that an absent pixel reaches is 0, and goes."""
    return tiles.on_tiles(p, _side(offsets) * iterations, width, height, tiles.eroded(offsets, iterations))


def local_maxima(p: DataFrame, k: int, least: float, width: int, height: int, erode: int = 1, dilate: int = 1, plateau: int = 1) -> DataFrame:
    """Pixels (with the blurred height) that are highest under the kernel but not on a plateau.

    Heights above `least` are eroded and blurred; a pixel stays if no place within `dilate` kernels
    is higher and one within `plateau` kernels is lower. All in one pass over tiles.
    """
    shape, t = ellipse(k), taps(k, 0)

    def peaks(a):
        soft = tiles.weighed(t, 0)(tiles.weighed(t, 1)(tiles.eroded(shape, erode)(a)))
        return soft * ((soft >= tiles.dilated(shape, dilate)(soft)) & (soft > tiles.eroded(shape, plateau)(soft)))

    return tiles.on_tiles(p.where(F.col("v") > least), k // 2 * (erode + 1 + max(dilate, plateau)), width, height, peaks)


def detect_local_max(p: DataFrame, k: int, least: float, width: int, height: int, iterations: int = 1) -> DataFrame:
    """(raster_id, x, y, height): centroids of 4-connected local maxima, and the raster's height there."""
    from .components import stats

    peaks = local_maxima(p, k, least, width, height, iterations, 2, 2 * iterations)
    at = stats(label_runs(peaks, 4)).select("raster_id", F.floor("cx").cast("int").alias("x"), F.floor("cy").cast("int").alias("y"))
    return at.join(p, KEY, "left").select("raster_id", "x", "y", F.coalesce("v", F.lit(0.0)).alias("height"))


def _by_light(rgb: DataFrame, keeps: list, width: int, height: int, size: int, iterations: int, closings: list[tuple[int, int]]) -> DataFrame:
    """Pixels that one of `keeps` takes from the blurred gray, each with its own specks eroded away and gaps closed (size, times).

    Blur, erosion and closing are one pass over tiles, with a border as wide as all of them reach; tiles are large, as the border is.
    """
    t, side = taps(5, 5), lambda k, times: (times * (k // 2), times * (k - 1) - times * (k // 2))
    own = side(size, iterations)
    reach = 2 + max(own) + max(2 * max(side(*c)) for c in closings)

    def regions(a):
        soft, out = tiles.weighed(t, 0)(tiles.weighed(t, 1)(a)), np.zeros(a.shape, bool)
        for keep, closing in zip(keeps, closings):
            on = tiles.rect(*own, "all")((soft != 0) & keep(soft))
            out |= tiles.rect(*side(*closing), "all")(tiles.rect(*side(*closing), "any")(on))
        return out.astype("float64")

    return tiles.on_tiles(gray(rgb), reach, width, height, regions, 1024).select(*KEY)


def _dark(th: float):
    return lambda soft: soft <= th


def _bright(th: float):
    return lambda soft: (soft > th) | np.isnan(soft)  # as Spark orders them


def filter_shadows(rgb: DataFrame, width: int, height: int, th: float = 100, size: int = 5, iterations: int = 3, close_size: int = 10, close_iterations: int = 3) -> DataFrame:
    """Pixels of dark regions: blurred gray of at most th, small specks eroded away and gaps closed."""
    return _by_light(rgb, [_dark(th)], width, height, size, iterations, [(close_size, close_iterations)])


def filter_bright(rgb: DataFrame, width: int, height: int, th: float, size: int = 5, iterations: int = 3, close_size: int = 10, close_iterations: int = 7) -> DataFrame:
    """Pixels of bright regions: blurred gray above th, small specks eroded away and gaps closed."""
    return _by_light(rgb, [_bright(th)], width, height, size, iterations, [(close_size, close_iterations)])


def filter_both(rgb: DataFrame, width: int, height: int, shadow: float, bright: float) -> DataFrame:
    """Pixels of filter_shadows() or filter_bright(), each once, in one pass."""
    return _by_light(rgb, [_dark(shadow), _bright(bright)], width, height, 5, 3, [(10, 3), (10, 7)])


def erase_border(p: DataFrame, width: int, height: int, reach: float = 5, chamfer: bool = True) -> DataFrame:
    """Pixels farther than reach from every absent one, by the 3 x 3 chamfer measure or by the straight line.

    Distances come from sweeps over tiles with a border as wide as the reach, so the cost doesn't grow with its square.
    """
    far = math.ceil(reach / STRAIGHT) + 1

    def inside(a):
        d = tiles.chamfer(a, STRAIGHT, DIAGONAL) if chamfer else tiles.euclid(a, reach + 1)
        return (d > reach) * 1.0

    def kept(a):
        return np.where(inside(~np.isnan(a)) > 0, a, np.nan)

    if set(p.columns) == {*KEY, "v"} and p.schema["v"].dataType.simpleString() == "double":  # heights go along, so no pixel is joined
        return tiles.on_tiles(p, far, width, height, kept, blank=np.nan).select(*[F.col(c).cast(p.schema[c].dataType).alias(c) for c in p.columns])
    return p.join(tiles.on_tiles(p.withColumn("v", F.lit(1.0)), far, width, height, inside).select(*KEY), KEY, "left_semi")


def fill_holes(mask: DataFrame, width: int, height: int) -> DataFrame:
    """mask with the 4-connected parts of its background that don't touch the raster's edge.

    The background is made of the gaps between runs of a row, so its pixels are never listed
    but for those of the holes.
    """
    r = runs(mask.select(*KEY).distinct())
    w = Window.partitionBy("raster_id", "y").orderBy("x0")
    before = r.select("raster_id", "y", (F.coalesce(F.lag("x1").over(w), F.lit(-1)) + 1).alias("x0"), (F.col("x0") - 1).alias("x1"))
    after = r.groupBy("raster_id", "y").agg((F.max("x1") + 1).alias("x0")).withColumn("x1", F.lit(width - 1))
    rows = r.select("raster_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    blank = rows.join(r, ["raster_id", "y"], "left_anti").select("raster_id", "y", F.lit(0).alias("x0"), F.lit(width - 1).alias("x1"))
    gaps = before.union(after).union(blank).where("x0 <= x1").select("raster_id", *[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")])
    named = label_given(gaps, 4)
    edge = (F.col("x0") == 0) | (F.col("x1") == width - 1) | (F.col("y") == 0) | (F.col("y") == height - 1)
    inner = named.join(named.where(edge), ["raster_id", "comp_y", "comp_x"], "left_anti")
    return mask.select(*KEY).union(component_pixels(inner).select(*KEY))


def resample_nearest(p: DataFrame, factor: int) -> DataFrame:
    """Reduced by a whole factor: the pixel under the middle of each block."""
    mid = factor // 2
    return p.where((F.pmod("x", F.lit(factor)) == mid) & (F.pmod("y", F.lit(factor)) == mid)).withColumns({"x": F.floor(F.col("x") / factor).cast("int"), "y": F.floor(F.col("y") / factor).cast("int")})


def resample(p: DataFrame, sizes: DataFrame, linear: bool = False) -> DataFrame:
    """p in other shapes, up or down, by any ratio. sizes: (raster_id, width, height, to_width, to_height), a row for each raster.

    Each pixel goes to the places that read it: under their middle, or with `linear`, by distance to
    it, the two on each axis. So rows grow with the result only, and nothing but sizes is joined.
    """
    p = p.join(sizes, "raster_id")
    for axis, was, to in (("x", "width", "to_width"), ("y", "height", "to_height")):
        c, w, n = F.col(axis), F.col(was), F.col(to)
        if linear:
            ratio = w / n
            low = F.when(c == 0, 0).otherwise(F.greatest(F.lit(0), F.ceil((c - 0.5) / ratio - 0.5)))
            high = F.when(c == w - 1, n - 1).otherwise(F.least(n - 1, F.floor((c + 1.5) / ratio - 0.5)))
        else:
            # Whole numbers: place i reads (2 i + 1) w / 2 n, rounded down.
            first = lambda x, w=w, n=n: F.ceil((2 * x * n - w) / (2 * w))
            low, high = F.greatest(F.lit(0), first(c)), F.least(n, first(c + 1)) - 1
        low, high = low.cast("int"), high.cast("int")
        p = p.withColumn("to", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
        if linear:
            at = F.least(F.greatest((F.col("to") + 0.5) * (w / n) - 0.5, F.lit(0.0)), (w - 1).cast("double"))
            p = p.withColumn("v", F.col("v") * (F.lit(1.0) - F.abs(at - c))).where(F.abs(at - c) < 1)
        p = p.withColumn(axis, F.col("to"))
        if linear:
            p = p.groupBy(*KEY, "width", "height", "to_width", "to_height").agg(F.sum("v").alias("v"))
    return p.drop("to", "width", "height", "to_width", "to_height")


def mask_out(p: DataFrame, mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """p without the pixels under a mask of another shape, which takes p's first; sizes as for resample(), from the mask's shape to p's.

    Heights go over tiles, so no pixel is sorted; other tables are joined.
    """
    hidden = exploded(resample(mask.select(*KEY), sizes))
    if set(p.columns) != {*KEY, "v"} or p.schema["v"].dataType.simpleString() != "double":
        return without(p, hidden)
    kept = tiles.without(p, hidden)
    return kept.select(*[F.col(c).cast(p.schema[c].dataType).alias(c) for c in p.columns])


def resample_linear(p: DataFrame, factor: float, width: int, height: int) -> DataFrame:
    """Sides divided by factor (any number above 0), rounded down: each place takes the four pixels round it, by their distances; one pass over tiles."""
    return tiles.resampled(p, factor, width, height)


def resample_dem_and_mask(p: DataFrame, mask: DataFrame, factor: int, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Heights by resample_linear, the marked pixels by resample_nearest."""
    return resample_linear(p, factor, width, height), resample_nearest(mask, factor)


def resample_labels(labels: DataFrame, factor: int) -> DataFrame:
    """resample_nearest, less the pixels whose block isn't of one label all over."""
    block = labels.groupBy("raster_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n"))
    return block.where((F.col("a") == F.col("b")) & (F.col("n") == factor * factor)).select(*KEY, F.col("a").alias("label"))
