"""Tree-top detection: window clean-up, the band sweep inside components, and refinement over the whole raster."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import components, focal, pixels, tiles, tree, windows
from .points import within


def keyed_by_window(p: DataFrame, size: int, step: int) -> DataFrame:
    """Every window as a raster of its own: raster_id becomes (r, wx, wy), and x, y count from the window's corner."""
    w = windows.assign(p, size, step)
    return w.select(F.struct(F.col("raster_id").alias("r"), F.col("win_x").alias("wx"), F.col("win_y").alias("wy")).alias("raster_id"), (F.col("y") - F.col("win_y")).alias("y"), (F.col("x") - F.col("win_x")).alias("x"), "v")


def window_extent(size: int, width: int, height: int):
    """Width and height of each window of keyed_by_window; those at the raster's end are cut."""
    return F.least(F.lit(size), F.lit(width) - F.col("raster_id.wx")), F.least(F.lit(size), F.lit(height) - F.col("raster_id.wy"))


def window_stretch(p: DataFrame, low: float, high: float = 0.99) -> DataFrame:
    """v cut at its high percentile, less its low one, scaled to whole numbers up to 255; what falls to 0 goes."""
    q = pixels.percentiles(p, low, high)
    v = F.floor((F.least("v", "p1") - F.col("p0")) * 255 / (F.col("p1") - F.col("p0")))
    return p.join(q, "raster_id").where("p1 > p0").withColumn("v", v).where("v > 0").select(*pixels.KEY, F.col("v").cast("double").alias("v"))


def sweep(cells: list[tuple[int, int, float]], step: float, eps: float, min_pix: int, centroid: bool = False) -> list[tuple[int, int, float]]:
    """Tops (y, x, v) of one component in memory, by lowering a threshold in bands of `step`; find_tops() does the same for components of any size.

    In every band the tops are thinned within each part of what lies above it (a top goes if a
    higher one of its part is closer than 2 eps), then parts of more than min_pix pixels that
    have no top add their highest pixel (the first by y, x). Parts grow by merging, so a pixel
    is added once. centroid: parts add their centroid, rounded down, with the height of the
    component there (0 outside it), in place of the highest pixel.
    """
    heights = {(y, x): v for y, x, v in cells} if centroid else {}
    top, low = max(c[2] for c in cells), min(c[2] for c in cells)
    if top == low:
        return []
    bands: dict[int, list[tuple[int, int, float]]] = {}
    for c in cells:
        bands.setdefault(max(0, math.ceil((top - c[2]) / step) - 1), []).append(c)
    parent: dict[tuple[int, int], tuple[int, int]] = {}
    parts: dict[tuple[int, int], list] = {}  # root: [pixels, (-height, y, x) of the highest, tops, sum of y, sum of x]

    def root(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    for k in range(max(1, math.trunc((top - step - low) / step) - 1)):
        for y, x, v in bands.get(k, ()):
            here = (y, x)
            parent[here], parts[here] = here, [1, (-v, y, x), [], y, x]
            for n in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx):
                if n in parent and (a := root(n)) != (b := root(here)):
                    if parts[a][0] < parts[b][0]:
                        a, b = b, a
                    size, high, tops, sum_y, sum_x = parts.pop(b)
                    parent[b] = a
                    parts[a][0] += size
                    parts[a][1] = min(parts[a][1], high)
                    parts[a][2] += tops
                    parts[a][3] += sum_y
                    parts[a][4] += sum_x
        for part in parts.values():
            ranked = sorted(part[2])
            part[2] = [t for i, t in enumerate(ranked) if all((t[1] - u[1]) ** 2 + (t[2] - u[2]) ** 2 >= 4 * eps * eps for u in ranked[:i])]
            if not part[2] and part[0] > min_pix:
                middle = (part[3] // part[0], part[4] // part[0])
                part[2] = [(-heights.get(middle, 0.0), *middle)] if centroid else [part[1]]
    return sorted((y, x, -v) for part in parts.values() for v, y, x in part[2])


def find_tops(p: DataFrame, labelled: DataFrame, params: DataFrame, centroid: bool = False, tile: int = 256) -> DataFrame:
    """(raster_id, y, x, v) by sweep() in each component, with the parameters (raster_id, step, eps, min_pix) of its raster.

    All bands of all components are joined in one merge tree, tile by tile, so a component may be as large as its raster.
    """
    return tree.sweep_tops(p.select(*pixels.KEY, F.col("v").cast("double").alias("v")), labelled, params, centroid, tile)


def same_params(p: DataFrame, step: float, eps: float, min_pix: int) -> DataFrame:
    """The same sweep parameters for every raster of p."""
    return p.select("raster_id").distinct().select("raster_id", F.lit(step).alias("step"), F.lit(eps).alias("eps"), F.lit(min_pix).alias("min_pix"))


def process_windows(windowed: DataFrame, extent, low: float, k: int, iterations: int, params: DataFrame, centroid: bool = False) -> DataFrame:
    """Tops of every window of keyed_by_window() that has parameters (raster_id, step, eps, min_pix).

    Stretched and eroded windows only tell the components, of which those above min_pix count;
    the band sweep then goes over the window's own heights under each.
    """
    params = components.written(params)
    sizes = [e.cast("long").alias(c) for e, c in zip(extent, ("width", "height"))]
    own = params.select("raster_id", *[F.col(c).cast("double").alias(c) for c in ("step", "eps", "min_pix")], *sizes)
    if (own.agg(F.max(F.greatest("width", "height"))).first()[0] or 0) <= WHOLE:
        return _whole_windows(windowed, own, low, k, iterations, centroid)
    clean = components.written(pixels.erode_rect(window_stretch(windowed.join(params, "raster_id", "left_semi"), low), k, iterations, *extent))
    labelled = components.label_runs(clean)
    large = components.stats(labelled).join(params, "raster_id").where(F.col("area") > F.col("min_pix")).select("raster_id", "comp_y", "comp_x")
    return find_tops(windowed, labelled.join(large, ["raster_id", "comp_y", "comp_x"], "left_semi"), params, centroid)


def percentile(v: np.ndarray, share: float) -> float:
    """As Spark interpolates it. v is sorted."""
    at = (len(v) - 1) * share
    low, high = math.floor(at), math.ceil(at)
    return float(v[low]) if v[low] == v[high] else float((high - at) * v[low] + (at - low) * v[high])


def _whole_windows(windowed: DataFrame, params: DataFrame, low: float, k: int, iterations: int, centroid: bool) -> DataFrame:
    """process_windows() with all steps of a window in one task; params with its width and height. Pixels are shuffled once, in packed blocks."""
    place = [F.col(c).cast("int").alias(c) for c in ("y", "x")]
    cells = windowed.select("raster_id", *place, F.col("v").cast("double").alias("v")).where("v IS NOT NULL")
    blocks = tiles.packed(cells, lambda axis, c: (np.zeros_like(c), np.zeros_like(c)))
    before = iterations * (k // 2)
    after = iterations * (k - 1) - before

    def run(table: pa.Table) -> pa.Table:
        step, eps, least, width, height = (table.column(c)[0].as_py() for c in ("step", "eps", "min_pix", "width", "height"))
        cells, found = tiles.unpacked(table.column("cells")), []
        heights = np.sort(cells["v"])
        p0, p1 = percentile(heights, low), percentile(heights, 0.99)
        if p1 > p0:
            v = np.zeros((height, width))
            cells = cells[(cells["y"] >= 0) & (cells["y"] < height) & (cells["x"] >= 0) & (cells["x"] < width)]
            y, x = cells["y"], cells["x"]
            v[y, x] = cells["v"]
            on = np.zeros(v.shape, bool)
            on[y, x] = np.floor((np.minimum(cells["v"], p1) - p0) * 255 / (p1 - p0)) > 0
            y, x = np.nonzero(tiles.rect(before, after, "all")(on))
            names, comp, area = np.unique(tree.parts(y, x), return_inverse=True, return_counts=True)
            comps = list(zip(y[names].tolist(), x[names].tolist()))
            large = (area > least)[comp.ravel()]
            if large.any():
                y, x, comp = y[large], x[large], comp.ravel()[large]
                found = tree.swept(y, x, v[y, x], comp, comps, step, eps, least, centroid)
        ids = table.column("raster_id").combine_chunks().take(pa.array([0] * len(found), pa.int64()))
        y, x, v = zip(*found) if found else ((), (), ())
        return pa.table({"raster_id": ids, "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "v": pa.array(v, pa.float64())})

    kind = windowed.schema["raster_id"].dataType.simpleString()
    return blocks.select("raster_id", "cells").join(params, "raster_id").groupBy("raster_id").applyInArrow(run, f"raster_id {kind}, y int, x int, v double")


def to_global(tops: DataFrame) -> DataFrame:
    """Tops of windows in the raster's coordinates; what overlapping windows find twice stays twice."""
    return tops.select(F.col("raster_id.r").alias("raster_id"), (F.col("y") + F.col("raster_id.wy")).alias("y"), (F.col("x") + F.col("raster_id.wx")).alias("x"))


def trim_canopy(p: DataFrame, tops: DataFrame, radius: int, cutoff: float) -> DataFrame:
    """Pixels near tops whose height fits them. tops: (raster_id, y, x, h).

    Tops fall into ten equal bands of height from the highest (one band if all are equal). Of the
    disks round a band's tops the pixels stay that are no higher than its highest top and no lower
    than its lowest less 1.5 (2.25 where its first top, by y and x, is below the cutoff).
    """
    ends = tops.groupBy("raster_id").agg(F.max("h").alias("hi"), F.min("h").alias("lo"))
    step = (F.col("hi") - F.col("lo")) / 10
    band = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("hi") - F.col("h")) / F.nullif(step, F.lit(0.0))).cast("int"), F.lit(9)))
    banded = tops.join(ends, "raster_id").select("raster_id", "y", "x", "h", band.alias("band"))
    limits = banded.groupBy("raster_id", "band").agg(F.max("h").alias("top"), F.min("h").alias("low"), F.min_by("h", F.struct("y", "x")).alias("first")).withColumn("low", F.col("low") - F.when(F.col("first") < cutoff, 2.25).otherwise(1.5))
    sized = banded.join(limits.drop("first"), ["raster_id", "band"]).select("raster_id", *[F.col(c).cast("int").alias(c) for c in ("y", "x")], *[F.col(c).cast("double").alias(c) for c in ("low", "top")]).distinct()
    kept = _near_seeds(_blocks(p), sized, radius)
    return kept.select(*[F.col(c).cast(p.schema[c].dataType).alias(c) for c in (*pixels.KEY, "v")])


#: Side of the tiles in which seeds meet heights.
TILE = 256


def _blocks(p: DataFrame) -> DataFrame:
    """Heights (raster_id, y, x, v) in packed blocks of their tiles."""
    place = [F.col(c).cast("int").alias(c) for c in ("y", "x")]
    there = "y IS NOT NULL AND x IS NOT NULL AND v IS NOT NULL"
    return tiles.packed(p.select("raster_id", *place, F.col("v").cast("double").alias("v")).where(there), lambda axis, c: (c // TILE, c // TILE))


def _at_tile(c):
    return F.floor(c / TILE).cast("int")


def _near_seeds(blocks: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(raster_id, y, x, v): pixels within radius of a seed (raster_id, y, x, low, top) that takes their height, each once; seeds go to the tiles that their disks touch."""
    kind, key = blocks.schema["raster_id"].dataType.simpleString(), ["raster_id", "ty", "tx"]
    span = lambda c: F.explode(F.sequence(_at_tile(F.col(c) - radius), _at_tile(F.col(c) + radius)))
    spread = seeds.where("y IS NOT NULL AND x IS NOT NULL").withColumn("ty", span("y")).withColumn("tx", span("x"))
    dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    disk = dy * dy + dx * dx <= radius * radius

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        ty, tx = left.column("ty")[0].as_py() * TILE, left.column("tx")[0].as_py() * TILE
        cells = tiles.unpacked(left.column("cells"))
        v = np.full((TILE + 4 * radius, TILE + 4 * radius), np.nan)
        v[cells["y"] - ty + 2 * radius, cells["x"] - tx + 2 * radius] = cells["v"]
        kept = np.zeros(v.shape, bool)
        y, x = (right.column(c).to_numpy() for c in ("y", "x"))
        for a, b, low, top in zip((y - ty + radius).tolist(), (x - tx + radius).tolist(), right.column("low").to_pylist(), right.column("top").to_pylist()):
            box = (slice(a, a + 2 * radius + 1), slice(b, b + 2 * radius + 1))
            own = v[box]
            kept[box] |= (own >= low) & (own <= top) & disk
        y, x = np.nonzero(kept)
        ids = left.column("raster_id").combine_chunks().take(pa.array(np.zeros(len(y), "int64")))
        return pa.table({"raster_id": ids, "y": pa.array((y + ty - 2 * radius).astype("int32")), "x": pa.array((x + tx - 2 * radius).astype("int32")), "v": v[y, x]})

    schema = f"raster_id {kind}, y int, x int, v double"
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return blocks.groupBy(*key).cogroup(components.exploded(spread).groupBy(*key)).applyInArrow(run, schema)


def _heights_at(blocks: DataFrame, points: DataFrame) -> DataFrame:
    """(raster_id, y, x, h): points (raster_id, y, x) that lie on a pixel, with its height."""
    kind, key = blocks.schema["raster_id"].dataType.simpleString(), ["raster_id", "ty", "tx"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return nothing
        ty, tx = left.column("ty")[0].as_py() * TILE, left.column("tx")[0].as_py() * TILE
        cells = tiles.unpacked(left.column("cells"))
        v, there = np.zeros((TILE, TILE)), np.zeros((TILE, TILE), bool)
        v[cells["y"] - ty, cells["x"] - tx], there[cells["y"] - ty, cells["x"] - tx] = cells["v"], True
        y, x = (right.column(c).to_numpy() for c in ("y", "x"))
        on = there[y - ty, x - tx]
        return right.select(["raster_id", "y", "x"]).filter(pa.array(on)).append_column("h", pa.array(v[y[on] - ty, x[on] - tx]))

    schema = f"raster_id {kind}, y int, x int, h double"
    nothing = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    points = points.select(F.col("raster_id").cast(kind).alias("raster_id"), *[F.col(c).cast("int").alias(c) for c in ("y", "x")]).where("y IS NOT NULL AND x IS NOT NULL")
    points = points.withColumns({"ty": _at_tile(F.col("y")), "tx": _at_tile(F.col("x"))})
    return blocks.groupBy(*key).cogroup(points.groupBy(*key)).applyInArrow(run, schema)


def refine_global(p: DataFrame, tops: DataFrame, radius: int, cutoff: float) -> DataFrame:
    """(raster_id, x, y, v): the highest pixel of each part of the trimmed canopy that holds a seed; rasters with fewer than two seeds give none."""
    p = p.select(*pixels.KEY, "v")
    seeds = components.written(_heights_at(_blocks(p), tops.select(*pixels.KEY).distinct()))
    enough = seeds.groupBy("raster_id").count().where("count > 1")
    seeds = components.written(seeds.join(enough, "raster_id", "left_semi"))
    kept = components.written(trim_canopy(p, seeds, radius, cutoff))
    labelled = components.written(components.label_given(components.runs(kept, tops=True)))
    hit = components.looked_up(seeds, labelled.select("raster_id", "y", "x0", "x1", "comp_y", "comp_x"), "inner").select("raster_id", "comp_y", "comp_x").distinct()
    return components.argmax(labelled.join(hit, ["raster_id", "comp_y", "comp_x"], "left_semi")).select("raster_id", "x", "y", "v")


def detect_tops(p: DataFrame, width: int, height: int, size: int = 500, overlap: float = 0.2, low: float = 0.5, k: int = 3, iterations: int = 1, min_area: int = 30, step: float = 5.0, eps: float = 5.0, gate: int = 400, radius: int = 10, cutoff: float = 10.0) -> DataFrame:
    """All steps: border, floor, windows, sweep, whole raster, refinement. (raster_id, x, y, v)."""
    clean = components.written(pixels.subtract_floor(pixels.clip_negative(focal.erase_border(p, width, height))))
    windowed = keyed_by_window(clean, size, int(size * (1 - overlap)))
    full = windowed.groupBy("raster_id").count().where(F.col("count") > gate)
    tops = process_windows(windowed, window_extent(size, width, height), low, k, iterations, same_params(full, step, eps, min_area))
    return refine_global(clean, to_global(tops), radius, cutoff)


def refine_tops(tops: DataFrame, eps: float, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """tops (keys, id, x, y, h) without those that have a higher one, kept or not, closer than 2 eps; ties rank by id."""
    a = tops.select(*keys, F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("h").alias("ah"))
    b = tops.select(*keys, F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("h").alias("bh"))
    low = within(a, b, 2.0 * eps, (F.col("bh") > F.col("ah")) | ((F.col("bh") == F.col("ah")) & (F.col("b_id") < F.col("a_id"))), keys)
    return tops.join(low.select(*keys, F.col("a_id").alias("id")).distinct(), [*keys, "id"], "left_anti")


def box_stats(p: DataFrame, boxes: DataFrame, share: float = 0.75, tile: int = 64) -> DataFrame:
    """(raster_id, box_id, top, perc, n, cx, cy): the highest pixel in a box, the percentile of its pixels and how many reach it."""
    t = lambda c: F.floor(c / tile).cast("int")
    span = lambda a, b: F.explode(F.sequence(t(F.col(a)), t(F.col(b))))
    b = boxes.withColumn("tx", span("x1", "x2")).withColumn("ty", span("y1", "y2"))
    inside = p.withColumns({"tx": t(F.col("x")), "ty": t(F.col("y"))}).join(b, ["raster_id", "tx", "ty"]).where("x >= x1 AND x < x2 AND y >= y1 AND y < y2")
    perc = F.percentile("v", F.lit(share)).over(Window.partitionBy("raster_id", "box_id"))
    q = inside.withColumn("perc", perc).groupBy("raster_id", "box_id", "x1", "y1", "x2", "y2", "perc").agg(F.max("v").alias("top"), F.count_if(F.col("v") >= F.col("perc")).alias("n"))
    return q.select("raster_id", "box_id", "top", "perc", "n", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))


def window_params(stats: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Sweep parameters from the boxes of each window: step, radius and smallest size."""
    low, n = F.min("perc"), F.min("n")
    return stats.groupBy(*by).agg(F.greatest((F.avg("top") - low) / 150, F.lit(0.05)).alias("step"), F.greatest(F.floor(n / 10), F.lit(5)).cast("long").alias("radius"), F.greatest(n, F.lit(30)).alias("min_pix"))


#: Side of the largest tile in which windows are looked at as a whole.
WHOLE = 2048


def extend_floor(p: DataFrame, floor: DataFrame, size: int, margin: float) -> DataFrame:
    """floor with the pixels lower than their window's mean floor height (within 1 to 255, rounded down; 0 if none) plus margin."""
    if size <= WHOLE:
        return _extended(p, floor, [size], margin)
    win = {"wx": F.floor(F.col("x") / size), "wy": F.floor(F.col("y") / size)}
    marked = p.join(floor.select(*pixels.KEY).distinct().withColumn("on", F.lit(1)), pixels.KEY, "left").withColumns(win)
    on = F.when((F.col("on") == 1) & F.col("v").between(1, 255), F.col("v"))
    mean = F.coalesce(F.floor(F.avg(on).over(Window.partitionBy("raster_id", "wx", "wy"))), F.lit(0))
    return marked.withColumn("m", mean).where(F.col("v") < F.col("m") + margin).select(*pixels.KEY).union(floor.select(*pixels.KEY)).distinct()


def _extended(p: DataFrame, floor: DataFrame, sizes: list[int], margin: float) -> DataFrame:
    """extend_floor() with windows of each size in turn, in one pass: tiles hold whole windows of all of them. floor may hold pixels twice."""
    side = math.lcm(*sizes)
    side *= max(1, 512 // side)
    own = lambda axis, c: (c // side, c // side)
    kind = p.schema["raster_id"].dataType.simpleString()
    place = [F.col("raster_id").cast(kind).alias("raster_id"), *[F.col(c).cast("int").alias(c) for c in "yx"]]
    there, key = "y IS NOT NULL AND x IS NOT NULL", ["raster_id", "ty", "tx"]
    heights = tiles.packed(p.select(*place, F.col("v").cast("double").alias("v")).where(there), own)
    marks = tiles.packed(floor.select(*place).where(there), own, ())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, first = tiles.unpacked(left.column("cells")), tiles.unpacked(right.column("cells"), ())
        any_ = left if left.num_rows else right
        ty, tx = any_.column("ty")[0].as_py() * side, any_.column("tx")[0].as_py() * side
        mask = np.zeros((side, side), bool)
        mask[first["y"] - ty, first["x"] - tx] = True
        y, x, v = mine["y"] - ty, mine["x"] - tx, mine["v"]
        for size in sizes:
            window = y // size * (side // size) + x // size
            on = mask[y, x] & (v >= 1) & (v <= 255)
            n, total = (np.bincount(window[on], w, (side // size) ** 2) for w in (None, v[on]))
            low = v < np.floor(total / np.maximum(n, 1))[window] + margin
            mask[y[low], x[low]] = True
        y, x = np.nonzero(mask)
        ids = any_.column("raster_id").combine_chunks().take(pa.array(np.zeros(len(y), "int64")))
        return pa.table({"raster_id": ids, "y": pa.array((y + ty).astype("int32")), "x": pa.array((x + tx).astype("int32"))})

    out = heights.groupBy(*key).cogroup(marks.groupBy(*key)).applyInArrow(run, f"raster_id {kind}, y int, x int")
    return out.select(*[F.col(c).cast(p.schema[c].dataType).alias(c) for c in pixels.KEY])


def detect_tops_boxes(p: DataFrame, boxes: DataFrame, width: int, height: int, size: int = 500, overlap: float = 0.2, low: float = 0.25, k: int = 5, iterations: int = 1, radius: int = 10, cutoff: float = 10.0) -> DataFrame:
    """(raster_id, x, y, v) from windows that hold boxes: the boxes' centres are seeds, and so are
    the centroids that a sweep with parameters from the window's boxes finds; then the refinement
    over the whole raster."""
    clean = components.written(pixels.subtract_floor(pixels.clip_negative(p)))
    step = int(size * (1 - overlap))
    windowed = components.written(keyed_by_window(clean, size, step))
    within = windows.boxes_in(boxes, size, step).select("raster_id", "win_x", "win_y", "box_id")
    key = F.struct(F.col("raster_id").alias("r"), F.col("win_x").alias("wx"), F.col("win_y").alias("wy"))
    measured = within.join(box_stats(clean, boxes), ["raster_id", "box_id"])
    params = window_params(measured.withColumn("raster_id", key), ("raster_id",)).withColumnRenamed("radius", "eps")
    tops = process_windows(windowed, window_extent(size, width, height), low, k, iterations, params, centroid=True)
    centres = boxes.select("raster_id", F.floor((F.col("y1") + F.col("y2")) / 2).cast("int").alias("y"), F.floor((F.col("x1") + F.col("x2")) / 2).cast("int").alias("x"))
    return refine_global(clean, to_global(tops).union(centres), radius, cutoff)


def flatten_tops(by_component: DataFrame, column: str = "tops") -> DataFrame:
    """One row per top of a map from components to arrays of tops (structs)."""
    rest = [c for c in by_component.columns if c != column]
    return by_component.select(*rest, F.explode(F.flatten(F.map_values(column))).alias("top")).select(*rest, "top.*")


def window_clean(p: DataFrame, size: int, low: float, k: int, iterations: int, width: int, height: int, gate: int = 50) -> DataFrame:
    """In windows side by side of more than `gate` pixels: pixels below the low percentile go, the
    rest is cut at the 99th, scaled to 255 above the low one, and eroded. Other windows stay as they are."""
    if size <= WHOLE and isinstance(width, int) and isinstance(height, int):
        return _cleaned(p, size, low, k, iterations, width, height, gate)
    windowed = keyed_by_window(p, size, size)
    full = windowed.groupBy("raster_id").count().where(F.col("count") > gate).select("raster_id")
    q = pixels.percentiles(windowed.join(full, "raster_id", "left_semi"), low, 0.99)
    scaled = windowed.join(q, "raster_id").where("p1 > p0").withColumn("v", (F.least("v", "p1") - F.col("p0")) * (F.lit(255.0) / (F.col("p1") - F.col("p0")))).where("v > 0").select(*pixels.KEY, "v")
    done = pixels.erode_rect(scaled, k, iterations, *window_extent(size, width, height)).union(windowed.join(full, "raster_id", "left_anti").select(*pixels.KEY, "v"))
    return done.select(F.col("raster_id.r").alias("raster_id"), (F.col("y") + F.col("raster_id.wy")).cast("int").alias("y"), (F.col("x") + F.col("raster_id.wx")).cast("int").alias("x"), "v")


def _cleaned(p: DataFrame, size: int, low: float, k: int, iterations: int, width: int, height: int, gate: int) -> DataFrame:
    """window_clean() with a window as a tile: pixels are shuffled once, in packed blocks."""
    before = iterations * (k // 2)
    after = iterations * (k - 1) - before
    place = [F.col(c).cast("int").alias(c) for c in ("y", "x")]
    there = "y IS NOT NULL AND x IS NOT NULL AND v IS NOT NULL"
    blocks = tiles.packed(p.select("raster_id", *place, F.col("v").cast("double").alias("v")).where(there), lambda axis, c: (c // size, c // size))

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py() * size, table.column("tx")[0].as_py() * size
        cells = tiles.unpacked(table.column("cells"))
        y, x, v = cells["y"], cells["x"], cells["v"]
        if len(v) > gate:
            heights = np.sort(v)
            p0, p1 = percentile(heights, low), percentile(heights, 0.99)
            a = np.full((max(0, min(size, height - ty)), max(0, min(size, width - tx))), np.nan)
            if p1 > p0 and a.size:
                v = (np.minimum(v, p1) - p0) * (255.0 / (p1 - p0))
                on = (v > 0) & (y < height) & (x < width)
                a[y[on] - ty, x[on] - tx] = v[on]
                a = tiles.rect(before, after, "min")(a)
            y, x = np.nonzero(~np.isnan(a))
            y, x, v = y + ty, x + tx, a[y, x]
        ids = table.column("raster_id").combine_chunks().take(pa.array(np.zeros(len(y), "int64")))
        return pa.table({"raster_id": ids, "y": pa.array(y.astype("int32")), "x": pa.array(x.astype("int32")), "v": pa.array(v.astype("float64"))})

    return blocks.groupBy("raster_id", "ty", "tx").applyInArrow(run, f"raster_id {p.schema['raster_id'].dataType.simpleString()}, y int, x int, v double")


def floor_mask(p: DataFrame, rgb: DataFrame, low: float, shadow: float, bright: float, margin: float, size: int, width: int, height: int, rounds: int = 5) -> DataFrame:
    """Pixels of the floor: low, dark or bright ones, extended `rounds` times in windows of size, 1.5 and 2 times that in turn."""
    found = p.where(F.col("v") < low).select(*pixels.KEY).union(focal.filter_both(rgb, width, height, shadow, bright))
    sizes, turn = [int(size * (1, 1.5, 2)[i % 3]) for i in range(rounds)], []
    for s in sizes:
        if turn and math.lcm(*turn, s) > WHOLE:
            found, turn = components.written(_extended(p, found, turn, margin)), []
        if s > WHOLE:
            found = components.written(extend_floor(p, found, s, margin))
        else:
            turn.append(s)
    return _extended(p, found, turn, margin) if turn else found.distinct()
