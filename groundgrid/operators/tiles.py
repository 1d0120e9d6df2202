"""Kernels on square tiles with a border of neighbours: a pixel goes to its own tile and to those whose border it is in.

A tile is one dense array in one task, with the absent pixels as 0. What an array does at its
own border is right only at the raster's edge; elsewhere the border is as wide as the kernels
reach, and it is cut off. So a chain of kernels needs one shuffle, whatever their sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], np.ndarray]



def cell(values: tuple[str, ...] = ("v",)) -> np.dtype:
    """A pixel in its packed form."""
    return np.dtype([("y", "<i4"), ("x", "<i4"), *((c, "<f8") for c in values)])


#: Pixels that a task looks at together.
BLOCK = 1 << 19


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that tell the column's values apart; a struct's come from its fields."""
    if pa.types.is_struct(column.type):
        code = np.zeros(len(column), "int64")
        for part in map(codes, column.flatten()):
            most = int(part.max(initial=0)) + 2
            if int(code.max(initial=0)) > 2**62 // most:
                code = np.unique(code, return_inverse=True)[1].ravel()
            code = code * most + part + 1
        return code
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of BLOCK rows or somewhat more, none of them empty."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed(p: DataFrame, ranges: Callable[[str, np.ndarray], tuple[np.ndarray, np.ndarray]], values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(raster_id, ty, tx, cells): pixels (raster_id, y and x int, values double) as arrays of cell(values), a few rows for each tile.

    ranges(axis, places) gives the first and the last tile that places on an axis go to (none where
    the last is smaller). A row holds what one task has read for a tile, so a shuffle by tile moves
    and sorts blocks, not pixels.
    """
    kind = p.schema["raster_id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        at, tile = np.arange(len(y)), []
        for axis, c in (("y", y), ("x", x)):
            first, last = ranges(axis, c[at])
            n = np.maximum(last - first + 1, 0)
            many = np.repeat(np.arange(len(at)), n)
            at, tile = at[many], [k[many] for k in tile] + [first[many] + np.arange(len(many)) - (np.cumsum(n) - n)[many]]
        keys = [codes(table.column("raster_id"))[at], *tile]
        order = np.lexsort(keys)
        at, keys = at[order], [k[order] for k in keys]
        new = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))[: len(at)])
        cells = np.empty(len(at), cell(values))
        for c in ("y", "x", *values):
            cells[c] = table.column(c).to_numpy()[at]
        ends = (np.append(new, len(at)) * cells.itemsize).astype("int32")
        found = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(cells)])
        ids = table.select(["raster_id"]).take(pa.array(at[new])).combine_chunks()
        ids = ids.append_column("ty", pa.array(keys[1][new].astype("int32"))).append_column("tx", pa.array(keys[2][new].astype("int32")))
        return ids.append_column("cells", found)

    return p.mapInArrow(lambda batches: (b for t in blocks(batches) for b in pack(t).to_batches()), f"raster_id {kind}, ty int, tx int, cells binary")


def unpacked(cells: pa.ChunkedArray, values: tuple[str, ...] = ("v",)) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), cell(values))


def on_tiles(p: DataFrame, reach: int, width: int, height: int, kernel: Kernel, tile: int = 256, blank: float = 0.0, step: int = 1) -> DataFrame:
    """(raster_id, y, x, v): kernel applied to dense arrays of p, without zeros. reach: how far a pixel can change the result.

    blank stands for absent pixels in the arrays, and in the result for places that go; NaN tells them from zeros.
    With a step, the kernel's result holds every step-th place, and so does what is returned.
    Tiles grow with the reach, so at most nine times the pixels are sent, and 1.1 times for small kernels.
    """
    reach = -(-reach // step) * step
    size = -(-max(tile, reach) // step) * step

    def ranges(axis, c):
        last = ((height if axis == "y" else width) - 1) // size
        return tuple(np.clip(e // size, 0, last) for e in (c - reach, c + reach))

    kind = p.schema["raster_id"].dataType.simpleString()
    cells = p.select("raster_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    cells = cells.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py() * size, table.column("tx")[0].as_py() * size
        y0, y1 = max(0, ty - reach), min(height, ty + size + reach)
        x0, x1 = max(0, tx - reach), min(width, tx + size + reach)
        own = unpacked(table.column("cells"))
        dense = np.full((y1 - y0, x1 - x0), blank)
        dense[own["y"] - y0, own["x"] - x0] = own["v"]
        inner = kernel(dense)[(ty - y0) // step : (ty - y0 + size) // step, (tx - x0) // step : (tx - x0 + size) // step]
        y, x = np.nonzero(~np.isnan(inner) if np.isnan(blank) else inner != blank)
        key = table.column("raster_id").combine_chunks().take(pa.array(np.zeros(len(y), "int64")))
        return pa.table({"raster_id": key, "y": pa.array((y + ty // step).astype("int32")), "x": pa.array((x + tx // step).astype("int32")), "v": inner[y, x]})

    return packed(cells, ranges).groupBy("raster_id", "ty", "tx").applyInArrow(run, f"raster_id {kind}, y int, x int, v double")


def resampled(p: DataFrame, factor: float, width: int, height: int, tile: int = 256) -> DataFrame:
    """(raster_id, y, x, v): sides divided by factor, each place the sum of the pixels round it by their distances; a place without any goes.

    A tile is one of places. Pixels go to the tiles whose places read them, in packed blocks, and
    those that no place reads go nowhere. A null height is an absent pixel.
    """
    extents = {"y": height, "x": width}
    count = {axis: int(n / factor) for axis, n in extents.items()}

    def ranges(axis, c):
        # A little wider than the places that read c, as for rounding; run() takes exact shares.
        low = np.where(c == 0, 0, np.maximum(0, np.ceil((c - 0.5) / factor - 0.5 - 1e-6)))
        high = np.where(c == extents[axis] - 1, count[axis] - 1, np.minimum(count[axis] - 1, np.floor((c + 1.5) / factor - 0.5 + 1e-6)))
        return (low // tile).astype("int64"), np.where(low <= high, high // tile, -1).astype("int64")

    def reads(axis, first):
        """The lower pixel that each place reads, and the shares of it and the next."""
        at = np.clip((np.arange(first, min(first + tile, count[axis])) + 0.5) * factor - 0.5, 0.0, float(extents[axis] - 1))
        low = np.floor(at).astype("int64")
        return low, 1.0 - np.abs(at - low), 1.0 - np.abs(at - (low + 1))

    kind = p.schema["raster_id"].dataType.simpleString()
    cells = p.select("raster_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    cells = cells.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1) & F.col("v").isNotNull())

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py() * tile, table.column("tx")[0].as_py() * tile
        own = unpacked(table.column("cells"))
        (y, *y_shares), (x, *x_shares) = reads("y", ty), reads("x", tx)
        ys, xs = (np.unique(np.append(c, c + 1)) for c in (y, x))  # the rows and columns that are read at all
        iy, ix = np.searchsorted(ys, own["y"]), np.searchsorted(xs, own["x"])
        read = (ys[np.minimum(iy, len(ys) - 1)] == own["y"]) & (xs[np.minimum(ix, len(xs) - 1)] == own["x"])
        v, there = np.zeros((len(ys), len(xs))), np.zeros((len(ys), len(xs)), bool)
        v[iy[read], ix[read]], there[iy[read], ix[read]] = own["v"][read], True
        for axis, at, (a, b) in ((1, np.searchsorted(xs, x), x_shares), (0, np.searchsorted(ys, y), y_shares)):
            a, b = (s if axis else s[:, None] for s in (a, b))
            low, high = v.take(at, axis), v.take(at + 1, axis)
            v = low * a + np.where(b > 0, high * b, 0.0)
            there = there.take(at, axis) | (there.take(at + 1, axis) & (b > 0))
        y, x = np.nonzero(there)
        key = table.column("raster_id").combine_chunks().take(pa.array(np.zeros(len(y), "int64")))
        return pa.table({"raster_id": key, "y": pa.array((y + ty).astype("int32")), "x": pa.array((x + tx).astype("int32")), "v": v[y, x]})

    return packed(cells, ranges).groupBy("raster_id", "ty", "tx").applyInArrow(run, f"raster_id {kind}, y int, x int, v double")


def without(p: DataFrame, mask: DataFrame, tile: int = 256) -> DataFrame:
    """(raster_id, y, x, v): p without the pixels of mask (raster_id, y, x), which may hold some twice; both go to tiles in packed blocks. Heights are doubles, and not null."""
    own = lambda axis, c: (c // tile, c // tile)
    kind = p.schema["raster_id"].dataType.simpleString()
    place = [F.col("raster_id").cast(kind).alias("raster_id"), *[F.col(c).cast("int").alias(c) for c in "yx"]]
    there = "y IS NOT NULL AND x IS NOT NULL"
    key = ["raster_id", "ty", "tx"]
    cells, gone = packed(p.select(*place, F.col("v").cast("double").alias("v")).where(there), own), packed(mask.select(*place).where(there), own, ())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs = unpacked(left.column("cells")), unpacked(right.column("cells"), ())
        hidden = np.zeros((tile, tile), bool)
        hidden[theirs["y"] % tile, theirs["x"] % tile] = True
        mine = mine[~hidden[mine["y"] % tile, mine["x"] % tile]]
        ids = left.column("raster_id").combine_chunks().take(pa.array(np.zeros(len(mine), "int64")))
        return pa.table({"raster_id": ids, **{c: pa.array(mine[c].copy()) for c in ("y", "x", "v")}})

    return cells.groupBy(*key).cogroup(gone.groupBy(*key)).applyInArrow(run, f"raster_id {kind}, y int, x int, v double")


def painted(points: DataFrame, offsets: list[tuple[int, int, int]], width: int, height: int, tile: int = 256) -> DataFrame:
    """(raster_id, y, x, v, id): the highest cone over each pixel, and the id of its point (ties: the smallest).

    points: (raster_id, id long, y, x, h); a cone is (4 h - d2) / 4 high at the offsets (dx, dy, d2)
    of its point, where that is above 0. Points go to the tiles that their cones touch, so what is
    shuffled grows with the points and the pixels are made where they stay.
    """
    reach = max((max(abs(dx), abs(dy)) for dx, dy, _ in offsets), default=0)
    cone = np.full((2 * reach + 1, 2 * reach + 1), -np.inf)
    for dx, dy, d2 in offsets:
        cone[dy + reach, dx + reach] = -d2
    at = lambda e, extent: F.greatest(F.lit(0), F.least(F.lit((extent - 1) // tile), F.floor(e / tile))).cast("int")
    near = lambda c, extent: F.explode(F.sequence(at(F.col(c) - reach, extent), at(F.col(c) + reach, extent)))
    inside = F.col("y").between(-reach, height - 1 + reach) & F.col("x").between(-reach, width - 1 + reach)
    kind = points.schema["raster_id"].dataType.simpleString()
    # Of points on one pixel the highest covers the others, so a tile holds no more points than pixels.
    best = points.where(inside).groupBy("raster_id", "y", "x").agg(F.max(F.struct("h", (-F.col("id")).alias("less"))).alias("m"))
    best = best.select("raster_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("m.h").cast("double").alias("h"), (-F.col("m.less")).alias("id")).where("h IS NOT NULL")
    spread = best.withColumn("ty", near("y", height)).withColumn("tx", near("x", width))

    def run(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py() * tile, table.column("tx")[0].as_py() * tile
        rows, cols = min(tile, height - ty), min(tile, width - tx)
        high, of = np.zeros((rows + 2 * reach, cols + 2 * reach)), np.zeros((rows + 2 * reach, cols + 2 * reach), "int64")
        y, x, h, i = (table.column(c).to_numpy() for c in ("y", "x", "h", "id"))
        order = np.argsort(i, kind="stable")
        for a, b, top, n in zip((y[order] - ty).tolist(), (x[order] - tx).tolist(), (4 * h[order]).tolist(), i[order].tolist()):
            # Its place less the reach is the corner of its box, which may lie up to twice the reach outside.
            u0, v0 = max(0, -a), max(0, -b)
            box = (slice(a + u0, a + 2 * reach + 1), slice(b + v0, b + 2 * reach + 1))
            own = high[box]
            new = cone[u0 : u0 + own.shape[0], v0 : v0 + own.shape[1]] + top
            more = new > own
            own[more] = new[more]
            of[box][more] = n
        y, x = np.nonzero(high[reach : reach + rows, reach : reach + cols])
        key = table.column("raster_id").combine_chunks().take(pa.array(np.zeros(len(y), "int64")))
        return pa.table({"raster_id": key, "y": pa.array((y + ty).astype("int32")), "x": pa.array((x + tx).astype("int32")), "v": high[y + reach, x + reach] / 4, "id": of[y + reach, x + reach]})

    tiles_ = spread.repartition(spread_over(points), "raster_id", "ty", "tx")
    return tiles_.groupBy("raster_id", "ty", "tx").applyInArrow(run, f"raster_id {kind}, y int, x int, v double, id long")


def spread_over(df: DataFrame) -> int:
    """Partitions for a small table of which each row makes many: a few for every core, which no estimate of bytes merges."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def shifted(a: np.ndarray, dy: int, dx: int, blank: float) -> np.ndarray:
    """b[y, x] = a[y + dy, x + dx], blank outside."""
    out = np.full_like(a, blank)
    h, w = a.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def weighed(taps: list[float], axis: int) -> Kernel:
    """Weighted sums along an axis; outside, the array is mirrored without its edge."""

    def run(a: np.ndarray) -> np.ndarray:
        r = len(taps) // 2
        wide = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], "reflect" if a.shape[axis] > 1 else "edge")
        n = a.shape[axis]
        return sum(w * (wide[i : i + n] if axis == 0 else wide[:, i : i + n]) for i, w in enumerate(taps))

    return run


def median(k: int) -> Kernel:
    """Median over k x k, with the edge repeated outside."""

    def run(a: np.ndarray) -> np.ndarray:
        wide, (h, w) = np.pad(a, k // 2, "edge"), a.shape
        stack = np.stack([wide[dy : dy + h, dx : dx + w] for dy in range(k) for dx in range(k)])
        return np.partition(stack, k * k // 2, axis=0)[k * k // 2]

    return run


def eroded(offsets: list[tuple[int, int]], times: int = 1) -> Kernel:
    def run(a: np.ndarray) -> np.ndarray:
        for _ in range(times):
            a = np.minimum.reduce([shifted(a, dy, dx, np.inf) for dx, dy in offsets])
        return a

    return run


def dilated(offsets: list[tuple[int, int]], times: int = 1) -> Kernel:
    def run(a: np.ndarray) -> np.ndarray:
        for _ in range(times):
            a = np.maximum.reduce([shifted(a, dy, dx, -np.inf) for dx, dy in offsets])
        return a

    return run


def rect(before: int, after: int, how: str) -> Kernel:
    """Minimum or maximum over the square from `before` to `after` a place, axis by axis, in arrays with NaN for
    absent pixels: one of them makes a minimum absent, and a maximum is that of the present ones. "all" and "any" are the same of masks."""
    best, far = {"min": (np.minimum, np.inf), "max": (np.fmax, np.nan), "all": (np.logical_and, True), "any": (np.logical_or, False)}[how]

    def run(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            n = a.shape[axis]
            wide = np.pad(a, [(before, after) if i == axis else (0, 0) for i in (0, 1)], constant_values=far)
            span, done = before + after + 1, 1
            while done < span:  # twice as wide each time; frames may overlap
                step = min(done, span - done)
                m = wide.shape[axis] - step
                wide = best(wide[:m], wide[step:]) if axis == 0 else best(wide[:, :m], wide[:, step:])
                done += step
            a = wide[:n] if axis == 0 else wide[:, :n]
        return a

    return run


def chamfer(a: np.ndarray, straight: float, diagonal: float) -> np.ndarray:
    """Distance of each pixel to the nearest zero by steps of these lengths: a sweep down the rows and one up, each with a pass along the row."""
    d = np.where(a == 0, 0.0, np.inf)
    ramp = np.arange(a.shape[1]) * straight

    def along(row):
        row = np.minimum.accumulate(row - ramp) + ramp
        return np.minimum.accumulate(row[::-1] - ramp)[::-1] + ramp[::-1]

    for rows in (range(len(d)), range(len(d) - 1, -1, -1)):
        before = None
        for y in rows:
            if before is not None:
                d[y] = np.minimum(d[y], before + straight)
                d[y, 1:] = np.minimum(d[y, 1:], before[:-1] + diagonal)
                d[y, :-1] = np.minimum(d[y, :-1], before[1:] + diagonal)
            before = d[y] = along(d[y])
    return d


def euclid(a: np.ndarray, reach: float) -> np.ndarray:
    """Distance of each pixel to the nearest zero, exact up to reach (more beyond it): along rows first, then the lower envelope of each column's parabolas."""
    n = np.arange(a.shape[1])
    last = np.maximum.accumulate(np.where(a == 0, n, -np.inf), axis=1)
    ahead = np.minimum.accumulate(np.where(a == 0, n, np.inf)[:, ::-1], axis=1)[:, ::-1]
    row = np.minimum(n - last, ahead - n) ** 2
    best = row.copy()
    for dy in range(1, min(int(reach) + 1, len(a))):
        if best.max() <= dy * dy:
            break
        best[dy:] = np.minimum(best[dy:], row[:-dy] + dy * dy)
        best[:-dy] = np.minimum(best[:-dy], row[dy:] + dy * dy)
    return np.sqrt(best)
