"""Kernels across tiles, distances to absent pixels, and percentiles over partition borders."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundgrid.operators import dataset, focal, pixels, tiles
from groundgrid.plans.fixtures import table


def frame(spark, cells):
    return spark.createDataFrame([(1, y, x, v) for (y, x), v in cells.items()], "raster_id int, y int, x int, v double")


def dense(cells, height, width):
    a = np.zeros((height, width))
    for (y, x), v in cells.items():
        a[y, x] = v
    return a


KERNELS = {
    "blur": (2, lambda a: tiles.weighed(focal.taps(5, 0), 0)(tiles.weighed(focal.taps(5, 0), 1)(a))),
    "median": (2, tiles.median(5)),
    "erode": (4, tiles.eroded(focal.ellipse(5), 2)),
    "dilate": (4, tiles.dilated(focal.ellipse(5), 2)),
    "chamfer": (9, lambda a: np.minimum(tiles.chamfer(a, 0.955, 1.3693), 8)),
    "euclid": (9, lambda a: np.minimum(tiles.euclid(a, 8), 8)),
}


@pytest.mark.parametrize("name", KERNELS)
def test_tiles_equal_the_whole_array(spark, name):
    rng = random.Random(len(name))
    cells = {(y, x): float(rng.randrange(1, 50)) for y in range(31) for x in range(45) if rng.random() < (0.97 if name in ("chamfer", "euclid", "erode") else 0.5)}
    reach, kernel = KERNELS[name]
    got = tiles.on_tiles(frame(spark, cells), reach, 45, 31, kernel, tile=10)
    want = kernel(dense(cells, 31, 45))
    rows = [tuple(r)[1:] for r in got.collect()]
    assert len(rows) == len({r[:2] for r in rows}) == np.count_nonzero(want) and all(abs(want[y, x] - v) < 1e-9 for y, x, v in rows)


def test_median_against_sorting():
    a = np.random.default_rng(3).integers(0, 9, (12, 15)).astype(float)
    wide = np.pad(a, 2, "edge")
    assert np.array_equal(tiles.median(5)(a), [[sorted(wide[y : y + 5, x : x + 5].ravel())[12] for x in range(15)] for y in range(12)])


@pytest.mark.parametrize("chamfer", [True, False])
@pytest.mark.parametrize("reach", [1, 5, 17.5])
def test_borders_of_any_reach(spark, chamfer, reach):
    rng = random.Random(7)
    cells = {(y, x): 1.0 + y for y in range(60) for x in range(70) if rng.random() > 0.003}
    blank = [(y, x) for y in range(60) for x in range(70) if (y, x) not in cells]

    def far(y, x, by, bx):
        a, b = sorted((abs(y - by), abs(x - bx)))
        return 0.955 * (b - a) + 1.3693 * a if chamfer else math.hypot(a, b)

    want = {(y, x) for y, x in cells if all(far(y, x, *b) > reach for b in blank)}
    assert blank and {(r.y, r.x) for r in focal.erase_border(frame(spark, cells), 70, 60, reach, chamfer).collect()} == want


@pytest.mark.parametrize("distinct", [7, 5000])
def test_percentiles_over_partition_borders(spark, distinct):
    rng = np.random.default_rng(distinct)
    rows = [(r, i // 100, i % 100, float(v)) for r, n in ((1, 4000), (2, 1), (3, 777)) for i, v in enumerate(rng.integers(1, distinct, n) / 8)]
    p = spark.createDataFrame(rows, "raster_id int, y int, x int, v double")
    shares = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        got = {r[0]: r[1:] for r in map(tuple, pixels.raster_percentiles(p, *shares).collect())}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in (1, 2, 3):
        assert np.allclose(got[r], np.percentile([v for i, _, _, v in rows if i == r], [100 * s for s in shares]))


def test_percentile_sketches_are_near(spark):
    p = spark.range(200_000).select(F.lit(1).alias("raster_id"), (F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    shares, values = (0.01, 0.5, 0.99), np.arange(200_000) * 7919 % 200_003
    got = pixels.percentile_sketch(p, *shares, accuracy=1000).first()
    assert all(abs((values <= got[f"p{i}"]).mean() - s) <= 1 / 1000 + 1e-5 for i, s in enumerate(shares))


def test_cones_are_painted_as_their_sql_says(spark):
    """By hand on odd points: outside the raster, on one pixel, of equal height, without height; and in more than one task."""
    offsets = [(dx, dy, dx * dx + dy * dy) for dx in range(-3, 4) for dy in range(-3, 4) if dx * dx + dy * dy <= 9]
    rng = random.Random(4)
    points = [(r, i, rng.randrange(-5, 35), rng.randrange(-5, 45), rng.choice([0, 1, 2, 2, 7])) for i, r in enumerate([1, 2] * 40)]
    points += [(1, 900, 8, 8, 2), (1, 901, 8, 8, 2), (1, 902, 8, 8, 1), (1, 903, 8, 8, None), (1, 904, None, 8, 5), (2, 905, 12, 12, 0)]
    want = {}
    for r, i, y, x, h in points:
        for dx, dy, d2 in offsets:
            if None not in (y, h) and 0 <= y + dy < 30 and 0 <= x + dx < 40 and 4 * h - d2 > 0:
                at = (r, y + dy, x + dx)
                want[at] = max(want.get(at, (0, 0)), ((4 * h - d2) / 4, -i))
    made = tiles.painted(spark.createDataFrame(points, "raster_id int, id long, y int, x int, h int"), offsets, 40, 30, 16)
    assert sorted(made.collect()) == sorted((*at, v, -less) for at, (v, less) in want.items())


def test_few_rows_that_make_many_go_to_all_cores(spark):
    """Trees and the scene come of one small file, which is one task unless its rows are dealt out."""
    for name in ("trees", "scene"):
        parts = table(spark, "/root/testdata/sf0.001", name).select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts >= 4, name


@pytest.mark.parametrize("k,times", [(3, 1), (4, 2), (10, 3)])
def test_rectangles_over_tiles_equal_window_frames(spark, k, times):
    """Heights of both signs and zero, gaps, and more than one tile; a pixel is shuffled once."""
    cells = spark.range(300 * 270).selectExpr("1 AS raster_id", "CAST(id DIV 300 AS INT) AS y", "CAST(id % 300 AS INT) AS x", "CAST(pmod(xxhash64(id), 7) - 3 AS DOUBLE) AS v").where("pmod(xxhash64(x, y), 500) != 0")
    for f in (pixels.erode_rect, pixels.dilate_rect, pixels.close_rect):
        made = f(cells, k, times, 300, 270)
        framed = f(cells, k, times, F.lit(300), F.lit(270))
        assert made.schema.simpleString() == framed.schema.simpleString()
        assert made.exceptAll(framed).isEmpty() and framed.exceptAll(made).isEmpty()
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == (2 if f is pixels.close_rect else 1)


def test_augmented_patches_equal_the_single_codes(spark):
    """Patches across tiles and with gaps, against crop() and each code by itself; no patch pixel is shuffled."""
    rng = random.Random(8)
    p = frame(spark, {(y, x): rng.randrange(0, 9) * 1.0 for y in range(40) for x in range(44) if rng.random() < 0.7})
    boxes = spark.createDataFrame([(1, 10 + i, rng.randrange(0, 34), rng.randrange(0, 38)) for i in range(20)] + [(1, 99, 60, 60), (1, 98, 15, 15), (1, 97, 15, 15)], "raster_id int, tid long, y0 int, x0 int")
    made = dataset.augmented(p, boxes, "tid", 6, 30, 16)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    patch, cols = dataset.crop(p, boxes, "tid", 6), ["raster_id", "tid", "px", "py"]
    each = {c: dataset.turn(patch, c, 6) for c in (0, 1, 5)} | {2: dataset.soften(patch, ["raster_id", "tid"], 6), 3: dataset.rotate(patch, ["raster_id", "tid"], 6, 30)}
    want = sorted((*r[:4], round(r.v, 9), c) for c, df in each.items() for r in df.select(*cols, "v").collect())
    assert sorted((*r[:4], round(r.v, 9), r.code) for r in made.collect()) == want
