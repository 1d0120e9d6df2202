"""Steps that shuffle blocks or few rows instead of pixels, against the plain way and by their plans."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundgrid.operators import classify, clustering, components, dataset, focal, points, tiles, tops, tree
from groundgrid.plans import fixtures
from groundgrid.sources import files, images


def frame(spark, seed, height, width, values, share=0.8, parts=3):
    rng = random.Random(seed)
    rows = [(1, y, x, float(rng.choice(values))) for y in range(height) for x in range(width) if rng.random() < share]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "raster_id int, y int, x int, v double").repartition(parts)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_halving_in_one_pass_equals_single_passes(spark):
    """a median and four halvings shuffle once, and give the very heights of the single passes."""
    p = frame(spark, 1, 150, 170, range(1, 90))
    small, w, h = focal.median_blur(p, 5, 170, 150), 170, 150
    for _ in range(2):
        small, w, h = focal.pyr_down(small, w, h), (w + 1) // 2, (h + 1) // 2
    made = clustering._reduced(p, 170, 150, 2)
    assert plan(made).count("Exchange hashpartitioning") == 1
    assert sorted(made.collect()) == sorted(small.collect())


def test_highest_pixels_of_clusters_need_no_sort_of_pixels(spark):
    """ties by y, then x, places below 0, too; only heights of groups are sorted."""
    p = frame(spark, 2, 40, 40, [1, 2, 3]).withColumns({"y": F.col("y") - 20, "x": F.col("x") - 20}).withColumn("label", (F.col("v") % 3 + (F.col("x") > 0).cast("int")).cast("long"))
    want = {}
    for r in p.where("label > 0").collect():
        want[r.label] = min(want.get(r.label, (9, 0, 0)), (-r.v, r.y, r.x))
    made = clustering.cluster_argmax(p)
    assert {r.label: (-r.v, r.y, r.x) for r in made.collect()} == want
    assert "HashAggregate(keys=[raster_id" in plan(made)
    q = frame(spark, 3, 64, 64, [2, 2, 9, 9, 9, 30, 30])
    args = (q, 0.5, 1, 64, 64, 2)
    a = clustering.cluster_argmax(clustering.dbscan_reduced(*args)).collect()
    assert a and sorted(a) == sorted(clustering.reduced_argmax(*args).collect())


@pytest.mark.parametrize("cluster", [clustering.kmeans_pixels, clustering.gmm_pixels])
def test_labels_of_few_heights_are_broadcast(spark, cluster):
    """Pixels with one of few heights are not shuffled by their height."""
    p = components.written(frame(spark, 4, 30, 30, [1, 2, 50, 51, 90, 91]))
    assert "SortMergeJoin" not in plan(cluster(p, 3)) and "BroadcastHashJoin" in plan(cluster(p, 3))


def test_components_bring_their_highest_pixel_along(spark):
    """the highest pixel and the component under a point, without a join on every pixel."""
    p = frame(spark, 5, 30, 300, [1, 2, 3], 0.35)
    labelled = components.label_runs(p)
    at = {(r.y, r.x): (r.comp_y, r.comp_x) for r in components.component_pixels(labelled).collect()}
    want = {}
    for r in p.collect():
        want[at[r.y, r.x]] = min(want.get(at[r.y, r.x], (9, 0, 0)), (-r.v, r.x, r.y))
    made = components.argmax(components.label_given(components.runs(p, tops=True)))
    assert {(r.comp_y, r.comp_x): (-r.v, r.x, r.y) for r in made.collect()} == want
    points = spark.createDataFrame([(1, i, y, x) for i, (y, x) in enumerate([(y, x) for y in range(-1, 31) for x in range(-1, 301)])], "raster_id int, pid int, y int, x int")
    got = components.looked_up(points, labelled, tile=64)
    assert {(r.y, r.x): (r.comp_y, r.comp_x) for r in got.collect()} == {(y, x): at.get((y, x), (None, None)) for y in range(-1, 31) for x in range(-1, 301)}


def test_patches_in_their_tile_equal_crops(spark):
    """features and sums of patches across tiles, with gaps, against crop()."""
    p = frame(spark, 6, 40, 44, range(255), 0.7).where("NOT (y > 30 AND x > 30)").selectExpr("raster_id", "y", "x", "CAST(v AS INT) AS r", "CAST(254 - v AS INT) AS g", "CAST((v * 7) % 256 AS INT) AS b")
    rng = random.Random(8)
    boxes = spark.createDataFrame([(1, 10 + i, rng.randrange(0, 34), rng.randrange(0, 38)) for i in range(20)] + [(1, 99, 60, 60), (1, 98, 33, 33), (1, 97, 15, 15), (1, 96, 15, 15)], "raster_id int, tid long, y0 int, x0 int")
    patch = dataset.crop(p, boxes, "tid", 6)
    sums = patch.groupBy("raster_id", "tid").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("px").alias("px"), F.sum("py").alias("py"))
    assert sorted(dataset.box_sums(p, boxes, "tid", 6, "r").collect()) == sorted(sums.collect())
    want, got = ({r.tid: np.array(r[2:]) for r in df.collect()} for df in (classify.patch_features(patch, ["raster_id", "tid"]), classify.box_features(p, boxes, "tid", 6)))
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_blocks_of_a_tile_are_shuffled_not_pixels(spark):
    """every kernel's input; raster keys may be structs, and a pixel in nobody's range goes."""
    p = frame(spark, 9, 20, 20, [1, 2]).withColumn("raster_id", F.struct(F.lit(1).alias("r"), (F.col("v") > 1).cast("int").alias("w")))
    made = tiles.packed(p.coalesce(1), lambda axis, c: (c // 8, np.where(c < 19, c // 8, -1)))
    rows = made.collect()
    assert len(rows) == 2 * 9
    cells = [(r.raster_id.w, int(c["y"]), int(c["x"]), float(c["v"])) for r in rows for c in np.frombuffer(r.cells, tiles.cell())]
    assert sorted(cells) == sorted((r.raster_id.w, r.y, r.x, r.v) for r in p.where("x < 19 AND y < 19").collect())


@pytest.mark.parametrize("factor", [0.3, 1, 1.5, 2.7, 3, 20])
def test_linear_resampling_shuffles_blocks_once(spark, factor):
    """against the plain sum over four pixels, with gaps, a height of 0, places outside, and tiles smaller than the result."""
    p = frame(spark, 10, 23, 41, [-3, 0, 1, 2, 7.5], 0.4).union(spark.createDataFrame([(1, -1, 0, 9.0), (1, 23, 3, 9.0), (1, 4, 41, 9.0), (2, 22, 40, 5.0)], "raster_id int, y int, x int, v double"))
    at = lambda d, n: min(max((d + 0.5) * factor - 0.5, 0.0), n - 1.0)
    near = lambda n: {(d, c): 1.0 - abs(at(d, n) - c) for d in range(int(n / factor)) for c in range(n) if abs(at(d, n) - c) < 1}
    across, down, want = near(41), near(23), {}
    heights = {(r.raster_id, r.y, r.x): r.v for r in p.collect()}
    for (ty, y), b in down.items():
        for (tx, x), a in across.items():
            for r in (1, 2):
                if (r, y, x) in heights:
                    want[r, ty, tx] = want.get((r, ty, tx), 0.0) + heights[r, y, x] * a * b
    made = tiles.resampled(p, factor, 41, 23, 7)
    got = {(r.raster_id, r.y, r.x): r.v for r in made.collect()}
    assert made.schema.simpleString() == p.schema.simpleString() and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert plan(focal.resample_linear(p, factor, 41, 23)).count("Exchange hashpartitioning") == 1


def flood(cells, connectivity=8):
    """The least (y, x) of each pixel's component, by hand."""
    steps = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if connectivity == 8 or not dy or not dx]
    first = {}
    for c in sorted(cells):
        todo = [c] if c not in first else []
        while todo:
            at = todo.pop()
            if at in cells and at not in first:
                first[at] = c
                todo += [(at[0] + dy, at[1] + dx) for dy, dx in steps]
    return first


def marked(spark, cells, parts=3):
    return spark.createDataFrame([(1, y, x) for y, x in cells], "raster_id int, y int, x int").repartition(parts)


def walls(n):
    """A spiral, whose one component winds through all tiles."""
    return {(y, x) for y in range(n) for x in range(n) if (r := min(y, x, n - 1 - y, n - 1 - x)) % 2 == 0 and (y, x) != (r + 1, r)} | {(r + 2, r + 1) for r in range(0, n // 2 - 2, 2)}


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("shape", ["noise", "dense", "spiral", "diagonal", "outside"])
def test_tiles_join_their_runs_before_the_graph(spark, shape, connectivity):
    """labels across tiles by hand, and none but parts on a tile's border come into the graph."""
    rng = random.Random(11)
    cells = {"spiral": walls(26), "diagonal": {(i, (i * s) % 30) for i in range(30) for s in (1, -1)}}.get(shape) or {(y, x) for y in range(24) for x in range(33) if rng.random() < (0.85 if shape == "dense" else 0.45)}
    if shape == "outside":
        cells = {(y - 11, x - 19) for y, x in cells}
    first = flood(cells, connectivity)
    found = components.runs(marked(spark, cells))
    want = sorted((y, x, max(b for b in range(x, x + 40) if all((y, c) in cells for c in range(x, b + 1)))) for y, x in cells if (y, x - 1) not in cells)
    assert sorted(tuple(r)[1:] for r in found.collect()) == want
    made = components.label_given(found, connectivity, tile=7)
    assert made.columns == ["raster_id", "y", "x0", "x1", "comp_y", "comp_x"]
    assert sorted((r.y, r.x0, r.x1, r.comp_y, r.comp_x) for r in made.collect()) == [(y, a, b, *first[y, a]) for y, a, b in want]


def test_only_parts_on_a_border_are_contracted(spark, monkeypatch):
    """components inside of a tile send no edge, and a run's pixels are no rows of a shuffle."""
    cells = {(y + dy, x + dx) for y in range(2, 60, 6) for x in range(2, 60, 6) for dy in range(3) for dx in range(3)}
    edges, plain = [], components.contracted
    monkeypatch.setattr(components, "contracted", lambda e, rounds: edges.append(e.count()) or plain(e, rounds))
    made = components.label_runs(marked(spark, cells))
    assert edges == [0] and {(r.comp_y, r.comp_x) for r in made.collect()} == {(y, x) for y in range(2, 60, 6) for x in range(2, 60, 6)}
    assert components.partial_runs(marked(spark, cells, 1)).count() == len(cells) / 3


def test_large_regions_join_what_can_be_large(spark):
    """by hand; only components whose square holds enough pixels are joined with their runs."""
    rng = random.Random(12)
    cells = {(y, x) for y in range(40) for x in range(300) if rng.random() < 0.42}
    parts = {}
    for c, name in flood(cells).items():
        parts.setdefault(name, []).append(c)
    want = []
    for name, of in parts.items():
        top, left = min(y for y, _ in of), min(x for _, x in of)
        side = min(max(y for y, _ in of) - top, max(x for _, x in of) - left) + 1
        fat = sum(y < top + side and x < left + side for y, x in of)
        if len(of) >= 12 and fat >= 11:
            want.append((1, *name, len(of), fat))
    made = components.large_regions(components.label_runs(marked(spark, cells)), 12, 11)
    assert want and plan(made).count(">= 11)") == 2
    assert sorted(map(tuple, made.collect())) == sorted(want)


def test_points_meet_runs_not_pixels(spark):
    """truncated and missing coordinates by hand; the set's pixels become runs before they are shuffled."""
    rng = random.Random(13)
    cells = {(y, x) for y in range(-3, 30) for x in range(-5, 600) if rng.random() < 0.9}
    places = [(i, rng.uniform(-6, 32), rng.uniform(-8, 605)) for i in range(400)] + [(900, None, 4.0), (901, 4.0, None), (902, -0.5, -0.5), (903, 2.0, 256.0), (904, 2.0, 255.999)]
    at = spark.createDataFrame([(r, i, y, x) for i, y, x in places for r in (1, 2)], "raster_id int, pid int, y double, x double").withColumn("x0", F.lit(7))
    made = points.in_pixels(at, marked(spark, cells))
    assert made.columns == at.columns
    assert {(r.raster_id, r.pid) for r in made.collect()} == {(1, i) for i, y, x in places if None not in (y, x) and (math.floor(y), math.floor(x)) in cells}
    assert "MapInArrow" in plan(made)


def test_masks_of_another_shape_meet_heights_by_tile(spark):
    """against the join, with gaps, pixels twice in the mask, places below 0, a raster without a mask, and one without pixels; no pixel is sorted by its place."""
    p = frame(spark, 14, 300, 270, [-1, 0, 2.5], 0.8).union(spark.createDataFrame([(1, -1, -300, 4.0), (2, 7, 9, 5.0)], "raster_id int, y int, x int, v double"))
    mask = frame(spark, 15, 150, 135, [1], 0.3)
    mask = mask.union(mask.where("y < 3")).union(mask.where("y = 1").withColumn("raster_id", F.lit(3))).select("raster_id", "y", "x")
    sizes = spark.createDataFrame([(r, 135, 150, 270, 300) for r in (1, 2, 3)], "raster_id int, width int, height int, to_width int, to_height int")
    made, joined = focal.mask_out(p, mask, sizes), focal.mask_out(p.withColumn("more", F.lit(1)), mask, sizes).drop("more")
    assert made.schema.simpleString() == joined.schema.simpleString() and 0 < made.count() < p.count()
    assert made.exceptAll(joined).isEmpty() and joined.exceptAll(made).isEmpty()
    assert "LeftAnti" in plan(joined) and "LeftAnti" not in plan(made) and "FlatMapCoGroupsInArrow" in plan(made)


def test_light_filters_are_one_pass_over_tiles(spark):
    """blur, erosion and closing shuffle the scene once, and both filters together do, too."""
    rgb = spark.createDataFrame([(1, y, x, *[(20, 90, 230)[(y // 20 + x // 25) % 3]] * 3) for y in range(70) for x in range(90)], "raster_id int, y int, x int, r int, g int, b int")
    dark, light = focal.filter_shadows(rgb, 90, 70, 60), focal.filter_bright(rgb, 90, 70, 150)
    both = focal.filter_both(rgb, 90, 70, 60, 150)
    assert all(plan(df).count("Exchange hashpartitioning") == 1 for df in (dark, light, both))
    want = set(dark.collect()) | set(light.collect())
    assert dark.count() and light.count() and sorted(both.collect()) == sorted(want)


@pytest.mark.parametrize("size", [6, 1500])
def test_floor_grows_in_tiles_of_whole_windows(spark, size):
    """five rounds by hand, with pixels below 0, floor pixels twice and off the raster; heights are shuffled once where tiles hold all windows."""
    p = frame(spark, 16, 60, 70, [0.5, 1, 2, 3, 5, 8, 13]).union(spark.createDataFrame([(1, -3, -5, 2.0), (1, -3, -6, 3.0)], "raster_id int, y int, x int, v double"))
    first = p.where("v < 2 OR y < 0 AND v < 3").select("raster_id", "y", "x")
    first = first.union(first.where("x < 5")).union(spark.createDataFrame([(1, 500, 3)], "raster_id int, y int, x int"))
    v, want = {(r.y, r.x): r.v for r in p.collect()}, {(r.y, r.x) for r in first.collect()}
    sizes = [size, int(size * 1.5), size * 2]
    for s in sizes:
        held = {}
        for c in want & v.keys():
            if 1 <= v[c] <= 255:
                held.setdefault((c[0] // s, c[1] // s), []).append(v[c])
        want |= {c for c in v if v[c] < (math.floor(sum(h) / len(h)) if (h := held.get((c[0] // s, c[1] // s))) else 0) + 2}
    if size < 100:
        made = tops._extended(p, first, sizes, 2)
        assert plan(made).count("Exchange hashpartitioning") == 2
    else:
        made = first
        for s in sizes:
            made = tops.extend_floor(p, made, s, 2)
    rows = [(r.y, r.x) for r in made.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_lines_of_the_scene_meet_places_not_parts(spark):
    """the scene's rows are made of its lines and places; joined as they stood, each line met 16 times the parts."""
    scene = fixtures.table(spark, "/root/testdata/sf0.001", "scene")
    assert "ReadSchema: struct<x:int>" in plan(scene) and scene.count() == scene.select("y", "x").distinct().count() > 0


def test_leaves_of_a_merge_tree_are_not_pixels():
    """Pixels of one band and component that hang together are one leaf, and only leaves are looked at one by one."""
    y, x = (c.ravel() for c in np.mgrid[0:20, 0:30])
    tile = tree._Tile(None, 0.0, 0.0, {}, 1)
    tile.fill(y, x, 1.0 * y, (x >= 10).astype(int), (x == 3).astype(int), (x >= 20).astype(int), [(0, 0), (0, 20)], x < 0)
    assert sorted((p.area, p.band, p.marks, p.high, p.first, p.comp) for p in tile.leaves.values()) == [(200, 0, 20, (-19.0, 19, 0), (0, 0), (0, 0)), (200, 1, 0, (-19.0, 19, 10), (0, 10), (0, 0)), (200, 1, 0, (-19.0, 19, 20), (0, 20), (0, 20))]
    assert len(tile.edges) == 1


def test_windows_and_disks_shuffle_blocks_not_pixels(spark):
    """A window's steps are one task, seeds meet heights in tiles, and runs with tops are made where their pixels are read."""
    p = frame(spark, 17, 60, 60, range(1, 60))
    windowed = tops.keyed_by_window(p, 30, 24)
    made = tops.process_windows(windowed, tops.window_extent(30, 60, 60), 0.3, 1, 1, tops.same_params(windowed, 4.0, 2.0, 3))
    assert "Window" not in plan(made) and plan(made).count("Exchange hashpartitioning(raster_id") <= 2 and made.count()
    seeds = p.where("x % 9 = 0 AND y % 7 = 0").withColumnRenamed("v", "h")
    assert "FlatMapCoGroupsInArrow" in plan(tops.trim_canopy(p, seeds, 4, 10))
    assert "MapInArrow" in plan(components.runs(p, tops=True))


def test_windows_side_by_side_are_cleaned_in_their_tile(spark):
    """against the old frames' way over windows of their own; cut windows at the raster's end, one with few pixels, one of a single height."""
    p = frame(spark, 18, 50, 70, range(1, 40)).where("NOT (y >= 40 AND x >= 60)").withColumn("v", F.expr("CASE WHEN y < 20 AND x < 20 THEN 7.0D ELSE v END"))
    p = p.union(spark.createDataFrame([(1, 45, 65, 3.0), (2, 1, 1, 4.0)], "raster_id int, y int, x int, v double"))
    made = tops.window_clean(p, 20, 0.2, 2, 1, 70, 50, gate=30)
    assert plan(made).count("Exchange hashpartitioning") == 1
    windowed = tops.keyed_by_window(p, 20, 20)
    want = {}
    for (r, wx, wy), cells in _grouped(windowed).items():
        v = np.array(list(cells.values()))
        if len(v) <= 30:
            want |= {(r, y + wy, x + wx): h for (y, x), h in cells.items()}
            continue
        p0, p1 = np.percentile(v, [20, 99])
        a = np.full((min(20, 50 - wy), min(20, 70 - wx)), np.nan)
        for (y, x), h in cells.items():
            if p1 > p0 and h > p0:
                a[y, x] = (min(h, p1) - p0) * (255 / (p1 - p0))
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                if not np.isnan(low := a[max(0, y - 1) : y + 1, max(0, x - 1) : x + 1].min()):
                    want[r, y + wy, x + wx] = low
    got = {(r.raster_id, r.y, r.x): r.v for r in made.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(got) > 100


def _grouped(windowed):
    out = {}
    for r in windowed.collect():
        out.setdefault((r.raster_id.r, r.raster_id.wx, r.raster_id.wy), {})[r.y, r.x] = r.v
    return out


def test_small_tiff_files_share_partitions_and_send_no_paths(spark, tmp_path):
    """pixels go to files in blocks, files are read many to a task, and no pixel brings its path along."""
    p = frame(spark, 19, 90, 110, [0, 0.5, 3])
    images.write_tiff_tiles(p, str(tmp_path / "t"), 10)
    assert len(list((tmp_path / "t").iterdir())) == 99 and len(images.TiffReader(str(tmp_path / "t"), 4 << 20).partitions()) <= 4
    back = images.read_tiff_tiles(spark, str(tmp_path / "t"))
    assert "regexp" not in plan(back).lower()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, p.where("v != 0").collect()))


def test_patch_images_are_made_in_their_tile_and_read_many_to_a_task(spark, tmp_path):
    """the files are those of write_patch_images(), with gaps; a task reads many, and a row is an image, not a pixel."""
    p = frame(spark, 20, 60, 60, range(255), 0.8).selectExpr("raster_id", "y", "x", "CAST(v AS INT) AS r", "CAST(v * 3 % 256 AS INT) AS g", "CAST(254 - v AS INT) AS b").where("NOT (y > 50 AND x > 40)")
    boxes = spark.createDataFrame([(1, i, 1 + i % 2, "oak", (i * 7) % 53, (i * 13) % 53) for i in range(30)], "raster_id int, tid long, site int, cls string, y0 int, x0 int").withColumns({"raster_id": F.lit(1), "cls": F.lit("oak")})
    one, two = str(tmp_path / "a"), str(tmp_path / "b")
    images.write_box_images(p, boxes, "tid", 8, one)
    images.write_patch_images(dataset.crop(p, boxes, "tid", 8).join(boxes.select("raster_id", "tid", "site", "cls"), ["raster_id", "tid"]), ["raster_id", "tid"], two)
    held = [{f.relative_to(d).as_posix(): f.read_bytes() for f in (tmp_path / d.name).rglob("*.png")} for d in (tmp_path / "a", tmp_path / "b")]
    assert held[0] == held[1] and len(held[0]) > 20 and len(images.PngReader(one, 4000).partitions()) == 1
    want = {}
    for r in files.read_image_pixels(spark, f"{two}/site=*/cls=*").collect():
        name = r.path.rpartition("/")[2]
        want[name] = [a + b for a, b in zip(want.get(name, (0, 0, 0, 0)), (1, r.r, r.g * r.x, r.b * r.y))]
    assert {r.path.rpartition("/")[2]: list(r)[1:] for r in images.png_sums(spark, one).collect()} == want


def test_png_filters_and_refusals():
    """every filter of a line, by hand."""
    a = np.random.default_rng(3).integers(0, 256, (6, 5, 3)).astype("uint8")
    lines = b""
    for y in range(6):
        kind, up = y % 5, a[y - 1].astype(int) if y else np.zeros((5, 3), int)
        left, corner = (np.vstack([np.zeros((1, 3), int), c[:-1]]) for c in (a[y].astype(int), up))
        q = left + up - corner
        paeth = np.where((abs(q - left) <= abs(q - up)) & (abs(q - left) <= abs(q - corner)), left, np.where(abs(q - up) <= abs(q - corner), up, corner))
        lines += bytes([kind]) + ((a[y] - [0, left, up, (left + up) // 2, paeth][kind]) & 255).astype("uint8").tobytes()
    plain = images.png_bytes(a)
    at, n = plain.index(b"IDAT"), int.from_bytes(plain[plain.index(b"IDAT") - 4 : plain.index(b"IDAT")], "big")
    packed = zlib.compress(lines)
    assert (images.png_array(plain) == a).all() and (images.png_array(plain[: at - 4] + len(packed).to_bytes(4, "big") + b"IDAT" + packed + plain[at + 4 + n :]) == a).all()
    with pytest.raises(ValueError, match="not a PNG file"):
        images.png_array(b"GIF89a")
