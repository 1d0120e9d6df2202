"""The band sweep against a plain version, file sources, and raster queries against their SQL."""

import random

import pytest
from test_operators import flood, test_query_equals_its_sql as equals_its_sql

from groundgrid.operators import components, focal, pixels, tops
from groundgrid.sources import files


@pytest.mark.parametrize("name", ["f4_gaussian_blur", "f6_pyr_down", "f9_local_maxima", "f10_erase_border", "p8_window_stretch", "t10_box_stats", "k4_dbscan_1d", "s13_metric_rows"])
def test_raster_query_equals_its_sql(spark, name):
    equals_its_sql(spark, name)


def plain_sweep(cells, step, eps, min_pix):
    """Labels every band anew."""
    top, low = max(c[2] for c in cells), min(c[2] for c in cells)
    if top == low:
        return []
    kept = []
    for k in range(max(1, int((top - step - low) / step) - 1)):
        left = {(y, x): v for y, x, v in cells if v >= top - (k + 1) * step}
        now = []
        while left:
            todo, part = [left.popitem()], {}
            while todo:
                (y, x), v = todo.pop()
                part[y, x] = v
                for c in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                    if c in left:
                        todo.append((c, left.pop(c)))
            mine = sorted((-v, y, x) for y, x, v in kept if (y, x) in part)
            mine = [t for i, t in enumerate(mine) if all((t[1] - u[1]) ** 2 + (t[2] - u[2]) ** 2 >= 4 * eps * eps for u in mine[:i])]
            if not mine and len(part) > min_pix:
                mine = [min((-v, y, x) for (y, x), v in part.items())]
            now += [(y, x, -v) for v, y, x in mine]
        kept = now
    return sorted(kept)


@pytest.mark.parametrize("seed", range(6))
def test_sweep_equals_labelling_every_band(seed):
    rng = random.Random(seed)
    cells = [(y, x, float(rng.randrange(1, 40))) for y in range(14) for x in range(14) if rng.random() < 0.8]
    assert tops.sweep(cells, 3.0, 1.5, 3) == plain_sweep(cells, 3.0, 1.5, 3)
    assert tops.sweep([(0, 0, 5.0), (0, 1, 5.0)], 1.0, 1.0, 0) == []


def test_holes_are_filled_and_bays_are_not(spark):
    ring = [(1, y, x) for y in range(1, 6) for x in range(1, 6) if not (2 <= y <= 4 and 2 <= x <= 4)]
    mask = spark.createDataFrame([c for c in ring], "raster_id int, y int, x int")
    assert focal.fill_holes(mask, 8, 8).count() == 25
    assert focal.fill_holes(mask.where("NOT (y = 1 AND x = 3)"), 8, 8).count() == 15
    assert flood({(y, x) for _, y, x in ring}) == [16]


def test_manifest_boxes_matrix_and_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text("# comment\n\npatchSize 100\nmosaic in/ Z1.jpg Z1t.jpg 2 a A.jpg b B.jpg out\nimportant a\n")
    m = files.read_manifest(spark, str(tmp_path / "m.txt"))
    assert {r.keyword: r.args for r in m.collect()}["patchSize"] == ["100"]
    one = files.layers_of(m).first()
    assert (one.folder, one.output) == ("in/", "out") and [tuple(x) for x in one.layers] == [("a", "A.jpg"), ("b", "B.jpg")]
    (tmp_path / "bad.txt").write_text("colour 3\n")
    with pytest.raises(Exception, match="unknown keyword"):
        files.read_manifest(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "b.txt").write_text("1 2 3 4\n5 6 7 8\n")
    assert [tuple(r) for r in files.read_boxes(spark, str(tmp_path / "b.txt")).collect()] == [(1, 2, 3, 4), (5, 6, 7, 8)]
    (tmp_path / "x.txt").write_text("head\nc1 0.5 oops 2\n")
    assert [(r.config_ord, r.mosaic, r.value) for r in files.read_metric_matrix(spark, str(tmp_path / "x.txt"), 1).collect()] == [(1, 1, 0.5), (1, 3, 2.0)]


def plain_mask(cells, n, before, after, iterations, grow):
    for _ in range(iterations):
        frame = lambda c: range(max(0, c - before), min(n, c + after + 1))
        some = any if grow else all
        cells = {(y, x) for y in range(n) for x in range(n) if some((v, u) in cells for v in frame(y) for u in frame(x))}
    return cells


@pytest.mark.parametrize("dark, closings", [(True, 3), (False, 7)])
def test_light_filters_erode_and_close_with_the_sizes_of_the_reference(spark, dark, closings):
    n = 44
    shape = {(y, x) for y in range(n) for x in range(n) if (4 <= y < 40 and (3 <= x < 19 or 26 <= x < 43)) or (y < 3 and x < 3)}
    light = [(1, y, x, *[(60 if ((y, x) in shape) == dark else 200)] * 3) for y in range(n) for x in range(n)]
    rgb = spark.createDataFrame(light, "raster_id int, y int, x int, r int, g int, b int")
    got = {(r.y, r.x) for r in (focal.filter_shadows(rgb, n, n) if dark else focal.filter_bright(rgb, n, n, 100)).collect()}
    soft = focal.gaussian_blur(pixels.gray(rgb), 5, 5, n, n).collect()
    want = plain_mask({(r.y, r.x) for r in soft if (r.v <= 100) == dark}, n, 2, 2, 3, False)
    for grow in (True, False):
        want = plain_mask(want, n, 5, 4, closings, grow)
    assert got == want and got


@pytest.mark.parametrize("name", ["p16_filter_shadows", "p16_filter_shadows_whole", "p17_filter_bright", "p17_filter_bright_whole"])
def test_light_query_equals_its_sql(spark, name):
    equals_its_sql(spark, name)


def test_exploded_pixels_are_not_broadcast(spark):
    """A few rows that make many pixels look as small as they were; 6 times sf0.1's trees made a broadcast of 4 GB in t7."""
    labelled = components.label_runs(spark.createDataFrame([(1, 2, 3, 1.0), (1, 2, 4, 2.0)], "raster_id int, y int, x int, v double"))
    pixel = components.written(spark.createDataFrame([(1, 2, 3, 1.0)], "raster_id int, y int, x int, v double"))
    joined = components.component_pixels(labelled).join(pixel, ["raster_id", "y", "x"])
    assert "Broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString() and "SortMergeJoin" in joined._jdf.queryExecution().sparkPlan().toString()
    assert float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) > 1
