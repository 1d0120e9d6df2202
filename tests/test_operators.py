"""Operators on hand-made rasters and points, and queries against their SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from groundgrid.operators import components, dataset, evaluation, pixels, points, windows

SF = "/root/testdata/sf0.001"
CHECKED = ["p2_subtract_floor", "f1_erode_rect", "f2_dilate_rect", "c2_component_stats", "w1_assign_windows", "h5_nearest", "h6_matched_pct", "h14_class_eval", "t3_refine_tops", "r6_decile_report", "d1_crop_patches", "d6_augment_annotations", "d7_label_pairs", "m6_class_metrics", "e4_best_config_per_mosaic", "e7_log_to_metrics"]


def same(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem", "events", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert cols == sorted(want.columns)
    a = sorted((tuple(map(same, r)) for r in df.select(*cols).collect()), key=repr)
    b = sorted((tuple(map(same, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert a == b


def flood(cells):
    left, sizes = set(cells), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            n += 1
            for c in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if c in left:
                    left.remove(c)
                    todo.append(c)
        sizes.append(n)
    return sorted(sizes)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_flood_fill(spark, seed):
    rng = random.Random(seed)
    cells = {(rng.randrange(12), rng.randrange(12)) for _ in range(60)}
    p = spark.createDataFrame([(1, y, x) for y, x in cells], "raster_id int, y int, x int")
    for n in (1, 7):
        found = components.stats(components.label_runs(p.repartition(n)))
        assert sorted(r.area for r in found.collect()) == flood(cells)


def test_erosion_and_dilation_bound_the_raster(spark):
    p = spark.createDataFrame([(1, y, x, float(y + x + 1)) for y in range(6) for x in range(6) if (y, x) != (3, 3)], "raster_id int, y int, x int, v double")
    v = {(r.y, r.x): r.v for r in p.collect()}
    low = {(r.y, r.x): r.v for r in pixels.erode_rect(p, 3, 1, 6, 6).collect()}
    high = {(r.y, r.x): r.v for r in pixels.dilate_rect(p, 3, 1, 6, 6).collect()}
    assert all(low[k] <= v[k] for k in low) and all(high[k] >= v[k] for k in v)
    assert (2, 2) not in low and high[3, 3] == 9.0
    closed = pixels.close_rect(p, 3, 1, 6, 6)
    assert sorted(closed.collect()) == sorted(pixels.close_rect(closed, 3, 1, 6, 6).collect())


def test_matches_grow_with_eps_and_empty_sides_count_minus_one(spark):
    a = spark.createDataFrame([(1, i, i * 10, 0) for i in range(5)] + [(2, 9, 0, 0)], "raster_id int, id int, x int, y int")
    b = spark.createDataFrame([(1, i, i * 10 + i, 0) for i in range(5)], "raster_id int, id int, x int, y int")
    rows = {(r.raster_id, r.eps): r.matched_pct for r in points.matched_counts(a, b, [1, 2, 4]).collect()}
    assert rows[1, 1.0] == 20 and rows[1, 2.0] == 40 and rows[1, 4.0] == 80 and rows[2, 1.0] == -1


def test_windows_overlap_and_gate(spark):
    p = spark.createDataFrame([(1, 0, x, 1.0) for x in range(20)], "raster_id int, y int, x int, v double")
    w = windows.assign(p, 10, 8)
    n = {r.win_x: r["count"] for r in w.groupBy("win_x").count().collect()}
    assert n == {0: 10, 8: 10, 16: 4}
    assert windows.gate(w, 9).select("win_x").distinct().count() == 2


def test_golden_class_metrics(spark):
    m = [[267, 4, 1], [1, 821, 3], [0, 19, 20]]
    rows = evaluation.class_metrics(spark.createDataFrame([(i, j, m[i][j]) for i in range(3) for j in range(3)], "actual int, predicted int, n long"))
    got = {r.cls: (r.sensitivity, r.specificity, r.accuracy) for r in rows.collect()}
    assert got[0] == pytest.approx((267 / 272, 863 / 864, 1130 / 1136))
    assert got[1] == pytest.approx((821 / 825, 288 / 311, 1109 / 1136))
    assert got[2] == pytest.approx((20 / 39, 1093 / 1097, 1113 / 1136))


def test_four_turns_give_the_patch_back(spark):
    p = spark.createDataFrame([(y, x, float(3 * y + x)) for y in range(3) for x in range(3)], "py int, px int, v double")
    t = p
    for _ in range(4):
        t = dataset.turn(t, 0, 3)
    assert sorted(t.select("py", "px", "v").collect()) == sorted(p.collect())
    assert sorted(dataset.turn(dataset.turn(p, 1, 3), 1, 3).select("py", "px", "v").collect()) == sorted(p.collect())


def test_two_layers_are_an_error_if_strict(spark):
    p = spark.createDataFrame([(1, 5, 0, 0)], "raster_id int, id int, x int, y int")
    layers = spark.createDataFrame([(1, "a", 0, 0), (1, "b", 0, 0)], "raster_id int, layer string, y int, x int")
    assert points.classify_by_layer(p, layers, "id", strict=False).first().n_layers == 2
    with pytest.raises(Exception, match="two class layers"):
        points.classify_by_layer(p, layers, "id").select(F.col("cls")).collect()
