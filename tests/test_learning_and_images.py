"""Clusters and classifiers on planted classes, density clusters against brute force, and image files."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundgrid.operators import classify, clustering, focal
from groundgrid.operators.ranges import running
from groundgrid.sources import files, images


def heights(spark, values, rid=1):
    return spark.createDataFrame([(rid, i // 50, i % 50, float(v)) for i, v in enumerate(values)], "raster_id int, y int, x int, v double")


def planted(rng, n=300):
    return [float(v) for c in (10, 30, 70) for v in np.round(rng.normal(c, 1.0, n), 2)]


@pytest.mark.parametrize("cluster", [clustering.kmeans_pixels, clustering.gmm_pixels])
def test_clusters_find_planted_heights(spark, cluster):
    p = heights(spark, planted(np.random.default_rng(2)))
    rows = cluster(p, 3).collect()
    sides = [{r.label for r in rows if abs(r.v - c) < 6} for c in (10, 30, 70)]
    assert len(rows) == 900 and all(len(s) == 1 for s in sides) and len(set.union(*sides)) == 3


def plain_dbscan(values, eps, least):
    core = sorted({v for v in values if sum(abs(v - u) <= eps for u in values) >= least})
    label, c = {}, 0
    for i, v in enumerate(core):
        c += i == 0 or v - core[i - 1] > eps
        label[v] = c
    near = lambda v: min(((abs(v - u), u) for u in core if abs(v - u) <= eps), default=None)
    return {v: label[v] if v in label else label[n[1]] if (n := near(v)) else 0 for v in set(values)}


@pytest.mark.parametrize("parts", [1, 9])
def test_density_clusters_over_partition_borders(spark, parts):
    rng = random.Random(parts)
    values = [round(rng.gauss(c, s), 3) for c, s, n in ((5, 0.4, 150), (9, 0.3, 90), (20, 6, 60)) for _ in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.v: r.label for r in clustering.dbscan_1d(heights(spark, values), 0.2, 8).collect()}
        assert got == plain_dbscan(values, 0.2, 8) and len(set(got.values())) > 2
        rows = running(heights(spark, values), ["y", "x"], {"s": F.col("v")}, {"b": F.when(F.col("v") > 9, F.col("v"))}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, last = 0.0, None
    for r in sorted(rows, key=lambda r: (r.y, r.x)):
        total += r.v
        assert abs(r.s - total) < 1e-9 and r.b == last
        last = r.v if r.v > 9 else last


def test_bandwidth_is_the_mean_distance_to_the_tenth_of_the_sample(spark):
    values = planted(np.random.default_rng(1), 30)  # 90 pixels: all are in the sample
    want = np.mean([sorted(abs(v - u) for u in values)[8] for v in values])
    assert abs(clustering.estimated_bandwidth(heights(spark, values)).first()["bandwidth"] - want) < 1e-9


def patches(spark):
    rng = np.random.default_rng(4)
    rows = []
    for tid in range(60):
        cls = ("oak", "fir", "fir", "fir", "oak", "elm")[tid % 6]
        base = {"oak": 60, "fir": 140, "elm": 220}[cls]
        rows += [(1, tid, cls, *(int(v) for v in rng.integers(base - 20, base + 20, 3))) for _ in range(12)]
    return spark.createDataFrame(rows, "raster_id int, tid int, cls string, r int, g int, b int")


def test_tuning_counts_and_predicts_planted_classes(spark):
    p = patches(spark)
    f = classify.patch_features(p, ["raster_id", "tid"]).join(p.select("tid", "cls").distinct(), "tid").cache()
    table, model = classify.tune(f, [0.001, 1000.0], [4], [0, 2], folds=2)
    rows = {(r.family, r.setting, r.factor): r.accuracy for r in table.collect()}
    assert len(rows) == 6 and set(rows) == {("logistic", s, w) for s in (0.001, 1000.0) for w in (0, 2)} | {("forest", 4.0, w) for w in (0, 2)}
    assert rows["logistic", 0.001, 0] == rows["forest", 4.0, 0] == 1.0
    # With an endless penalty only the majority of each fold's other rows is left, so accuracy can be counted.
    folded = [(r.cls, r.fold) for r in f.withColumn("fold", F.pmod(F.xxhash64("raster_id", "tid"), F.lit(2))).collect()]
    shares = [np.mean([c == "fir" for c, k in folded if k == fold]) for fold in (0, 1)]
    assert abs(rows["logistic", 1000.0, 0] - np.mean(shares)) < 0.05
    assert all(r.predicted == r.cls for r in classify.predict(model, f).collect())
    trained = classify.train(f.where("tid < 40"))
    assert all(r.predicted == r.cls for r in classify.predict(trained, f.where("tid >= 40")).collect())


def plain_resample(a, to_h, to_w):
    return np.array([[a[(2 * i + 1) * a.shape[0] // (2 * to_h), (2 * j + 1) * a.shape[1] // (2 * to_w)] for j in range(to_w)] for i in range(to_h)])


def plain_linear(a, to_h, to_w):
    for axis, n in ((0, to_h), (1, to_w)):
        w = a.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * (w / n) - 0.5, 0, w - 1)
        low = np.floor(at).astype(int)
        share = (at - low)[:, None] if axis == 0 else (at - low)[None, :]
        high = np.minimum(low + 1, w - 1)
        a = np.take(a, low, axis) * (1 - share) + np.take(a, high, axis) * share
    return a


@pytest.mark.parametrize("to_h,to_w", [(18, 15), (27, 22), (3, 4), (5, 31)])
def test_resampling_to_any_shape(spark, to_h, to_w):
    a = np.random.default_rng(6).integers(1, 99, (12, 14)).astype(float)
    p = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(12) for x in range(14)], "raster_id int, y int, x int, v double")
    sizes = spark.createDataFrame([(1, 14, 12, to_w, to_h)], "raster_id int, width int, height int, to_width int, to_height int")
    for linear, plain in ((False, plain_resample), (True, plain_linear)):
        out = np.zeros((to_h, to_w))
        rows = focal.resample(p, sizes, linear).collect()
        for r in rows:
            out[r.y, r.x] = r.v
        assert len(rows) == to_h * to_w and np.allclose(out, plain(a, to_h, to_w))


@pytest.mark.parametrize("kind,how", [
    ("u1", {"differences": True}), ("u2", {"order": ">"}), ("f4", {"tile": 16}), ("f8", {"strip_rows": 5, "deflate": False}), ("i2", {"tile": 16, "order": ">", "differences": True}),
])
@pytest.mark.parametrize("samples", [1, 3])
def test_tiff_files_are_read_as_written(spark, tmp_path, kind, how, samples):
    a = np.random.default_rng(5).integers(0, 120, (37, 41, samples)).astype(kind)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.tif").write_bytes(images.tiff_bytes(a, **how))
    rows = images.read_tiff(spark, str(tmp_path)).collect()
    assert len(rows) == a.size and all(a[r.y, r.x, r.band] == r.v for r in rows) and rows[0].path.endswith("a.tif")


def test_other_files_are_refused_and_partitions_follow_strips(spark, tmp_path):
    (tmp_path / "no.tif").write_bytes(b"not a raster at all")
    with pytest.raises(Exception, match="not a TIFF file"):
        images.read_tiff(spark, str(tmp_path / "no.tif")).collect()
    (tmp_path / "yes.tif").write_bytes(images.tiff_bytes(np.ones((64, 8)), strip_rows=8))
    assert len(images.TiffReader(str(tmp_path / "yes.tif"), 1).partitions()) == 8


def test_patch_images_come_back(spark, tmp_path):
    rows = [(s, c, i, x, y, (x * 9 + i) % 256, y * 7 % 256, (x + y) % 256) for s, c, i in ((1, "oak", 3), (2, "fir", 4)) for x in range(6) for y in range(6)]
    images.write_patch_images(spark.createDataFrame(rows, "site int, cls string, tid int, px int, py int, r int, g int, b int"), ["tid"], str(tmp_path / "out"))
    got = files.read_image_pixels(spark, f"{tmp_path}/out/site=*/cls=*").collect()
    assert {(r.path.split("site=")[1].split("/")[0], r.x, r.y, r.r, r.g, r.b) for r in got} == {(str(s), x, y, r, g, b) for s, _, _, x, y, r, g, b in rows}
