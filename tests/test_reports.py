"""Sweeps with centroids, clusters by hand, numbering over partitions and image files."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from groundgrid.operators import clustering, dataset, tops
from groundgrid.operators.components import contracted
from groundgrid.sources import files


def test_sweep_by_centroids_finds_middles():
    cells = [(y, x, 30.0 - (y - 5) ** 2 - (x - 5) ** 2) for y in range(11) for x in range(11) if (y - 5) ** 2 + (x - 5) ** 2 < 25]
    assert tops.sweep(cells, 2.0, 2.0, 4, centroid=True) == [(5, 5, 30.0)] == tops.sweep(cells, 2.0, 2.0, 4)


def test_contracted_graphs_equal_a_search(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    got = {r.node: r.root for r in contracted(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(near) and all(got[a] == got[b] for a, b in edges if a != b)
    seen, parts = set(), 0
    for n in near:
        if n not in seen:
            parts, todo = parts + 1, [n]
            while todo:
                m = todo.pop()
                if m not in seen:
                    seen.add(m)
                    todo += near[m]
    assert len(set(got.values())) == parts and contracted(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_of_heights_far_apart(spark):
    rows = [(1, y, x, float(10 * (y % 3) + (x % 2) * 0.1)) for y in range(9) for x in range(8)]
    p = spark.createDataFrame(rows, "raster_id int, y int, x int, v double")
    for made in (clustering.fuzzy_cmeans(p, 3), clustering.meanshift_1d(p, 2.0), clustering.kmeans_pixels(p, 3)):
        groups = {(round(r.v / 10), r.label) for r in made.select("v", "label").collect()}
        assert len(groups) == 3 and len({g for g, _ in groups}) == 3 == len({c for _, c in groups})


def test_numbers_over_partitions(spark):
    rows = [(r, i * 7 % 50, i) for r in (1, 2) for i in range(50)]
    got = dataset.numbered(spark.createDataFrame(rows, "raster_id int, y int, tid int").repartition(7), ["y", "tid"], 1, 50).collect()
    assert sorted((r.raster_id, r.number) for r in got) == [(r, n) for r in (1, 2) for n in range(1, 51)] and all(r.number == r.y + 1 for r in got)


def test_image_files(spark, tmp_path):
    rgb = np.arange(2 * 3 * 3, dtype="uint8").reshape(2, 3, 3)
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    got = files.read_image_pixels(spark, str(tmp_path)).collect()
    assert {(r.y, r.x, r.r, r.g, r.b) for r in got} == {(y, x, *map(int, rgb[y, x])) for y in range(2) for x in range(3)}


def test_patch_files_by_name(spark, tmp_path):
    for name in ("SPsickfirPATCH12.jpg", "other.jpg"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.cls for r in files.list_patches(spark, str(tmp_path)).select(F.col("cls")).collect()] == ["sickfir"]
