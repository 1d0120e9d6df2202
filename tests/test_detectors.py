"""Merge trees of bands and the two detectors against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rasters import plain_sweep

from groundgrid.operators import components, focal, tops, tree


def regions(cells):
    """8-connected sets of (y, x)."""
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            part.add((y, x))
            for c in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if c in left:
                    left.remove(c)
                    todo.append(c)
        out.append(part)
    return out


def raster(seed, size, share, top=40):
    rng = random.Random(seed)
    return {(y, x): float(rng.randrange(1, top)) for y in range(size) for x in range(size) if rng.random() < share}


def frame(spark, cells, rid=1):
    return spark.createDataFrame([(rid, y, x, v) for (y, x), v in cells.items()], "raster_id int, y int, x int, v double")


@pytest.mark.parametrize("seed,size,share,tile", [(1, 23, 0.8, 4), (2, 23, 0.55, 4), (3, 40, 0.5, 8), (4, 9, 1.0, 256)])
def test_band_components_equal_labelling_each_band(spark, seed, size, share, tile):
    cells = raster(seed, size, share, 12)
    p = frame(spark, cells).withColumns({"band": (F.lit(11) - F.col("v")).cast("int"), "marks": F.when(F.col("v") > 9, 1).otherwise(0)})
    got = [tuple(r) for r in tree.band_components(p, ["raster_id"], 11, tile).select("band", "comp_y", "comp_x", "area", "marks").collect()]
    want = {(b, *min(part), len(part), sum(cells[c] > 9 for c in part)) for b in range(11) for part in regions(c for c, v in cells.items() if v >= 11 - b)}
    assert len(got) == len(set(got)) and set(got) == want


def plain_tops(cells, step, eps, least, centroid=False):
    out = []
    for part in regions(cells):
        inside = [(y, x, cells[y, x]) for y, x in part]
        out += tops.sweep(inside, step, eps, least, True) if centroid else plain_sweep(inside, step, eps, least)
    return sorted(out)


@pytest.mark.parametrize("seed,tile,centroid", [(1, 4, False), (2, 5, False), (3, 4, True), (4, 256, True)])
def test_tops_across_tiles_equal_the_plain_sweep(spark, seed, tile, centroid):
    cells = raster(seed, 26, 0.62)
    p = frame(spark, cells)
    found = tops.find_tops(p, components.label_runs(p), tops.same_params(p, 3.0, 1.5, 3), centroid, tile)
    assert sorted((r.y, r.x, r.v) for r in found.collect()) == plain_tops(cells, 3.0, 1.5, 3, centroid)


def test_tops_of_nothing_and_of_flat_parts(spark):
    empty = frame(spark, {})
    assert tops.find_tops(empty, components.label_runs(empty), tops.same_params(empty, 3.0, 1.5, 3)).count() == 0
    flat = frame(spark, {(0, 0): 5.0, (0, 1): 5.0})
    assert tops.find_tops(flat, components.label_runs(flat), tops.same_params(flat, 1.0, 1.0, 0)).count() == 0


def plain_window(cells, width, height, low, k, iterations):
    """Components of one window: percentile cut, stretch to whole numbers, erosion, labelling."""
    v = np.array(list(cells.values()))
    p0, p1 = np.percentile(v, [100 * low, 99])
    image = np.zeros((height, width))
    for (y, x), h in cells.items():
        image[y, x] = max(0, np.floor((min(h, p1) - p0) * 255 / (p1 - p0)))
    for _ in range(iterations):
        padded = np.pad(image, k // 2, constant_values=np.inf)
        image = np.min([padded[dy : dy + height, dx : dx + width] for dy in range(k) for dx in range(k)], axis=0)
    return regions(zip(*(a.tolist() for a in np.nonzero(image))))


def plain_process(cells, width, height, low, k, iterations, step, eps, least, centroid=False):
    out = []
    for part in plain_window(cells, width, height, low, k, iterations):
        if len(part) > least:
            inside = [(y, x, cells[y, x]) for y, x in part]
            out += tops.sweep(inside, step, eps, least, True) if centroid else plain_sweep(inside, step, eps, least)
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_are_swept_on_their_own_heights(spark, seed):
    rng = random.Random(seed)
    cells = {(y, x): float(5 + (y * x) % 17 + rng.randrange(12) + 30 * ((y - 20) ** 2 + (x - 33) ** 2 < 90)) for y in range(50) for x in range(60)}
    p = frame(spark, cells)
    windowed = tops.keyed_by_window(p, 40, 32)
    found = tops.process_windows(windowed, tops.window_extent(40, 60, 50), 0.3, 3, 1, tops.same_params(windowed, 4.0, 2.0, 6))
    want = []
    for wy in range(0, 50, 32):
        for wx in range(0, 60, 32):
            inside = {(y - wy, x - wx): v for (y, x), v in cells.items() if wy <= y < wy + 40 and wx <= x < wx + 40}
            want += [(y + wy, x + wx) for y, x, _ in plain_process(inside, min(40, 60 - wx), min(40, 50 - wy), 0.3, 3, 1, 4.0, 2.0, 6)]
    assert sorted((r.y, r.x) for r in tops.to_global(found).collect()) == sorted(want) and want


def test_a_ramp_has_its_top_at_its_highest_pixel(spark):
    """The stretched window caps and erodes its maximum away, so only its own heights tell the place."""
    cells = {(y, x): 1.0 + y + x / 100 for y in range(60) for x in range(60)}
    windowed = tops.keyed_by_window(frame(spark, cells), 60, 60)
    found = tops.process_windows(windowed, tops.window_extent(60, 60, 60), 0.5, 3, 1, tops.same_params(windowed, 5.0, 5.0, 30)).collect()
    assert [(r.y, r.x, r.v) for r in found] == [t for t in plain_process(cells, 60, 60, 0.5, 3, 1, 5.0, 5.0, 30)] and found[0].v > 59


def plain_refine(cells, seeds, radius, cutoff):
    seeds = sorted({(y, x) for y, x in seeds if (y, x) in cells})
    if len(seeds) < 2:
        return []
    h = {s: cells[s] for s in seeds}
    hi, lo = max(h.values()), min(h.values())
    bands = {}
    for s in seeds:
        bands.setdefault(0 if hi == lo else min(int((hi - h[s]) / ((hi - lo) / 10)), 9), []).append(s)
    kept = set()
    for own in bands.values():
        top, low = max(h[s] for s in own), min(h[s] for s in own) - (2.25 if h[own[0]] < cutoff else 1.5)
        disks = {(y + dy, x + dx) for y, x in own for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius}
        kept |= {c for c in disks if c in cells and low <= cells[c] <= top}
    out = []
    for part in regions(kept):
        if part & set(seeds):
            y, x = min(part, key=lambda c: (-cells[c], c[1], c[0]))
            out.append((y, x, cells[y, x]))
    return sorted(out)


def hills(seed, n=70):
    rng = random.Random(seed)
    peaks = [(rng.randrange(n), rng.randrange(n), rng.randrange(15, 40)) for _ in range(9)]
    return {(y, x): round(max(1.0, max(h - 0.06 * ((y - py) ** 2 + (x - px) ** 2) for py, px, h in peaks)) + ((y * 7 + x * 3) % 5) / 8, 3) for y in range(n) for x in range(n)}


def test_refine_global_equals_plain(spark):
    cells = hills(4)
    rng = random.Random(9)
    seeds = [(rng.randrange(70), rng.randrange(70)) for _ in range(25)] + [(500, 500)]
    got = tops.refine_global(frame(spark, cells), spark.createDataFrame([(1, y, x) for y, x in seeds], "raster_id int, y int, x int"), 5, 10.0)
    assert sorted((r.y, r.x, r.v) for r in got.collect()) == plain_refine(cells, seeds, 5, 10.0)
    assert tops.refine_global(frame(spark, cells), spark.createDataFrame([(1, 3, 3)], "raster_id int, y int, x int"), 5, 10.0).count() == 0


def floored(cells):
    low = np.percentile(list(cells.values()), 1)
    return {c: v - low for c, v in cells.items() if v > low}


def test_detect_tops_boxes_equals_plain(spark):
    cells = hills(6)
    boxes = [(1, i, float(x), float(y), float(x + 12), float(y + 11)) for i, (y, x) in enumerate([(3, 4), (20, 31), (40, 8), (45, 44), (52, 20)])]
    got = tops.detect_tops_boxes(frame(spark, cells), spark.createDataFrame(boxes, "raster_id int, box_id int, x1 double, y1 double, x2 double, y2 double"), 70, 70, 50, radius=6)
    clean = floored(cells)
    seeds = [(int((y1 + y2) / 2), int((x1 + x2) / 2)) for _, _, x1, y1, x2, y2 in boxes]
    for wy in range(0, 70, 40):
        for wx in range(0, 70, 40):
            inside = {(y - wy, x - wx): v for (y, x), v in clean.items() if wy <= y < wy + 50 and wx <= x < wx + 50}
            stats = []
            for _, _, x1, y1, x2, y2 in boxes:
                if wx <= x1 and x2 < wx + 50 and wy <= y1 and y2 < wy + 50:
                    v = [h for (y, x), h in clean.items() if x1 <= x < x2 and y1 <= y < y2]
                    perc = np.percentile(v, 75)
                    stats.append((max(v), perc, sum(h >= perc for h in v)))
            if stats:
                least = min(s[2] for s in stats)
                step = max((np.mean([s[0] for s in stats]) - min(s[1] for s in stats)) / 150, 0.05)
                seeds += [(y + wy, x + wx) for y, x, _ in plain_process(inside, min(50, 70 - wx), min(50, 70 - wy), 0.25, 5, 1, step, max(least // 10, 5), max(least, 30), True)]
    assert sorted((r.y, r.x) for r in got.collect()) == [(y, x) for y, x, _ in plain_refine(clean, seeds, 6, 10.0)] and got.count() > 2


def test_detect_tops_equals_plain(spark):
    cells = hills(8)
    got = tops.detect_tops(frame(spark, cells), 70, 70, 50, gate=100, min_area=8, step=2.0, eps=3.0, radius=6).collect()
    inner = {(r.y, r.x): r.v for r in focal.erase_border(frame(spark, cells), 70, 70).collect()}
    clean, seeds = floored(inner), []
    for wy in range(0, 70, 40):
        for wx in range(0, 70, 40):
            inside = {(y - wy, x - wx): v for (y, x), v in clean.items() if wy <= y < wy + 50 and wx <= x < wx + 50}
            if len(inside) > 100:
                seeds += [(y + wy, x + wx) for y, x, _ in plain_process(inside, min(50, 70 - wx), min(50, 70 - wy), 0.5, 3, 1, 2.0, 3.0, 8)]
    assert sorted((r.y, r.x) for r in got) == [(y, x) for y, x, _ in plain_refine(clean, seeds, 6, 10.0)] and len(got) > 3
