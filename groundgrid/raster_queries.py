"""Queries of neighbourhoods, regions, tops, clusters, resampling and files; see queries.py for the form."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.geometry import round6
from .operators import clustering, components, dataset, focal, pixels, tops, tree
from .queries import KEY, ORACLES, RUNS, WIN, query
from .sources import files


def _n(t) -> int:
    return t("grid").first()["w"]


def weigh_sql(name: str, src: str, axis: str, out: dict[str, list[tuple[str, list[float]]]]) -> str:
    """One pass of weighted sums as a common table expression: mirrored copies joined with the taps."""
    terms = [(c, w) for parts in out.values() for c, w in parts]
    k = len(terms[0][1])
    r, other = k // 2, "y" if axis == "x" else "x"
    cols = ", ".join(dict.fromkeys(c for c, _ in terms))
    rows = ", ".join("(" + ", ".join([str(i - r), *[f"CAST({float(w[i])!r} AS DOUBLE)" for _, w in terms]]) + ")" for i in range(k))
    names = ", ".join(["d", *[f"k{i}" for i in range(len(terms))]])
    sums, i = [], 0
    for col, parts in out.items():
        sums.append("sum(" + " + ".join(f"k{i + j} * {c}" for j, (c, _) in enumerate(parts)) + f") AS {col}")
        i += len(parts)
    mirrored = f"""SELECT raster_id, {other}, {axis}, {cols} FROM {src} UNION ALL SELECT raster_id, {other}, -{axis}, {cols} FROM {src} WHERE {axis} BETWEEN 1 AND {r}
  UNION ALL SELECT raster_id, {other}, 2 * (w - 1) - {axis}, {cols} FROM {src} JOIN grid ON TRUE WHERE {axis} BETWEEN w - 1 - {r} AND w - 2"""
    return f"{name} AS (SELECT raster_id, {other}, {axis} - d AS {axis}, {', '.join(sums)} FROM ({mirrored}) m JOIN (VALUES {rows}) AS taps({names}) ON TRUE JOIN grid ON TRUE WHERE {axis} - d BETWEEN 0 AND w - 1 GROUP BY 1, 2, 3)"


def blur_sql(name: str, src: str, k: int, sigma: float) -> str:
    t = focal.taps(k, sigma)
    return weigh_sql(f"{name}_1", src, "x", {"v": [("v", t)]}) + ", " + weigh_sql(name, f"{name}_1", "y", {"v": [("v", t)]})


def sobel_sql(name: str, src: str, k: int, cutoff: float) -> str:
    slope, smooth = focal.SOBEL[k]
    one = weigh_sql(f"{name}_1", src, "x", {"gx": [("v", slope)], "s": [("v", smooth)]})
    return f"{one}, {weigh_sql(f'{name}_2', f'{name}_1', 'y', {'v': [('gx', smooth), ('s', slope)]})}, {name} AS (SELECT {KEY}, CAST(255 AS DOUBLE) AS v FROM {name}_2 WHERE v > {cutoff})"


def shape_sql(name: str, src: str, offsets: list[tuple[int, int]], how: str) -> str:
    """Minimum or maximum under a kernel, as a common table expression."""
    o = f"(VALUES {', '.join(map(str, offsets))}) AS o(ox, oy)"
    reach = f"SELECT raster_id, y + oy AS y, x + ox AS x, {how}(v) AS v, count(*) AS n FROM {src} JOIN {o} ON TRUE JOIN grid ON TRUE WHERE x + ox BETWEEN 0 AND w - 1 AND y + oy BETWEEN 0 AND w - 1 GROUP BY 1, 2, 3"
    if how == "max":
        return f"{name} AS (SELECT {KEY}, v FROM ({reach}))"
    inside = " + ".join(f"CASE WHEN x + {dx} BETWEEN 0 AND w - 1 AND y + {dy} BETWEEN 0 AND w - 1 THEN 1 ELSE 0 END" for dx, dy in offsets)
    return f"{name} AS (SELECT {KEY}, v FROM ({reach}) q JOIN grid ON TRUE WHERE n = {inside})"


def ellipse_sql(name: str, src: str, how: str) -> str:
    """Minimum or maximum under the ellipse of side 5 (three rows of five, and one pixel above and below), on the dense grid of the one raster."""
    best = "least" if how == "min" else "greatest"
    far = ", ".join(f"{how}(v) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 {side} AND 2 {side})" for side in ("PRECEDING", "FOLLOWING"))
    return f"""{name}_0 AS MATERIALIZED (SELECT g.y, g.x, coalesce(s.v, 0) AS v FROM (SELECT i // w AS y, i % w AS x FROM (SELECT w, unnest(range(w * w)) AS i FROM grid)) g LEFT JOIN {src} s ON s.y = g.y AND s.x = g.x),
{name}_1 AS (SELECT y, x, v, {how}(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM {name}_0),
{name} AS MATERIALIZED (SELECT 1 AS raster_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM (SELECT y, x, {best}({how}(m) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), {far}) AS v FROM {name}_1) WHERE v > 0)"""


def square(k: int) -> list[tuple[int, int]]:
    r = k // 2
    return [(dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]


# Neighbourhoods


@query("f2_erode_ellipse", f"WITH {ellipse_sql('low', 'canopy', 'min')} SELECT * FROM low")
def _(t):
    n = _n(t)
    return focal.erode_kernel(t("canopy"), focal.ellipse(5), n, n)


@query("f3_close_rect", f"WITH {shape_sql('high', 'canopy', square(3), 'max')}, {shape_sql('closed', 'high', square(3), 'min')} SELECT * FROM closed")
def _(t):
    n = _n(t)
    return pixels.close_rect(t("canopy"), 3, 1, n, n)


@query("f4_gaussian_blur", f"WITH {blur_sql('soft', 'canopy', 5, 5)} SELECT {KEY}, round(v, 6) AS v FROM soft")
def _(t):
    n = _n(t)
    return focal.gaussian_blur(t("canopy"), 5, 5, n, n).withColumn("v", round6(F.col("v")))


def _edge_sql(axis: str, src: str) -> str:
    other = "y, v" if axis == "x" else "x, v"
    return f"SELECT raster_id, {other}, unnest(CASE WHEN {axis} = 0 THEN range(-2, 1) WHEN {axis} = w - 1 THEN range(w - 1, w + 2) ELSE [CAST({axis} AS BIGINT)] END) AS {axis} FROM {src} JOIN grid ON TRUE"


@query("f5_median_blur", f"""WITH wide AS ({_edge_sql('x', 'canopy')}), pad AS ({_edge_sql('y', 'wide')}),
hit AS (SELECT raster_id, y + oy AS y, x + ox AS x, list_sort(list(v)) AS l FROM pad JOIN (VALUES {', '.join(map(str, square(5)))}) AS o(ox, oy) ON TRUE JOIN grid ON TRUE WHERE x + ox BETWEEN 0 AND w - 1 AND y + oy BETWEEN 0 AND w - 1 GROUP BY 1, 2, 3)
SELECT raster_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, l[len(l) - 12] AS v FROM hit WHERE len(l) >= 13""")
def _(t):
    n = _n(t)
    return focal.median_blur(t("canopy"), 5, n, n)


@query("f6_pyr_down", f"WITH {blur_sql('soft', 'canopy', 5, 0)} SELECT raster_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, v FROM soft WHERE x % 2 = 0 AND y % 2 = 0")
def _(t):
    n = _n(t)
    return focal.pyr_down(t("canopy"), n, n)


@query("f7_sobel_gradient", f"WITH {sobel_sql('edge', 'canopy', 3, 1)} SELECT * FROM edge")
def _(t):
    n = _n(t)
    return focal.sobel_gradient(t("canopy"), 3, 1, n, n)


CLOSED = ", ".join([sobel_sql("edge", "canopy", 5, 3), shape_sql("thin", "edge", square(5), "min"), shape_sql("fat", "thin", square(5), "max"), shape_sql("closed", "fat", square(5), "min")])


@query("f8_gradient_closed", f"WITH {CLOSED} SELECT * FROM closed")
def _(t):
    n = _n(t)
    return focal.gradient_closed(t("canopy"), 5, 1, n, n)


PEAKS = ", ".join([f"tall AS (SELECT {KEY}, v FROM canopy WHERE v > 10)", ellipse_sql("thin", "tall", "min"), blur_sql("soft", "thin", 5, 0), ellipse_sql("over", "soft", "max"), ellipse_sql("under", "soft", "min")])


@query("f9_local_maxima", f"WITH {PEAKS} SELECT s.raster_id, s.y, s.x, s.v FROM soft s JOIN over o ON o.raster_id = s.raster_id AND o.y = s.y AND o.x = s.x LEFT JOIN under u ON u.raster_id = s.raster_id AND u.y = s.y AND u.x = s.x WHERE s.v >= o.v AND s.v > coalesce(u.v, 0)")
def _(t):
    n = _n(t)
    return focal.local_maxima(t("canopy"), 5, 10, n, n)


#: Along rows first, then down the columns: the chamfer measure of what is dx = 0 to 5 and dy = 0 to 5 away.
@query("f10_erase_border", """WITH cells AS MATERIALIZED (SELECT g.y, g.x, c.v FROM (SELECT i // w AS y, i % w AS x FROM (SELECT w, unnest(range(w * w)) AS i FROM grid)) g LEFT JOIN canopy c ON c.y = g.y AND c.x = g.x),
row_ AS MATERIALIZED (SELECT y, x, v, least(x - max(CASE WHEN v IS NULL THEN x END) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), min(CASE WHEN v IS NULL THEN x END) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) - x) AS dx FROM cells),
near AS (SELECT DISTINCT y + dy AS y, x FROM (SELECT y, x, dx, unnest(range(-5, 6)) AS dy FROM row_ WHERE dx IS NOT NULL) WHERE 0.955::DOUBLE * abs(dx - abs(dy)) + 1.3693::DOUBLE * least(dx, abs(dy)) <= 5)
SELECT 1 AS raster_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM row_ ANTI JOIN near USING (y, x) WHERE v IS NOT NULL""")
def _(t):
    n = _n(t)
    return focal.erase_border(t("canopy"), n, n)


@query("f11_fill_holes", """WITH RECURSIVE fore AS (SELECT y, x FROM canopy WHERE v < 12), cells AS (SELECT y, x FROM (SELECT unnest(range(w)) AS y FROM grid) JOIN (SELECT unnest(range(w)) AS x FROM grid) ON TRUE EXCEPT SELECT y, x FROM fore),
back AS (SELECT y, min(x) AS x0, max(x) AS x1 FROM (SELECT y, x, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM cells) GROUP BY y, g),
out_ AS (SELECT y, x0, x1 FROM back JOIN grid ON TRUE WHERE x0 = 0 OR x1 = w - 1 OR y = 0 OR y = w - 1 UNION SELECT b.y, b.x0, b.x1 FROM out_ o JOIN back b ON abs(b.y - o.y) = 1 AND b.x0 <= o.x1 AND o.x0 <= b.x1)
SELECT 1 AS raster_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT y, x FROM fore UNION ALL SELECT y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT * FROM back EXCEPT SELECT * FROM out_))""")
def _(t):
    n = _n(t)
    return focal.fill_holes(t("canopy").where("v < 12"), n, n)


# Pixels by windows and composites


@query("p8_window_stretch", f"WITH {WIN}, q AS (SELECT raster_id, win_x, win_y, quantile_cont(v, 0.2) AS p0, quantile_cont(v, 0.99) AS p1 FROM win GROUP BY 1, 2, 3) SELECT * FROM (SELECT raster_id, win_x, win_y, y - win_y AS y, x - win_x AS x, CAST(floor((least(v, p1) - p0) * 255 / (p1 - p0)) AS DOUBLE) AS v FROM win JOIN q USING (raster_id, win_x, win_y) WHERE p1 > p0) WHERE v > 0")
def _(t):
    s = tops.window_stretch(tops.keyed_by_window(t("canopy"), 100, 80), 0.2)
    return s.select("raster_id.r", "raster_id.wx", "raster_id.wy", "y", "x", "v").toDF("raster_id", "win_x", "win_y", "y", "x", "v")


STEEP = ", ".join([blur_sql("soft", "canopy", 5, 0), sobel_sql("edge", "soft", 5, 50), shape_sql("thin", "edge", square(5), "min"), shape_sql("fat", "thin", square(5), "max"), shape_sql("closed", "fat", square(5), "min")])


@query("p14_height_quantise", f"WITH {STEEP} SELECT c.raster_id, c.y, c.x, CASE WHEN c.v < 5 THEN 0 ELSE CASE WHEN c.v > 25 THEN 2 ELSE 1 END + CASE WHEN e.v IS NOT NULL THEN 2 ELSE 0 END END AS label FROM canopy c LEFT JOIN closed e ON e.raster_id = c.raster_id AND e.y = c.y AND e.x = c.x")
def _(t):
    n = _n(t)
    return focal.height_quantise(t("canopy"), 5, 25, 5, 1, n, n)


GRAY = f"gray AS (SELECT {KEY}, r * CAST(0.299 AS DOUBLE) + g * CAST(0.587 AS DOUBLE) + b * CAST(0.114 AS DOUBLE) AS v FROM rgb)"


def _by_light(name: str, keep: str, f) -> None:
    sql = ", ".join([GRAY, blur_sql("soft", "gray", 5, 5), f"mask AS (SELECT {KEY}, CAST(255 AS DOUBLE) AS v FROM soft WHERE {keep})", shape_sql("thin", "mask", square(3), "min"), shape_sql("fat", "thin", square(3), "max"), shape_sql("closed", "fat", square(3), "min")])

    @query(name, f"WITH {sql} SELECT {KEY} FROM closed")
    def _(t):
        n = _n(t)
        return f(t("rgb"), n, n, size=3, iterations=1, close_size=3, close_iterations=1)


_by_light("p16_filter_shadows", "v <= 130.5", lambda *a, **how: focal.filter_shadows(*a, 130.5, **how))
_by_light("p17_filter_bright", "v > 150.5", lambda *a, **how: focal.filter_bright(*a, 150.5, **how))


def mask_sql(name: str, src: str, before: int, after: int, how: str) -> str:
    """Dilation or erosion of a set of pixels under a rectangle, as two common table expressions, one an axis."""
    parts = []
    for to, of, axis, other in ((f"{name}_1", src, "x", "y"), (name, f"{name}_1", "y", "x")):
        if how == "max":
            parts.append(f"{to} AS (SELECT DISTINCT raster_id, {other}, {axis} + o AS {axis} FROM {of} JOIN (SELECT unnest(range({-after}, {before + 1})) AS o) offs_ ON TRUE JOIN grid ON TRUE WHERE {axis} + o BETWEEN 0 AND w - 1)")
        else:
            count = f"count(*) OVER (PARTITION BY raster_id, {other} ORDER BY {axis} RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
            parts.append(f"{to} AS (SELECT {KEY} FROM (SELECT {KEY}, w, {count} AS n FROM {of} JOIN grid ON TRUE) WHERE n = least({after}, w - 1 - {axis}) + least({before}, {axis}) + 1)")
    return ", ".join(parts)


def light_sql(name: str, keep: str, times: int) -> str:
    """Dark or bright regions of the scene with the reference's sizes: erosion 5 x 5 three times, closing 10 x 10 `times` times."""
    closing = (5 * times, 4 * times)
    return ", ".join([f"{name}_m AS (SELECT {KEY} FROM soft WHERE {keep})", mask_sql(f"{name}_t", f"{name}_m", 6, 6, "min"), mask_sql(f"{name}_f", f"{name}_t", *closing, "max"), mask_sql(name, f"{name}_f", *closing, "min")])


SCENE = GRAY.replace("FROM rgb", "FROM scene") + ", " + blur_sql("soft", "gray", 5, 5)
DARK, LIGHT = light_sql("dark", "v <= 100.5", 3), light_sql("light", "v > 180.5", 7)


def _by_light_whole(name: str, region: str, f) -> None:
    @query(name, f"WITH {SCENE}, {DARK if region == 'dark' else LIGHT} SELECT CAST(raster_id AS INT) AS raster_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM {region}")
    def _(t):
        n = _n(t)
        return f(t("scene"), n, n)


_by_light_whole("p16_filter_shadows_whole", "dark", lambda *a: focal.filter_shadows(*a, 100.5))
_by_light_whole("p17_filter_bright_whole", "light", lambda *a: focal.filter_bright(*a, 180.5))


@query("w6_extend_floor", f"""WITH m AS (SELECT {KEY}, v, x // 100 AS wx, y // 100 AS wy FROM canopy), a AS (SELECT raster_id, wx, wy, coalesce(floor(avg(v) FILTER (v BETWEEN 1 AND 255 AND v < 6)), 0) AS f FROM m GROUP BY 1, 2, 3)
SELECT {KEY} FROM m JOIN a USING (raster_id, wx, wy) WHERE v < f + 5 OR v < 6""")
def _(t):
    return tops.extend_floor(t("canopy"), t("canopy").where("v < 6"), 100, 5)


# Regions


@query("c5_erase_small_regions", f"""WITH RECURSIVE {RUNS}, cells AS (SELECT raster_id, comp_y, comp_x, y, unnest(range(x0, x1 + 1)) AS x FROM labelled),
box AS (SELECT raster_id, comp_y, comp_x, min(x) AS l, min(y) AS t, least(max(x) - min(x), max(y) - min(y)) + 1 AS s, count(*) AS n FROM cells GROUP BY 1, 2, 3),
fat AS (SELECT raster_id, comp_y, comp_x, n, count(*) FILTER (x < l + s AND y < t + s) AS f FROM cells JOIN box USING (raster_id, comp_y, comp_x) GROUP BY 1, 2, 3, 4)
SELECT raster_id, comp_y, comp_x, n AS area, f AS fat FROM fat WHERE n >= 30 AND f >= 40""")
def _(t):
    return components.large_regions(components.label_runs(t("canopy").where("v >= 30")), 30, 40)


@query("c8_band_components", f"WITH RECURSIVE {RUNS.replace('v >= 30', 'v >= 40')} SELECT CAST(40 AS INT) AS th, raster_id, comp_y, comp_x, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area FROM labelled GROUP BY raster_id, comp_y, comp_x UNION ALL (WITH RECURSIVE {RUNS} SELECT CAST(30 AS INT), raster_id, comp_y, comp_x, CAST(sum(x1 - x0 + 1) AS BIGINT) FROM labelled GROUP BY raster_id, comp_y, comp_x)")
def _(t):
    ths = F.array(F.lit(40), F.lit(30))
    cells = t("canopy").select(*pixels.KEY, tree.entry_band(F.col("v"), ths).alias("band")).where("band < 2")
    return tree.band_components(cells, ["raster_id"], 2).select(F.element_at(ths, F.col("band") + 1).alias("th"), "raster_id", "comp_y", "comp_x", "area")


HIT = f"""{RUNS}, area AS (SELECT raster_id, comp_y, comp_x, CAST(sum(x1 - x0 + 1) AS BIGINT) AS area FROM labelled GROUP BY 1, 2, 3),
hit AS (SELECT p.raster_id, p.pid, l.comp_y, l.comp_x, a.area FROM preds p LEFT JOIN labelled l ON l.raster_id = p.raster_id AND l.y = p.y AND p.x BETWEEN l.x0 AND l.x1 LEFT JOIN area a ON a.raster_id = l.raster_id AND a.comp_y = l.comp_y AND a.comp_x = l.comp_x)"""


def _hit(t):
    labelled = components.written(components.label_runs(t("canopy").where("v >= 30")))
    area = components.stats(labelled).select("raster_id", "comp_y", "comp_x", "area")
    hit = components.looked_up(t("preds").select("raster_id", "pid", "y", "x"), labelled)
    return hit.join(area, ["raster_id", "comp_y", "comp_x"], "left")


@query("r2_lost_tops_region_pct", f"WITH RECURSIVE {HIT} SELECT raster_id, round(100.0 * count(*) FILTER (coalesce(area, 0) < 150) / count(*), 6) AS pct FROM hit GROUP BY raster_id")
def _(t):
    return _hit(t).groupBy("raster_id").agg(round6(100.0 * F.count_if(F.coalesce("area", F.lit(0)) < 150) / F.count("*")).alias("pct"))


@query("r3_top_region_sizes", f"WITH RECURSIVE {HIT} SELECT raster_id, coalesce(comp_y, -1) AS comp_y, coalesce(comp_x, -1) AS comp_x, count(*) AS n, coalesce(area, -1) AS area FROM hit GROUP BY raster_id, comp_y, comp_x, area")
def _(t):
    return _hit(t).groupBy("raster_id", F.coalesce("comp_y", F.lit(-1)).alias("comp_y"), F.coalesce("comp_x", F.lit(-1)).alias("comp_x"), F.coalesce("area", F.lit(-1)).alias("area")).agg(F.count("*").alias("n"))


# Tops


@query("t6_trim_canopy", f"""WITH b AS (SELECT raster_id, y, x, h, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((hi - h) / ((hi - lo) / 10)) AS INT), 9) END AS band FROM trees JOIN (SELECT raster_id, max(h) AS hi, min(h) AS lo FROM trees GROUP BY raster_id) USING (raster_id)),
ends AS (SELECT raster_id, band, max(h) AS top, min(h) - CASE WHEN arg_min(h, struct_pack(y := y, x := x)) < 20 THEN 2.25 ELSE 1.5 END AS low FROM b GROUP BY 1, 2),
near AS MATERIALIZED (SELECT DISTINCT raster_id, band, y + dy AS y, x + dx AS x FROM b JOIN offs ON d2 <= 100)
SELECT DISTINCT c.raster_id, c.y, c.x, c.v FROM near n JOIN canopy c ON c.raster_id = n.raster_id AND c.y = n.y AND c.x = n.x JOIN ends e ON e.raster_id = n.raster_id AND e.band = n.band WHERE c.v BETWEEN e.low AND e.top""")
def _(t):
    return tops.trim_canopy(t("canopy"), t("trees"), 10, 20)


@query("t10_box_stats", """WITH i AS (SELECT b.raster_id, box_id, x1, y1, x2, y2, v FROM boxes b JOIN canopy c ON c.raster_id = b.raster_id AND c.x >= x1 AND c.x < x2 AND c.y >= y1 AND c.y < y2),
q AS (SELECT raster_id, box_id, max(v) AS top, quantile_cont(v, 0.75) AS perc FROM i GROUP BY 1, 2)
SELECT raster_id, box_id, top, round(perc, 6) AS perc, count(*) FILTER (v >= perc) AS n, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM i JOIN q USING (raster_id, box_id) GROUP BY raster_id, box_id, top, perc, x1, y1, x2, y2""")
def _(t):
    return tops.box_stats(t("canopy"), t("boxes")).withColumn("perc", round6(F.col("perc")))


@query("t11_window_params", """WITH i AS (SELECT b.raster_id, box_id, x1, y1, v FROM boxes b JOIN canopy c ON c.raster_id = b.raster_id AND c.x >= x1 AND c.x < x2 AND c.y >= y1 AND c.y < y2),
q AS (SELECT raster_id, box_id, max(v) AS top, quantile_cont(v, 0.75) AS perc FROM i GROUP BY 1, 2), s AS (SELECT raster_id, box_id, x1, y1, top, perc, count(*) FILTER (v >= perc) AS n FROM i JOIN q USING (raster_id, box_id) GROUP BY ALL)
SELECT raster_id, CAST(floor(x1 / 100) AS BIGINT) AS win_x, CAST(floor(y1 / 100) AS BIGINT) AS win_y, round(greatest((avg(top) - min(perc)) / 150, 0.05), 6) AS step, CAST(greatest(floor(min(n) / 10), 5) AS BIGINT) AS radius, greatest(min(n), 30) AS min_pix FROM s GROUP BY 1, 2, 3""")
def _(t):
    at = t("boxes").select("raster_id", "box_id", F.floor(F.col("x1") / 100).alias("win_x"), F.floor(F.col("y1") / 100).alias("win_y"))
    s = tops.box_stats(t("canopy"), t("boxes")).join(at, ["raster_id", "box_id"])
    return tops.window_params(s, ("raster_id", "win_x", "win_y")).withColumn("step", round6(F.col("step")))


def _rows(name: str, f) -> None:
    """A query that SQL can't express."""
    query(name, "SELECT 1")(f)
    del ORACLES[name]


_rows("t9_detect_tops", lambda t: tops.detect_tops(t("canopy"), _n(t), _n(t), size=200, gate=400))
_rows("k1_kmeans_pixels", lambda t: clustering.kmeans_pixels(t("canopy"), 4))
_rows("k2_gmm_pixels", lambda t: clustering.gmm_pixels(t("canopy"), 3))


# Clusters


DENSE = """h AS (SELECT raster_id, v, count(*) AS n FROM canopy GROUP BY 1, 2),
core AS (SELECT a.raster_id, a.v FROM h a JOIN h b ON b.raster_id = a.raster_id AND abs(a.v - b.v) <= 0.25 GROUP BY a.raster_id, a.v HAVING sum(b.n) >= 40),
c AS (SELECT raster_id, v, sum(new) OVER (PARTITION BY raster_id ORDER BY v) AS label FROM (SELECT raster_id, v, CASE WHEN v - lag(v) OVER (PARTITION BY raster_id ORDER BY v) <= 0.25 THEN 0 ELSE 1 END AS new FROM core) q),
named AS (SELECT h.raster_id, h.v, h.n, CAST(coalesce(arg_min(c.label, struct_pack(d := abs(h.v - c.v), v := c.v)) , 0) AS BIGINT) AS label FROM h LEFT JOIN c ON c.raster_id = h.raster_id AND abs(h.v - c.v) <= 0.25 GROUP BY h.raster_id, h.v, h.n)"""


@query("k4_dbscan_1d", f"WITH {DENSE} SELECT * FROM named")
def _(t):
    return clustering.dbscan_1d(t("canopy"), 0.25, 40)


def _median_sql(name: str, src: str) -> str:
    return f"""{name}_w AS ({_edge_sql('x', src)}), {name}_p AS ({_edge_sql('y', f'{name}_w')}),
{name}_h AS (SELECT raster_id, y + oy AS y, x + ox AS x, list_sort(list(v)) AS l FROM {name}_p JOIN (VALUES {', '.join(map(str, square(5)))}) AS o(ox, oy) ON TRUE JOIN grid ON TRUE WHERE x + ox BETWEEN 0 AND w - 1 AND y + oy BETWEEN 0 AND w - 1 GROUP BY 1, 2, 3),
{name} AS MATERIALIZED (SELECT raster_id, y, x, l[len(l) - 12] AS v FROM {name}_h WHERE len(l) >= 13)"""


def _half_sql(name: str, src: str, level: int) -> str:
    """One halving of a raster whose side is w / 2^level."""
    side = f"(SELECT w // {2**level} AS w FROM grid) g"
    blurred = blur_sql(f"{name}_s", src, 5, 0).replace("JOIN grid ON TRUE", f"JOIN {side} ON TRUE")
    return f"{blurred}, {name} AS MATERIALIZED (SELECT raster_id, y // 2 AS y, x // 2 AS x, v FROM {name}_s WHERE x % 2 = 0 AND y % 2 = 0)"


REDUCED = ", ".join([_median_sql("small0", "canopy"), *[_half_sql(f"small{i + 1}", f"small{i}", i) for i in range(4)], DENSE.replace("FROM canopy", "FROM small4").replace("<= 0.25", "<= 0.5").replace(">= 40", ">= 10"),
    "spread AS (SELECT c.raster_id, c.y, c.x, c.v, coalesce(m.label, 0) AS label FROM canopy c LEFT JOIN small4 s ON s.raster_id = c.raster_id AND s.y = c.y // 16 AND s.x = c.x // 16 LEFT JOIN named m ON m.raster_id = s.raster_id AND m.v = s.v)"])


def _reduced(t):
    n = _n(t)
    return clustering.dbscan_reduced(t("canopy").select(*pixels.KEY, "v"), 0.5, 10, n, n)


@query("k4_dbscan_reduced", f"WITH {REDUCED} SELECT {KEY}, label FROM spread")
def _(t):
    return _reduced(t).select(*pixels.KEY, "label")


@query("k6_cluster_argmax", f"WITH {REDUCED} SELECT raster_id, label, v, y, x FROM (SELECT raster_id, label, v, y, x, row_number() OVER (PARTITION BY raster_id, label ORDER BY v DESC, y, x) AS rn FROM spread WHERE label > 0) q WHERE rn = 1")
def _(t):
    n = _n(t)
    return clustering.reduced_argmax(t("canopy").select(*pixels.KEY, "v"), 0.5, 10, n, n)


# Resampling and patches


@query("g1_resample_nearest", "SELECT raster_id, CAST(y // 3 AS INT) AS y, CAST(x // 3 AS INT) AS x, v FROM canopy WHERE x % 3 = 1 AND y % 3 = 1")
def _(t):
    return focal.resample_nearest(t("canopy"), 3)


def _sizes(t, *shapes):
    """The derived raster's shape as (width, height) expressions in w, and another one."""
    return t("grid").select(F.lit(1).alias("raster_id"), *[F.expr(e).cast("int").alias(c) for e, c in zip(shapes, ("width", "height", "to_width", "to_height"))])


UP, DOWN = ("CAST(floor(w * 1.5) AS INT)", "CAST(floor(w * 1.25) AS INT)"), ("CAST(floor(w / 3.5) AS INT)", "CAST(floor(w / 2.25) AS INT)")


def _nearest_sql(to) -> str:
    places = lambda side, axis: f"(SELECT i AS t{axis}, ((2 * i + 1) * w) // (2 * n) AS s{axis} FROM (SELECT w, {side} AS n, unnest(range({side})) AS i FROM grid))"
    return f"SELECT raster_id, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, v FROM canopy c JOIN {places(to[0], 'x')} px ON px.sx = c.x JOIN {places(to[1], 'y')} py ON py.sy = c.y"


@query("g1_resample_shape", f"SELECT 'up' AS kind, * FROM ({_nearest_sql(UP)}) UNION ALL SELECT 'down', * FROM ({_nearest_sql(DOWN)})")
def _(t):
    up, down = (focal.resample(t("canopy").select(*pixels.KEY, "v"), _sizes(t, "w", "w", *to)).select(F.lit(kind).alias("kind"), *pixels.KEY, "v") for kind, to in (("up", UP), ("down", DOWN)))
    return up.union(down)


@query("p10_mask_out_resized", "WITH small AS (SELECT DISTINCT raster_id, y // 2 AS y, x // 2 AS x FROM layers) SELECT c.raster_id, c.y, c.x, c.v FROM canopy c ANTI JOIN small s ON s.raster_id = c.raster_id AND s.y = c.y // 2 AND s.x = c.x // 2")
def _(t):
    small = t("layers").select("raster_id", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).distinct()
    return focal.mask_out(t("canopy"), small, _sizes(t, "floor(w / 2)", "floor(w / 2)", "w", "w"))


@query("g2_resample_boxes", "SELECT raster_id, box_id, x1 / 2 AS x1, y1 / 4 AS y1, x2 / 2 AS x2, y2 / 4 AS y2 FROM boxes")
def _(t):
    return t("boxes").select("raster_id", "box_id", *[(F.col(c) / (2 if c[0] == "x" else 4)).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("g4_resample_labels", "SELECT raster_id, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, min(label) AS label FROM crowns GROUP BY 1, y // 2, x // 2 HAVING count(*) = 4 AND min(label) = max(label)")
def _(t):
    return focal.resample_labels(t("crowns"), 2)


PATCH = "patch AS (SELECT b.raster_id, b.tid, c.x - b.x0 AS px, c.y - b.y0 AS py, c.r AS v FROM (SELECT raster_id, tid, x - 10 AS x0, y - 10 AS y0 FROM trees JOIN grid ON TRUE WHERE x >= 10 AND y >= 10 AND x + 10 <= w AND y + 10 <= w) b JOIN rgb c ON c.raster_id = b.raster_id AND c.x >= x0 AND c.x < x0 + 20 AND c.y >= y0 AND c.y < y0 + 20)"


def _patch(t):
    n = F.lit(_n(t))
    return dataset.crop(t("rgb").withColumn("v", F.col("r")), dataset.patch_boxes(t("trees"), 20, n, n), "tid", 20)


def _mirror(c: str) -> str:
    return f"CASE WHEN {c} > 19 THEN 38 - {c} ELSE abs({c}) END"


_TAPS = focal.taps(3, 0.5)
SOFT = f"""SELECT raster_id, tid, px, py, round(v, 6) AS v, 2 FROM (SELECT raster_id, tid, CAST(tx AS INT) AS px, CAST(ty AS INT) AS py, sum(v * wx * wy) AS v FROM patch
  JOIN (SELECT unnest(range(20)) AS tx) a ON TRUE JOIN (VALUES (-1, {_TAPS[0]!r}::DOUBLE), (0, {_TAPS[1]!r}::DOUBLE), (1, {_TAPS[2]!r}::DOUBLE)) AS kx(dx, wx) ON {_mirror('(tx + dx)')} = px
  JOIN (SELECT unnest(range(20)) AS ty) b ON TRUE JOIN (VALUES (-1, {_TAPS[0]!r}::DOUBLE), (0, {_TAPS[1]!r}::DOUBLE), (1, {_TAPS[2]!r}::DOUBLE)) AS ky(dy, wy) ON {_mirror('(ty + dy)')} = py GROUP BY 1, 2, 3, 4)"""
TURNED = """SELECT p.raster_id, p.tid, CAST(tx AS INT), CAST(ty AS INT), CAST(v AS DOUBLE), 3 FROM patch p JOIN (SELECT tx, ty, floor((tx - 9.5::DOUBLE) * cos(radians(30)) + (ty - 9.5::DOUBLE) * sin(radians(30)) + 10) AS sx, floor((ty - 9.5::DOUBLE) * cos(radians(30)) - (tx - 9.5::DOUBLE) * sin(radians(30)) + 10) AS sy
  FROM (SELECT unnest(range(20)) AS tx) a JOIN (SELECT unnest(range(20)) AS ty) b ON TRUE) s ON s.sx = p.px AND s.sy = p.py"""


@query("d4_augment_patch", f"WITH {PATCH} SELECT raster_id, tid, 19 - py AS px, px AS py, CAST(v AS DOUBLE) AS v, 0 AS code FROM patch UNION ALL SELECT raster_id, tid, px, 19 - py, CAST(v AS DOUBLE), 1 FROM patch UNION ALL SELECT raster_id, tid, px, py, 128 + 1.25 * (v - 128), 5 FROM patch UNION ALL {SOFT} UNION ALL {TURNED}")
def _(t):
    n = F.lit(_n(t))
    p = t("rgb").select(*pixels.KEY, F.col("r").alias("v"))
    return dataset.augmented(p, dataset.patch_boxes(t("trees"), 20, n, n), "tid", 20, 30).withColumn("v", round6(F.col("v")))


@query("d8_health_category", f"WITH {PATCH}, s AS (SELECT raster_id, tid, round(100.0 * count(*) FILTER (v > 170) / 400, 2) AS pct FROM patch GROUP BY 1, 2) SELECT raster_id, tid, pct, CASE WHEN pct < 50 THEN 'H' WHEN pct < 60 THEN 'C' WHEN pct < 70 THEN 'S' WHEN pct < 80 THEN 'RD' ELSE 'D' END AS category FROM s")
def _(t):
    s = _patch(t).groupBy("raster_id", "tid").agg(F.round(100.0 * F.count_if(F.col("v") > 170) / 400, 2).alias("pct"))
    return s.withColumn("category", dataset.health_category(F.col("pct")))


# Files


@query("s2_tiles", "SELECT raster_id, CAST(y // 64 AS INT) AS ty, CAST(x // 64 AS INT) AS tx, count(*) AS n, sum(v) AS total FROM canopy GROUP BY 1, 2, 3")
def _(t):
    p = files.tiles_to_pixels(files.pixels_to_tiles(t("canopy"), 64))
    return p.groupBy("raster_id", F.floor(F.col("y") / 64).cast("int").alias("ty"), F.floor(F.col("x") / 64).cast("int").alias("tx")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("s9_patch_class", "SELECT path, regexp_extract(path, '/SP([^/]+)PATCH\\S*\\d+.jpg$', 1) AS cls FROM (SELECT '/p/SP' || cls || 'PATCH' || tid || '.jpg' AS path FROM trees)")
def _(t):
    return files.patch_class(t("trees").select(F.concat(F.lit("/p/SP"), "cls", F.lit("PATCH"), F.col("tid").cast("string"), F.lit(".jpg")).alias("path")))


@query("s10_point_heights", "SELECT p.raster_id, p.pid, p.x, p.y, coalesce(c.v, 0) AS height FROM preds p LEFT JOIN canopy c ON c.raster_id = p.raster_id AND c.y = p.y AND c.x = p.x")
def _(t):
    return files.point_heights(t("preds"), t("canopy")).select("raster_id", "pid", "x", "y", "height")


@query("s13_metric_rows", "SELECT metric, exp, config, " + ", ".join(f"max(value) FILTER (mosaic = {i}) AS m{i}" for i in range(1, 10)) + " FROM (SELECT exp, config, mosaic, match, euc FROM metrics) UNPIVOT (value FOR metric IN (match, euc)) GROUP BY 1, 2, 3")
def _(t):
    return files.metric_rows(t("metrics").select("exp", "config", "mosaic", "match", "euc"), ["match", "euc"], list(range(1, 10)))
