"""Queries of reports, detectors, resampling, patch classes, and of the sources and sinks; see queries.py for the form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.geometry import round6
from .operators import classify, clustering, components, dataset, focal, pixels, reports, tops
from .queries import ANN, KEY, QUERIES, R5, RUNS, query, table
from .raster_queries import DARK, LIGHT, SCENE, _n, _patch, _rows, blur_sql, ellipse_sql
from .sources import files, images

# Reports

DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
SOFT = blur_sql("soft", "canopy", 5, 0) + f", cut AS (SELECT raster_id, unnest(range(9)) AS band, round(unnest(quantile_cont(round(v, 6), {DECILES})), 6) AS th FROM soft GROUP BY raster_id)"


def _ths(t) -> DataFrame:
    n = _n(t)
    return components.written(reports.decile_thresholds(focal.gaussian_blur(t("canopy"), 5, 0, n, n).withColumn("v", round6(F.col("v")))))


@query("r6_decile_report", f"WITH {SOFT}, ths AS (SELECT DISTINCT th FROM cut) {R5}")
def _(t):
    out = reports.threshold_stats(t("canopy"), t("trees").select(*pixels.KEY), _ths(t))
    return out.withColumns({c: round6(F.col(c)) for c in ("tops_pct", "pixels_pct")})


@query("r4_region_report", f"""WITH RECURSIVE {SOFT}, banded AS (SELECT CAST(c.raster_id * 10 + band AS INT) AS raster_id, y, x, v FROM canopy c JOIN cut ON cut.raster_id = c.raster_id WHERE v >= th), {RUNS.replace('FROM canopy WHERE v >= 30', 'FROM banded')},
area AS (SELECT raster_id, comp_y, comp_x, sum(x1 - x0 + 1) AS area FROM labelled GROUP BY 1, 2, 3), hit AS (SELECT l.raster_id AS rb, l.comp_y, l.comp_x, count(*) AS n FROM trees t JOIN labelled l ON l.raster_id // 10 = t.raster_id AND l.y = t.y AND t.x BETWEEN l.x0 AND l.x1 GROUP BY 1, 2, 3),
per AS (SELECT rb, sum(n) AS on_, sum(area) AS area, count(*) AS n_regions FROM hit JOIN area a ON a.raster_id = rb AND a.comp_y = hit.comp_y AND a.comp_x = hit.comp_x GROUP BY rb), total AS (SELECT raster_id, count(*) AS n_tops FROM trees GROUP BY 1)
SELECT c.raster_id, CAST(c.band AS INT) AS band, th, n_tops, round(100.0 * coalesce(on_, 0) / n_tops, 6) AS on_pct, round(coalesce(on_ / n_regions, 0), 6) AS mean_tops, round(coalesce(per.area / n_regions, 0), 6) AS mean_area, coalesce(n_regions, 0) AS n_regions
FROM cut c JOIN total ON total.raster_id = c.raster_id LEFT JOIN per ON per.rb = c.raster_id * 10 + c.band""")
def _(t):
    out = reports.region_report(t("canopy"), t("trees"), _ths(t))
    return out.withColumns({c: round6(F.col(c)) for c in ("on_pct", "mean_tops", "mean_area")})


OFFSET = """box AS (SELECT raster_id, label, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, avg(x) AS cx, avg(y) AS cy FROM crowns GROUP BY 1, 2),
best AS (SELECT b.raster_id, label, cx, cy, arg_max(struct_pack(v := v, y := c.y, x := c.x), struct_pack(v := v, y := -c.y, x := -c.x)) AS t FROM box b JOIN canopy c ON c.raster_id = b.raster_id AND c.x BETWEEN x1 AND x2 AND c.y BETWEEN y1 AND y2 GROUP BY 1, 2, 3, 4),
moved AS (SELECT b.raster_id, label, t.x AS x, t.y AS y, t.v - coalesce(c.v, 0) AS dif, sqrt((t.x - cx) * (t.x - cx) + (t.y - cy) * (t.y - cy)) AS dist FROM best b LEFT JOIN canopy c ON c.raster_id = b.raster_id AND c.x = floor(cx) AND c.y = floor(cy))"""


@query("r8_annotation_offset", f"WITH {OFFSET} SELECT raster_id, label, x, y, round(dif, 6) AS dif, round(dist, 6) AS dist FROM moved")
def _(t):
    return reports.annotation_offset(t("canopy"), t("crowns")).withColumns({c: round6(F.col(c)) for c in ("dif", "dist")})


@query("r8_mean_offset", f"WITH {OFFSET} SELECT raster_id, count(*) AS n, round(avg(dif), 6) AS mean_dif, round(avg(dist), 6) AS mean_dist FROM moved GROUP BY raster_id")
def _(t):
    return reports.annotation_offset(t("canopy"), t("crowns")).groupBy("raster_id").agg(F.count("*").alias("n"), round6(F.avg("dif")).alias("mean_dif"), round6(F.avg("dist")).alias("mean_dist"))


#: Windows of 100, percentile 0.2, erosion 3 x 3 once.
CLEAN = """cw AS (SELECT raster_id, x // 100 AS wx, y // 100 AS wy, y, x, v FROM canopy), cn AS (SELECT raster_id, wx, wy, quantile_cont(v, 0.2) AS p0, quantile_cont(v, 0.99) AS p1 FROM cw GROUP BY 1, 2, 3 HAVING count(*) > 50),
cs AS (SELECT raster_id, wx, wy, y, x, (least(v, p1) - p0) * (255::DOUBLE / (p1 - p0)) AS v FROM cw JOIN cn USING (raster_id, wx, wy) WHERE p1 > p0 AND v > p0),
c1 AS (SELECT *, min(v) OVER f AS m, count(*) OVER f AS n FROM cs WINDOW f AS (PARTITION BY raster_id, wx, wy, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
c2 AS (SELECT raster_id, wx, wy, y, x, m AS v FROM c1 JOIN grid ON TRUE WHERE n = least(1, least(100, w - wx * 100) - 1 - (x - wx * 100)) + least(1, x - wx * 100) + 1),
c3 AS (SELECT *, min(v) OVER f AS m, count(*) OVER f AS n FROM c2 WINDOW f AS (PARTITION BY raster_id, wx, wy, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
clean AS (SELECT raster_id, y, x, m AS v FROM c3 JOIN grid ON TRUE WHERE n = least(1, least(100, w - wy * 100) - 1 - (y - wy * 100)) + least(1, y - wy * 100) + 1 UNION ALL SELECT raster_id, y, x, v FROM cw ANTI JOIN cn USING (raster_id, wx, wy))"""


@query("w5_window_clean", f"WITH {CLEAN} SELECT {KEY}, round(v, 6) AS v FROM clean")
def _(t):
    n = _n(t)
    return tops.window_clean(t("canopy"), 100, 0.2, 3, 1, n, n).withColumn("v", round6(F.col("v")))


@query("r9_windowed_clean_lost_tops", f"""WITH RECURSIVE {CLEAN}, bright AS (SELECT raster_id, y, x, v FROM clean JOIN (SELECT raster_id AS r, max(v) AS top FROM clean GROUP BY raster_id) ON raster_id = r WHERE floor(v * 255 / top) > 100), {RUNS.replace('FROM canopy WHERE v >= 30', 'FROM bright')},
area AS (SELECT raster_id, comp_y, comp_x, sum(x1 - x0 + 1) AS area FROM labelled GROUP BY 1, 2, 3)
SELECT t.raster_id, round(100.0 * count(*) FILTER (coalesce(area, 0) < 10) / count(*), 6) AS pct FROM trees t LEFT JOIN labelled l ON l.raster_id = t.raster_id AND l.y = t.y AND t.x BETWEEN l.x0 AND l.x1 LEFT JOIN area a ON a.raster_id = l.raster_id AND a.comp_y = l.comp_y AND a.comp_x = l.comp_x GROUP BY t.raster_id""")
def _(t):
    n = _n(t)
    return reports.windowed_clean_lost_tops(t("canopy"), t("trees"), 100, 0.2, 3, 1, n, n).withColumn("pct", round6(F.col("pct")))


def _extended(rounds: int, size: int, margin: float) -> str:
    parts = []
    for i in range(rounds):
        w = int(size * (1, 1.5, 2)[i % 3])
        parts.append(f"""m{i} AS (SELECT c.raster_id, c.y, c.x, c.v, c.x // {w} AS wx, c.y // {w} AS wy, f.y IS NOT NULL AS marked FROM canopy c LEFT JOIN floor{i} f ON f.raster_id = c.raster_id AND f.y = c.y AND f.x = c.x),
a{i} AS (SELECT raster_id, wx, wy, coalesce(floor(avg(v) FILTER (marked AND v BETWEEN 1 AND 255)), 0) AS f FROM m{i} GROUP BY 1, 2, 3),
floor{i + 1} AS MATERIALIZED (SELECT {KEY} FROM m{i} JOIN a{i} USING (raster_id, wx, wy) WHERE v < f + {margin} UNION SELECT {KEY} FROM floor{i})""")
    return ", ".join(parts)


@query("p18_floor_mask", f"WITH {SCENE}, {DARK}, {LIGHT}, floor0 AS MATERIALIZED (SELECT {KEY} FROM canopy WHERE v < 4 UNION SELECT {KEY} FROM dark UNION SELECT {KEY} FROM light), {_extended(5, 60, 2)} SELECT CAST(raster_id AS INT) AS raster_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM floor5")
def _(t):
    return tops.floor_mask(t("canopy"), t("scene"), 4, 100.5, 180.5, 2, 60, _n(t), _n(t))


# Tops


@query("t4_flatten_tops", "SELECT raster_id, h, x, y FROM trees")
def _(t):
    lists = t("trees").groupBy("raster_id", "mosaic", "cls").agg(F.collect_list(F.struct("h", "x", "y")).alias("l")).groupBy("raster_id", "mosaic").agg(F.map_from_entries(F.collect_list(F.struct("cls", "l"))).alias("tops"))
    return tops.flatten_tops(lists).drop("mosaic")


def _windowed(t):
    n = _n(t)
    return tops.keyed_by_window(t("canopy"), 200, 160), tops.window_extent(200, n, n)


def _found(t, centroid: bool) -> DataFrame:
    p = t("canopy")
    return tops.find_tops(p, components.label_runs(p), tops.same_params(p, 5.0, 5.0, 30), centroid)


_rows("t1_find_tops", lambda t: _found(t, False))
_rows("t2_find_tops_centroid", lambda t: _found(t, True))


def _processed(t) -> DataFrame:
    windowed, extent = _windowed(t)
    return tops.to_global(tops.process_windows(windowed, extent, 0.5, 3, 1, tops.same_params(windowed, 5.0, 5.0, 30)))


_rows("t5_process_windows", _processed)
_rows("t7_refine_global", lambda t: tops.refine_global(t("canopy"), t("trees"), 10, 20))
_rows("t12_detect_tops_boxes", lambda t: tops.detect_tops_boxes(t("canopy"), t("boxes"), _n(t), _n(t), size=200))


PEAKS2 = ", ".join([
    f"tall AS (SELECT {KEY}, v FROM canopy WHERE v > 10)", ellipse_sql("thin", "tall", "min"), blur_sql("soft", "thin", 5, 0), ellipse_sql("over1", "soft", "max"), ellipse_sql("over", "over1", "max"),
    ellipse_sql("under1", "soft", "min"), ellipse_sql("under", "under1", "min"),
    "peaks AS (SELECT s.raster_id, s.y, s.x FROM soft s JOIN over o ON o.raster_id = s.raster_id AND o.y = s.y AND o.x = s.x LEFT JOIN under u ON u.raster_id = s.raster_id AND u.y = s.y AND u.x = s.x WHERE s.v >= o.v AND s.v > coalesce(u.v, 0))",
])
PEAK_RUNS = RUNS.replace("high AS (SELECT raster_id, y, x, v FROM canopy WHERE v >= 30)", "high AS (SELECT raster_id, y, x FROM peaks)").replace("a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1", "a.x0 <= b.x1 AND b.x0 <= a.x1")


@query("t13_detect_local_max", f"""WITH RECURSIVE {PEAKS2}, {PEAK_RUNS}, mid AS (SELECT raster_id, comp_y, comp_x, CAST(floor(sum((x1 - x0 + 1) * (x0 + x1) / 2) / sum(x1 - x0 + 1)) AS INT) AS x, CAST(floor(sum((x1 - x0 + 1) * y) / sum(x1 - x0 + 1)) AS INT) AS y FROM labelled GROUP BY 1, 2, 3)
SELECT m.raster_id, m.x, m.y, coalesce(c.v, 0) AS height FROM mid m LEFT JOIN canopy c ON c.raster_id = m.raster_id AND c.y = m.y AND c.x = m.x""")
def _(t):
    return focal.detect_local_max(t("canopy"), 5, 10, _n(t), _n(t))


# Clusters, resampling, patches

_rows("k3_fuzzy_cmeans", lambda t: clustering.cluster_argmax(clustering.fuzzy_cmeans(t("canopy"), 4).withColumn("label", F.col("label") + 1)))
_rows("k5_meanshift", lambda t: clustering.cluster_argmax(clustering.meanshift_1d(t("canopy"), 6.0).withColumn("label", F.col("label") + 1)))


def linear_sql(factor: float) -> str:
    """Both passes of linear resampling: every place takes its two neighbours on each axis."""
    parts = []
    for name, src, axis, other in (("lx", "canopy", "x", "y"), ("ly", "lx", "y", "x")):
        places = f"(SELECT CAST(unnest(range(CAST(floor(w / {factor}::DOUBLE) AS BIGINT))) AS INT) AS d, w FROM grid)"
        at = f"least(greatest((d + 0.5::DOUBLE) * {factor}::DOUBLE - 0.5::DOUBLE, 0::DOUBLE), (w - 1)::DOUBLE)"
        near = f"(SELECT d, i, 1::DOUBLE - abs(pos - i) AS share FROM (SELECT d, pos, CAST(unnest([floor(pos), floor(pos) + 1]) AS INT) AS i FROM (SELECT d, {at} AS pos FROM {places})) WHERE 1::DOUBLE - abs(pos - i) > 0)"
        parts.append(f"{name} AS (SELECT raster_id, {other}, d AS {axis}, sum(v * share) AS v FROM {src} JOIN {near} n ON i = {axis} GROUP BY 1, 2, 3)")
    return ", ".join(parts)


@query("g1_resample_linear", f"WITH {linear_sql(1.5)} SELECT {KEY}, round(v, 6) AS v FROM ly")
def _(t):
    n = _n(t)
    return focal.resample_linear(t("canopy"), 1.5, n, n).withColumn("v", round6(F.col("v")))


@query("g3_resample_dem_and_mask", f"WITH {linear_sql(3)} SELECT 'dem' AS part, {KEY}, round(v, 6) AS v FROM ly UNION ALL SELECT 'mask', raster_id, CAST(y // 3 AS INT), CAST(x // 3 AS INT), CAST(255 AS DOUBLE) FROM roi WHERE x % 3 = 1 AND y % 3 = 1")
def _(t):
    n = _n(t)
    dem, mask = focal.resample_dem_and_mask(t("canopy"), t("roi"), 3, n, n)
    return dem.select(F.lit("dem").alias("part"), *pixels.KEY, round6(F.col("v")).alias("v")).union(mask.select(F.lit("mask").alias("part"), *pixels.KEY, F.lit(255.0).alias("v")))


def _features(t) -> DataFrame:
    n = F.lit(_n(t))
    f = classify.box_features(t("rgb"), dataset.patch_boxes(t("trees"), 20, n, n), "tid", 20).join(t("trees").select("raster_id", "tid", "cls"), ["raster_id", "tid"])
    return components.written(dataset.split(f, "tid"))


def _predicted(t) -> DataFrame:
    f = _features(t)
    return classify.predict(classify.train(f.where("NOT valid")), f).select("raster_id", "tid", "cls", "valid", "predicted")


@query("m1_patch_features", """WITH patch AS (SELECT b.raster_id, b.tid, c.r FROM (SELECT raster_id, tid, x - 10 AS x0, y - 10 AS y0 FROM trees JOIN grid ON TRUE WHERE x >= 10 AND y >= 10 AND x + 10 <= w AND y + 10 <= w) b JOIN rgb c ON c.raster_id = b.raster_id AND c.x >= x0 AND c.x < x0 + 20 AND c.y >= y0 AND c.y < y0 + 20)
SELECT raster_id, tid, round(avg(r), 6) AS r_mean, round(stddev_pop(r), 6) AS r_std, round(quantile_cont(r, 0.5), 6) AS r_mid, round(100.0 * count(*) FILTER (r > 170) / count(*), 6) AS r_white FROM patch GROUP BY 1, 2""")
def _(t):
    names = ("r_mean", "r_std", "r_mid", "r_white")
    return _features(t).select("raster_id", "tid", *[round6(F.col(c)).alias(c) for c in names])


_rows("m1_predict_patches", _predicted)
_rows("m7_sweep", lambda t: classify.tune(_features(t), [0.001, 0.1], [4], [0, 2], folds=2)[0])


# Sources and sinks: derived rows are written as files in the shared folder and read by the reader


def through_files(name: str, sql: str):
    """A query f(t, spark, path), where path is a folder not in use yet."""

    def register(f):
        query(name, sql)(lambda t: None)
        QUERIES[name] = lambda spark, sf_dir: f(lambda x: table(spark, sf_dir, x), spark, components.new_path(spark))
        return f

    return register


@through_files("s3_read_boxes", "SELECT x1, y1, x2, y2 FROM boxes")
def _(t, spark, path):
    t("boxes").select("x1", "y1", "x2", "y2").write.csv(path, sep=" ")
    return files.read_boxes(spark, path)


@through_files("s4_read_manifest", """SELECT 'mosaic' AS keyword, 'folder' || mosaic || ' image.png tops.png 2 deciduous d.png sickfir s.png out' || mosaic AS args FROM (SELECT DISTINCT mosaic FROM trees)
UNION ALL SELECT 'patchSize', '100' UNION ALL SELECT 'important', 'sickfir' UNION ALL SELECT 'unimportant', 'deciduous'""")
def _(t, spark, path):
    mosaics = t("trees").select("mosaic").distinct().select(F.concat(F.lit("  mosaic folder"), F.col("mosaic").cast("string"), F.lit(" image.png tops.png 2 deciduous d.png sickfir s.png out"), F.col("mosaic").cast("string")).alias("line"))
    fixed = spark.range(1).select(F.explode(F.array(*map(F.lit, ["# comment", "", "patchSize 100", "important sickfir", "unimportant deciduous"]))).alias("line"))
    mosaics.union(fixed).write.text(path)
    return files.read_manifest(spark, path).select("keyword", F.array_join("args", " ").alias("args"))


@through_files("s5_read_annotations", f"WITH {ANN} SELECT CAST(image AS VARCHAR) AS image, len(labels) AS n, array_to_string(labels, '|') AS joined FROM ann")
def _(t, spark, path):
    t("annotations").select("image", "label_text").write.csv(path, header=True)
    return files.read_annotations(spark, path).select("image", F.size("labels").cast("long").alias("n"), F.array_join("labels", "|").alias("joined"))


@through_files("s6_read_metric_matrix", """WITH o AS (SELECT exp, config_ord, config, row_number() OVER (PARTITION BY exp ORDER BY config_ord, config) AS ord FROM (SELECT DISTINCT exp, config_ord, config FROM metrics))
SELECT m.exp, CAST(ord AS BIGINT) AS config_ord, m.mosaic, max(match) AS value FROM metrics m JOIN o USING (exp, config_ord, config) GROUP BY 1, 2, 3""")
def _(t, spark, path):
    wide = t("metrics").groupBy("exp", "config_ord", "config").pivot("mosaic", list(range(1, 10))).agg(F.max("match"))
    line = F.concat_ws(" ", "config", *[F.lit(x) for x in "a b c d e".split()], *[F.coalesce(F.col(str(i)).cast("string"), F.lit("none")) for i in range(1, 10)])
    rows = wide.select("exp", "config_ord", "config", line.alias("line")).union(wide.select("exp", F.lit(-1), F.lit(""), F.lit("method and parameters")).distinct())
    rows.repartition(1).sortWithinPartitions("exp", "config_ord", "config").select("exp", "line").write.partitionBy("exp").text(path)  # one small file an experiment
    found = files.read_metric_matrix(spark, f"{path}/exp=*")
    return found.select(F.regexp_extract("path", "exp=([^/]+)/", 1).alias("exp"), F.col("config_ord").cast("long").alias("config_ord"), F.col("mosaic").cast("int").alias("mosaic"), "value")


@through_files("s7_read_log", "SELECT CAST(log_id % 3 AS INT) AS part, CAST(row_number() OVER (PARTITION BY log_id % 3 ORDER BY log_id, line_no) AS INT) AS line_no, line FROM log")
def _(t, spark, path):
    log = t("log").withColumn("part", (F.col("log_id") % 3).cast("int"))
    log.repartition(3, "part").sortWithinPartitions("part", "log_id", "line_no").select("part", "line").write.partitionBy("part").text(path)
    return files.read_lines(spark, f"{path}/part=*").select(F.regexp_extract("path", "part=([0-9]+)/", 1).cast("int").alias("part"), "line_no", "line")


@through_files("s8_read_series", "SELECT exp || '-' || config_ord || '-' || mosaic AS x, name, value FROM (SELECT exp, config_ord, mosaic, match, euc, haus FROM metrics) UNPIVOT (value FOR name IN (match, euc, haus))")
def _(t, spark, path):
    t("metrics").select(F.concat_ws("-", "exp", F.col("config_ord").cast("string"), F.col("mosaic").cast("string")).alias("x"), "match", "euc", "haus").write.csv(path, header=True)
    return files.read_series(spark, path)


@through_files("s11_write_top_mask", "SELECT DISTINCT raster_id, y + dy AS y, x + dx AS x FROM preds CROSS JOIN offs CROSS JOIN grid WHERE d2 <= 4 AND x + dx BETWEEN 0 AND w - 1 AND y + dy BETWEEN 0 AND w - 1")
def _(t, spark, path):
    n = _n(t)
    files.write_mask(pixels.paint_disks(t("preds"), 2, n, n), path)
    return spark.read.parquet(path).select("raster_id", "y", "x")


@through_files("s1_read_tiff", f"SELECT {KEY}, v FROM canopy")
def _(t, spark, path):
    images.write_tiff_tiles(t("canopy"), path, 200)
    return images.read_tiff_tiles(spark, path)


@through_files("s12_write_patch_images", """SELECT f.site, b.cls, count(*) AS n, CAST(sum(c.r) AS BIGINT) AS r, CAST(sum(c.g * (c.x - x0)) AS BIGINT) AS gx, CAST(sum(c.b * (c.y - y0)) AS BIGINT) AS by FROM (SELECT raster_id, tid, cls, mosaic, x - 10 AS x0, y - 10 AS y0 FROM trees JOIN grid ON TRUE WHERE x >= 10 AND y >= 10 AND x + 10 <= w AND y + 10 <= w) b
JOIN folds f ON f.mosaic = b.mosaic JOIN scene c ON c.raster_id = b.raster_id AND c.x >= x0 AND c.x < x0 + 20 AND c.y >= y0 AND c.y < y0 + 20 GROUP BY 1, 2""")
def _(t, spark, path):
    n = F.lit(_n(t))
    named = dataset.patch_boxes(t("trees").join(t("folds"), "mosaic"), 20, n, n)
    images.write_box_images(t("scene"), named, "tid", 20, path)
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]+)/", 1)
    sums = [F.sum(c).alias(c) for c in ("n", "r", "gx", "by")]
    return images.png_sums(spark, path).groupBy(part("site").cast("int").alias("site"), part("cls").alias("cls")).agg(*sums)


@through_files("s12_write_patches", """SELECT f.site, b.cls, count(*) AS n, sum(c.r) AS r FROM (SELECT raster_id, tid, cls, mosaic, x - 10 AS x0, y - 10 AS y0 FROM trees JOIN grid ON TRUE WHERE x >= 10 AND y >= 10 AND x + 10 <= w AND y + 10 <= w) b
JOIN folds f ON f.mosaic = b.mosaic JOIN rgb c ON c.raster_id = b.raster_id AND c.x >= x0 AND c.x < x0 + 20 AND c.y >= y0 AND c.y < y0 + 20 GROUP BY 1, 2""")
def _(t, spark, path):
    named = t("trees").join(t("folds"), "mosaic").select("raster_id", "tid", "cls", "site")
    files.write_patches(_patch(t).join(named, ["raster_id", "tid"]), path)
    return spark.read.parquet(path).groupBy("site", "cls").agg(F.count("*").alias("n"), F.sum("v").alias("r")).select(F.col("site").cast("int").alias("site"), "cls", "n", "r")
