"""Point predicates, distance joins and point-set evaluation.

Point sets are (raster_id, id, x, y, ...). Distance joins are equi-joins on grid cells of the
search radius: one side goes to its own cell, the other to the 3 x 3 cells round its own, so no
pair farther than two cells is formed and no side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cell, distance
from .components import looked_up, partial_runs, written


def within(a: DataFrame, b: DataFrame, radius: float, extra: Column | None = None, keys: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Pairs (keys, a_id, b_id, d) with d < radius. a: (keys, a_id, ax, ay), b: (keys, b_id, bx, by)."""
    near = F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))
    left = a.withColumns({"cx": cell(F.col("ax"), radius), "cy": cell(F.col("ay"), radius)})
    right = b.withColumn("dx", near).withColumn("dy", near)
    right = right.withColumns({"cx": cell(F.col("bx"), radius) + F.col("dx"), "cy": cell(F.col("by"), radius) + F.col("dy")}).drop("dx", "dy")
    pairs = left.join(right, [*keys, "cx", "cy"]).withColumn("d", distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).where(F.col("d") < radius)
    return pairs if extra is None else pairs.where(extra)


def nearest(a: DataFrame, b: DataFrame, k: int = 1, start: float = 8.0, extra: Column | None = None, rounds: int = 24) -> DataFrame:
    """The k nearest b of every a (raster_id, a_id, b_id, d, rank); ties go to the smaller b_id.

    The radius starts at `start` and doubles for the points that have fewer than k neighbours
    within it, which alone take part in the next round. An a on a raster with fewer than k
    points of b has what there is. Empty sides give no rows.
    """
    w = Window.partitionBy("raster_id", "a_id").orderBy("d", "b_id")
    a, b = written(a), written(b)
    found, rest, radius = None, a, start
    limits = b.groupBy("raster_id").agg(F.count("*").alias("n"), F.min("bx").alias("x0"), F.max("bx").alias("x1"), F.min("by").alias("y0"), F.max("by").alias("y1"))
    rest = rest.join(limits, "raster_id").withColumn("reach", F.greatest(F.abs(F.col("ax") - F.col("x0")), F.abs(F.col("ax") - F.col("x1"))) + F.greatest(F.abs(F.col("ay") - F.col("y0")), F.abs(F.col("ay") - F.col("y1")))).select(*a.columns, "reach")
    rest = written(rest)
    for _ in range(rounds):
        hits = within(rest, b, radius, extra).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        full = hits.groupBy("raster_id", "a_id").agg(F.count("*").alias("have"), F.first("reach").alias("r")).where((F.col("have") >= k) | (F.col("r") < radius))
        full = written(full)
        done = hits.join(full, ["raster_id", "a_id"], "left_semi").select("raster_id", "a_id", "b_id", "d", "rank")
        found = done if found is None else found.union(done)
        rest = written(rest.join(full, ["raster_id", "a_id"], "left_anti").where(F.col("reach") >= radius))
        if rest.isEmpty():
            break
        radius *= 2
    return found


def as_a(points: DataFrame, key: str) -> DataFrame:
    return points.select("raster_id", F.col(key).alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))


def as_b(points: DataFrame, key: str) -> DataFrame:
    return points.select("raster_id", F.col(key).alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))


def in_pixels(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Points whose truncated coordinates are pixels of the set (a region of interest or a mask). What goes to the points are runs, as far as a task has read them together, not pixels."""
    return looked_up(points, partial_runs(pixels), "left_semi")


def drop_border(points: DataFrame, width: Column, height: Column, margin: int) -> DataFrame:
    return points.where(F.col("x").between(margin, width - margin) & F.col("y").between(margin, height - margin))


def classify_by_layer(points: DataFrame, layers: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """(raster_id, key, n_layers, cls): the class layer that a point lies in, null for none.
    strict: a point in two layers is an error; otherwise the first name counts."""
    at = layers.select("raster_id", F.col("x").alias("px"), F.col("y").alias("py"), "layer")
    hit = points.join(at, (points["raster_id"] == at["raster_id"]) & (F.floor("x") == F.col("px")) & (F.floor("y") == F.col("py")), "left").select(points["raster_id"], key, "layer")
    out = hit.groupBy("raster_id", key).agg(F.count("layer").alias("n_layers"), F.min("layer").alias("cls"))
    if strict:
        out = out.withColumn("cls", F.when(F.col("n_layers") > 1, F.raise_error(F.lit("a point lies in two class layers"))).otherwise(F.col("cls")))
    return out


def matched_counts(truth: DataFrame, pred: DataFrame, eps: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(raster_id, *by, eps, n_truth, n_matched, matched_pct): truth points with a prediction closer than eps; -1 if a side is empty.

    truth and pred: (raster_id, *by, id, x, y). One distance join at the largest eps serves all.
    """
    keys = ("raster_id", *by)
    a = truth.select(*keys, F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = pred.select(*keys, F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    best = within(a, b, max(eps), keys=keys).groupBy(*keys, "a_id").agg(F.min("d").alias("d"))
    each = F.explode(F.array(*[F.lit(float(e)) for e in eps])).alias("eps")
    n = a.groupBy(*keys).agg(F.count("*").alias("n_truth")).join(b.groupBy(*keys).agg(F.count("*").alias("n_pred")), list(keys), "full")
    n = n.select(*keys, F.coalesce("n_truth", F.lit(0)).alias("n_truth"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"), each)
    hit = best.select(*keys, "d", each).where("d < eps").groupBy(*keys, "eps").agg(F.count("*").alias("n_matched"))
    out = n.join(hit, [*keys, "eps"], "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)).cast("long"))
    empty = (F.col("n_truth") == 0) | (F.col("n_pred") == 0)
    return out.withColumn("matched_pct", F.when(empty, -1.0).otherwise(100.0 * F.col("n_matched") / F.col("n_truth"))).drop("n_pred")


def class_eval(truth: DataFrame, said: DataFrame, eps: float) -> DataFrame:
    """(raster_id, mosaic, cls, n_truth, matched_any, matched_own, n_pred, pred_matched): truth (a_id, ax, ay, cls)
    near a prediction (b_id, bx, by, said) of any or its own class, and predictions near truth of their class."""
    key = ["raster_id", "mosaic"]
    hit = within(truth, said, eps, keys=tuple(key))
    own = hit.groupBy(*key, "a_id").agg(F.max((F.col("said") == F.col("cls")).cast("int")).alias("own"))
    right = hit.where("said = cls").select(*key, "b_id").distinct().withColumn("right", F.lit(1))
    a = truth.join(own, [*key, "a_id"], "left").groupBy(*key, "cls").agg(F.count("*").alias("n_truth"), F.count("own").alias("matched_any"), F.sum("own").alias("matched_own"))
    b = said.join(right, [*key, "b_id"], "left").groupBy(*key, F.col("said").alias("cls")).agg(F.count("*").alias("n_pred"), F.count("right").alias("pred_matched"))
    counts = ("n_truth", "matched_any", "matched_own", "n_pred", "pred_matched")
    return a.join(b, [*key, "cls"], "full").select(*key, "cls", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def evaluate_grid(truth: DataFrame, found: DataFrame, eps: list[float]) -> DataFrame:
    """(config, mosaic, eps, n_truth, n_pred, n_matched, matched_pct, point_diff) for every configuration of found
    (config, b_id, bx, by), mosaic and distance, in one distance join of the largest."""
    every = truth.join(F.broadcast(found.select("config").distinct()))  # configurations are a parameter grid
    key = ["config", "raster_id", "mosaic"]
    near = within(every, found, float(max(eps)), keys=tuple(key)).groupBy(*key, "a_id").agg(F.min("d").alias("d"))
    steps = F.explode(F.array(*[F.lit(float(e)) for e in eps])).alias("eps")
    hits = near.select("config", "mosaic", "d", steps).groupBy("config", "mosaic", "eps").agg(F.count_if(F.col("d") < F.col("eps")).alias("n_matched"))
    sizes = found.groupBy("config", "mosaic").agg(F.count("*").alias("n_pred")).join(truth.groupBy("mosaic").agg(F.count("*").alias("n_truth")), "mosaic")
    out = sizes.select("*", steps).join(hits, ["config", "mosaic", "eps"], "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    n = F.col("n_truth")
    return out.select("config", "mosaic", "eps", "n_truth", "n_pred", "n_matched", (100.0 * F.col("n_matched") / n).alias("matched_pct"), (100.0 * (n - F.col("n_pred")) / n).alias("point_diff"))
