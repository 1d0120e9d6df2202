"""Pixel-wise operators on sparse rasters (raster_id, y, x, v): an absent pixel is 0."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .components import written

KEY = ["raster_id", "y", "x"]


def clip_negative(p: DataFrame) -> DataFrame:
    return p.where("v > 0")


def band(p: DataFrame, low: float, high: float) -> DataFrame:
    return p.where(F.col("v").between(low, high))


def percentiles(p: DataFrame, *shares: float, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """Exact linear-interpolated percentiles p0, p1, ... of v by group."""
    return p.groupBy(*by).agg(*[F.percentile("v", F.lit(s)).alias(f"p{i}") for i, s in enumerate(shares)])


def at_ranks(p: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(raster_id, i, place, low, high): for each share the two values between which the percentile lies; place is its rank, from 0.

    Distinct heights are counted and range-partitioned by raster and height. How many pixels each
    partition has of a raster is a small table, which tells the partitions that hold a rank; only
    those are looked at row by row, so no raster's heights meet in one task or window.
    """
    h = p.groupBy("raster_id", "v").agg(F.count("*").alias("n"))
    h = written(h.repartitionByRange("raster_id", "v").withColumn("part", F.spark_partition_id()))
    upto = Window.partitionBy("raster_id").orderBy("part")
    parts = h.groupBy("raster_id", "part").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(upto) - F.col("n"))
    parts = written(parts)  # a row for each raster and partition that meet
    total = parts.groupBy("raster_id").agg(F.sum("n").alias("total"))
    each = F.posexplode(F.array(*[F.lit(float(s)) for s in shares])).alias("i", "share")
    places = total.select("raster_id", "total", each).withColumn("place", F.col("share") * (F.col("total") - 1))
    ranks = places.select("raster_id", "i", "place", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    sought = ranks.join(parts.withColumnRenamed("n", "within"), "raster_id").where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("within")))
    sought = written(sought.select("raster_id", "part", "i", "place", (F.col("rank") - F.col("before")).alias("local")))
    rows = h.join(sought.select("raster_id", "part").distinct(), ["raster_id", "part"], "left_semi")
    rows = rows.withColumn("end", F.sum("n").over(Window.partitionBy("raster_id", "part").orderBy("v")))  # one partition's heights at most
    found = rows.join(sought, ["raster_id", "part"]).where((F.col("local") >= F.col("end") - F.col("n")) & (F.col("local") < F.col("end")))
    return found.groupBy("raster_id", "i", "place").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def raster_percentiles(p: DataFrame, *shares: float) -> DataFrame:
    """percentiles() of whole rasters, by at_ranks()."""
    found = at_ranks(p, shares).withColumn("q", F.col("low") + (F.col("place") - F.floor("place")) * (F.col("high") - F.col("low")))
    return found.groupBy("raster_id").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"p{i}") for i in range(len(shares))])


def percentile_sketch(p: DataFrame, *shares: float, accuracy: int = 10_000) -> DataFrame:
    """percentiles() of whole rasters from mergeable sketches, one pass and no sort; the rank is off by 1 / accuracy of the pixels at most."""
    q = p.groupBy("raster_id").agg(F.percentile_approx("v", F.array(*[F.lit(float(s)) for s in shares]), accuracy).alias("q"))
    return q.select("raster_id", *[F.col("q")[i].alias(f"p{i}") for i in range(len(shares))])


def subtract_floor(p: DataFrame, share: float = 0.01) -> DataFrame:
    """v less its percentile over the raster, clipped at 0 (such pixels go)."""
    low = raster_percentiles(p, share)
    return p.join(low, "raster_id").withColumn("v", F.col("v") - F.col("p0")).drop("p0").where("v > 0")


def stretch(p: DataFrame) -> DataFrame:
    """v scaled to 0..255 by the raster's largest value, as whole numbers."""
    top = p.groupBy("raster_id").agg(F.max("v").alias("top"))
    return p.join(top, "raster_id").withColumn("v", F.floor(F.col("v") * 255 / F.col("top")).cast("int")).drop("top")


def without(p: DataFrame, mask: DataFrame) -> DataFrame:
    return p.join(mask, KEY, "left_anti")


def within_mask(p: DataFrame, mask: DataFrame) -> DataFrame:
    return p.join(mask, KEY, "left_semi")


def union_masks(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*KEY)
    for m in masks[1:]:
        out = out.union(m.select(*KEY))
    return out.distinct()


def gray(rgb: DataFrame) -> DataFrame:
    return rgb.select(*KEY, (F.col("r") * F.lit(0.299) + F.col("g") * F.lit(0.587) + F.col("b") * F.lit(0.114)).alias("v"))


def paint_disks(points: DataFrame, radius: int, width, height) -> DataFrame:
    """Pixels (raster_id, y, x) of the disks round points, inside the raster, each once."""
    side = F.sequence(F.lit(-radius), F.lit(radius))
    spread = points.select("raster_id", "x", "y", F.explode(side).alias("dx")).select("*", F.explode(side).alias("dy")).where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= radius * radius)
    out = spread.select("raster_id", (F.col("y") + F.col("dy")).cast("int").alias("y"), (F.col("x") + F.col("dx")).cast("int").alias("x"))
    return out.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).distinct()


def _frame(axis: str, before: int, after: int):
    other = "y" if axis == "x" else "x"
    return Window.partitionBy("raster_id", other).orderBy(axis).rangeBetween(-before, after)


def _whole(p: DataFrame, *extents) -> bool:
    """Whether a rectangle can go over tiles: one extent for all rasters, and heights that a double holds."""
    return all(isinstance(e, int) for e in extents) and p.schema["v"].dataType.simpleString() in ("double", "float", "int", "smallint", "tinyint")


def _on_tiles(p: DataFrame, low: int, high: int, width: int, height: int, how: str) -> DataFrame:
    """Minimum or maximum over the square from `low` before to `high` after a place; absent pixels are blank, so heights of any sign count."""
    out = tiles.on_tiles(p.select(*KEY, "v"), max(low, high), width, height, tiles.rect(low, high, how), blank=np.nan)
    return out.select(*[F.col(c).cast(p.schema[c].dataType).alias(c) for c in (*KEY, "v")])


def erode_rect(p: DataFrame, k: int, iterations: int = 1, width=None, height=None) -> DataFrame:
    """Minimum over a k x k square, `iterations` times (one square of the joined size), outside pixels ignored.

    A square with an absent pixel gives 0. One pass over tiles; where rasters have extents of
    their own (columns), two passes of window frames, along rows and then columns.
    """
    size = iterations * (k - 1) + 1
    before = iterations * (k // 2)
    after = size - 1 - before
    if _whole(p, width, height):
        return _on_tiles(p, before, after, width, height, "min")
    out = p
    for axis, extent in (("x", width), ("y", height)):
        w = _frame(axis, before, after)
        full = F.least(F.lit(after), F.lit(extent - 1) - F.col(axis)) + F.least(F.lit(before), F.col(axis)) + 1
        out = out.select(*KEY, F.min("v").over(w).alias("m"), (F.count("*").over(w) == full).alias("full")).where("full").select(*KEY, F.col("m").alias("v"))
    return out


def dilate_rect(p: DataFrame, k: int, iterations: int = 1, width=None, height=None) -> DataFrame:
    """Maximum over a k x k square, `iterations` times; pixels that only the square reaches appear."""
    before = iterations * (k // 2)
    after = iterations * (k - 1) - before
    if _whole(p, width, height):
        return _on_tiles(p, before, after, width, height, "max")
    out = p
    for axis, extent in (("x", width), ("y", height)):
        # A pixel reaches the places whose frame holds it.
        reach = out.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col(axis) - after), F.least(F.lit(extent - 1), F.col(axis) + before))).alias("to"))
        out = reach.withColumn(axis, F.col("to").cast("int")).groupBy(*KEY).agg(F.max("v").alias("v"))
    return out


def close_rect(p: DataFrame, k: int, iterations: int = 1, width=None, height=None) -> DataFrame:
    return erode_rect(dilate_rect(p, k, iterations, width, height), k, iterations, width, height)
