"""Spatial windows on sparse rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(p: DataFrame, size: int, step: int) -> DataFrame:
    """p with win_x, win_y: every window of that size, with origins at multiples of step, that holds the pixel.

    A pixel is repeated only for the windows over it; origins are computed, so windows join nothing.
    """
    first = lambda c: F.greatest(F.lit(0), F.ceil((F.col(c) - (size - 1)) / step)).cast("int")
    origin = lambda c: F.explode(F.transform(F.sequence(first(c), F.floor(F.col(c) / step).cast("int")), lambda k: k * step))
    return p.where((F.pmod("x", F.lit(step)) < size) & (F.pmod("y", F.lit(step)) < size)).withColumn("win_x", origin("x")).withColumn("win_y", origin("y"))


def gate(windowed: DataFrame, least: int) -> DataFrame:
    """Pixels of the windows with more than `least` pixels above 0."""
    key = ["raster_id", "win_x", "win_y"]
    full = windowed.where("v > 0").groupBy(*key).count().where(F.col("count") > least)
    return windowed.join(full, key, "left_semi")


def boxes_in(boxes: DataFrame, size: int, step: int) -> DataFrame:
    """Boxes with both corners in a window, in the window's coordinates; a box is tried only in windows over its first corner."""
    b = assign(boxes.withColumns({"x": F.floor("x1").cast("int"), "y": F.floor("y1").cast("int")}).where("x >= 0 AND y >= 0"), size, step)
    b = b.where((F.col("x2") < F.col("win_x") + size) & (F.col("y2") < F.col("win_y") + size))
    return b.select("raster_id", "win_x", "win_y", "box_id", *[(F.col(c) - F.col("win_" + c[0])).alias(c) for c in ("x1", "y1", "x2", "y2")])
