"""Running sums and last values of a raster's rows in order, across range partitions: no window holds more than one partition's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import written


def running(df: DataFrame, order: list[str], sums: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """df, written, with a running sum (up to the row itself) for each of `sums`, and for each of `before` the last value that isn't null of the rows before it; by raster, in the given order.

    Rows are range-partitioned by raster and order. Each partition counts by itself; what the
    earlier ones hold of a raster comes from a table of one row for each raster and partition.
    """
    sums, before = sums or {}, before or {}
    ranged = df.repartitionByRange("raster_id", *order).withColumns({"part": F.spark_partition_id(), **{f"of_{k}": c for k, c in (sums | before).items()}})
    rows = written(ranged)
    own, parts = Window.partitionBy("raster_id", "part").orderBy(*order), Window.partitionBy("raster_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    carry = rows.groupBy("raster_id", "part").agg(
        *[F.sum(f"of_{k}").alias(f"c_{k}") for k in sums],
        *[F.max_by(f"of_{k}", F.when(F.col(f"of_{k}").isNotNull(), place)).alias(f"c_{k}") for k in before],
    )
    carry = carry.select("raster_id", "part", *[F.sum(f"c_{k}").over(parts).alias(f"c_{k}") for k in sums], *[F.last(f"c_{k}", ignorenulls=True).over(parts).alias(f"c_{k}") for k in before])
    local = {k: F.sum(f"of_{k}").over(own.rowsBetween(Window.unboundedPreceding, 0)) for k in sums} | {k: F.last(f"of_{k}", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)) for k in before}
    out = rows.withColumns(local).join(carry, ["raster_id", "part"])
    whole = {k: F.col(k) + F.coalesce(f"c_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(k, f"c_{k}") for k in before}
    return out.withColumns(whole).drop("part", *[f"of_{k}" for k in whole], *[f"c_{k}" for k in whole])
