"""Reports on points against rasters: heights kept by thresholds, regions by decile, annotations against local maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, pixels, tree
from .tops import window_clean

KEY = pixels.KEY


def decile_thresholds(p: DataFrame, digits: int = 6) -> DataFrame:
    """(raster_id, th array): the nine deciles of v, in order."""
    q = pixels.raster_percentiles(p, *[i / 10 for i in range(1, 10)])
    return q.select("raster_id", F.array(*[F.round(f"p{i}", digits) for i in range(9)]).alias("th"))


def threshold_stats(p: DataFrame, tops: DataFrame, ths: DataFrame) -> DataFrame:
    """(raster_id, th, tops_pct, pixels_pct): the share of tops and of pixels at each of the raster's thresholds (raster_id, th array).

    One pass over either table: a row adds to a counter for each threshold it reaches.
    """
    most = ths.agg(F.max(F.size("th"))).first()[0] or 0

    def counted(rows: DataFrame, n: str, kept: str) -> DataFrame:
        reached = [F.count_if(F.col("v") >= F.get("th", F.lit(i))) for i in range(most)]
        one = rows.join(F.broadcast(ths), "raster_id").groupBy("raster_id", "th").agg(F.count("*").alias(n), F.array(*reached).alias(kept))  # one row a raster
        return one

    a = counted(tops.join(p, KEY, "left"), "n", "kept")
    b = counted(p, "m", "pix").drop("th")
    each = F.explode(F.arrays_zip(F.col("th").alias("th"), F.slice("kept", F.lit(1), F.size("th")).alias("kept"), F.slice("pix", F.lit(1), F.size("th")).alias("pix")))
    out = a.join(b, "raster_id").select("raster_id", "n", "m", each.alias("r")).distinct()
    return out.select("raster_id", F.col("r.th").alias("th"), (100.0 * F.col("r.kept") / F.col("n")).alias("tops_pct"), (100.0 * F.col("r.pix") / F.col("m")).alias("pixels_pct"))


def region_report(p: DataFrame, tops: DataFrame, ths: DataFrame) -> DataFrame:
    """(raster_id, band, th, n_tops, on_pct, mean_tops, mean_area, n_regions) for each threshold of the raster (raster_id,
    th array): regions are components of pixels at or above it that hold a top."""
    by = ("band", "raster_id")
    limits = ths.select("raster_id", F.posexplode("th").alias("band", "th"))
    most = ths.agg(F.max(F.size("th"))).first()[0] or 0
    marks = tops.groupBy(*KEY).agg(F.count("*").alias("marks"))
    # One merge tree for all thresholds, which are lowered one by one; shorter lists end in the same band.
    band = F.lit(most) - F.size("th") + tree.entry_band(F.col("v"), F.col("th"))
    cells = p.join(ths, "raster_id").withColumn("band", band).where(F.col("band") < most).select("band", *KEY)
    cells = cells.join(marks, KEY, "left").na.fill(0, ["marks"])
    found = tree.band_components(cells, ["raster_id"], most).where("marks > 0")
    hit = found.select("raster_id", (F.lit(most - 1) - F.col("band")).alias("band"), F.col("marks").alias("n"), "area")
    on = hit.groupBy(*by).agg(F.sum("n").alias("on"), F.sum("area").alias("area"), F.count("*").alias("n_regions"))
    total = tops.groupBy("raster_id").agg(F.count("*").alias("n_tops"))
    out = limits.join(total, "raster_id").join(on, list(by), "left").na.fill(0, ["on", "area", "n_regions"])
    n = F.nullif(F.col("n_regions"), F.lit(0))
    share = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("raster_id", "band", "th", "n_tops", (100.0 * F.col("on") / F.col("n_tops")).alias("on_pct"), share(F.col("on") / n).alias("mean_tops"), share(F.col("area") / n).alias("mean_area"), "n_regions")


def annotation_offset(p: DataFrame, labels: DataFrame, tile: int = 64) -> DataFrame:
    """(raster_id, label, x, y, dif, dist) of each region of a label image: its box's highest pixel (the first by y, x),
    how much higher that is than the pixel under the region's centroid, and how far from the centroid."""
    box = labels.groupBy("raster_id", "label").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    t = lambda c: F.floor(F.col(c) / tile).cast("int")
    b = box.withColumn("tx", F.explode(F.sequence(t("x1"), t("x2")))).withColumn("ty", F.explode(F.sequence(t("y1"), t("y2"))))
    inside = p.withColumns({"tx": t("x"), "ty": t("y")}).join(b, ["raster_id", "tx", "ty"]).where("x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
    best = inside.groupBy("raster_id", "label", "cx", "cy").agg(F.max(F.struct("v", (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("t"))
    best = best.select("raster_id", "label", "cx", "cy", F.col("t.v").alias("top"), (-F.col("t.nx")).alias("hx"), (-F.col("t.ny")).alias("hy"), F.floor("cx").cast("int").alias("x"), F.floor("cy").cast("int").alias("y"))
    under = best.join(p, KEY, "left")
    dist = F.sqrt((F.col("hx") - F.col("cx")) ** 2 + (F.col("hy") - F.col("cy")) ** 2)
    return under.select("raster_id", "label", F.col("hx").alias("x"), F.col("hy").alias("y"), (F.col("top") - F.coalesce("v", F.lit(0.0))).alias("dif"), dist.alias("dist"))


def lost_region_pct(mask: DataFrame, tops: DataFrame, min_size: int) -> DataFrame:
    """(raster_id, pct): tops off the mask, or on a component of it of fewer than min_size pixels."""
    labelled = components.written(components.label_runs(mask))
    area = components.stats(labelled).select("raster_id", "comp_y", "comp_x", "area")
    hit = components.looked_up(tops.select(*KEY), labelled).join(area, ["raster_id", "comp_y", "comp_x"], "left")
    return hit.groupBy("raster_id").agg((100.0 * F.count_if(F.coalesce("area", F.lit(0)) < min_size) / F.count("*")).alias("pct"))


def windowed_clean_lost_tops(p: DataFrame, tops: DataFrame, size: int, low: float, k: int, iterations: int, width: int, height: int, least: float = 100, min_size: int = 10) -> DataFrame:
    """lost_region_pct of the raster after window_clean and a stretch to 255, of what is above `least`."""
    clean = pixels.stretch(components.written(window_clean(p, size, low, k, iterations, width, height)))
    return lost_region_pct(clean.where(F.col("v") > least).select(*KEY), tops, min_size)
