"""Clusters of pixel heights, on (v, n) histograms, which a float raster may have as many rows of as pixels."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .components import written
from .focal import taps
from .ranges import running


def histogram(p: DataFrame) -> DataFrame:
    return p.groupBy("raster_id", "v").agg(F.count("*").alias("n"))


def _fitted(p: DataFrame, model) -> DataFrame:
    # Written, so that its size is known: few heights are broadcast, and no pixel is shuffled by its height.
    h = VectorAssembler(inputCols=["v"], outputCol="features").transform(written(histogram(p)))
    h = h.withColumn("n", F.col("n").cast("double"))
    return model.setWeightCol("n").setPredictionCol("label").fit(h).transform(h).select("raster_id", "v", "label")


def kmeans_pixels(p: DataFrame, k: int, seed: int = 21) -> DataFrame:
    """p with a label of k clusters of heights over all rasters."""
    return p.join(_fitted(p, KMeans(k=k, seed=seed)), ["raster_id", "v"])


def gmm_pixels(p: DataFrame, k: int, iterations: int = 25, seed: int = 21) -> DataFrame:
    """p with the likeliest of k normal components of heights over all rasters."""
    return p.join(_fitted(p, GaussianMixture(k=k, maxIter=iterations, seed=seed)), ["raster_id", "v"])


def fuzzy_cmeans(p: DataFrame, k: int, m: float = 3.0, error: float = 0.05, rounds: int = 100) -> DataFrame:
    """p with the likeliest of k fuzzy clusters of heights over all rasters, numbered by rising centre.

    Works on the heights' histogram; k centres are all that reaches the driver. Memberships are
    inverse distances to the power 2 / (m - 1); centres are means weighted by memberships to the
    power m; rounds end when no centre moves by more than `error`.
    """
    h = written(p.groupBy("v").agg(F.count("*").alias("n")))
    low, high = h.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return p.withColumn("label", F.lit(None).cast("int"))
    centres = [low + (high - low) * (i + 0.5) / k for i in range(k)]
    far = lambda c: F.greatest(F.abs(F.col("v") - c), F.lit(1e-9))
    for _ in range(rounds):
        total = sum((far(c) ** (-2 / (m - 1)) for c in centres[1:]), far(centres[0]) ** (-2 / (m - 1)))
        weight = [F.col("n") * (far(c) ** (-2 / (m - 1)) / total) ** m for c in centres]
        new = list(h.agg(*[F.sum(w * F.col("v")) / F.sum(w) for w in weight]).first())
        moved = max(abs(a - b) for a, b in zip(new, centres))
        centres = new
        if moved <= error:
            break
    nearest = F.array_min(F.array(*[F.struct(far(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(sorted(centres))]))
    return p.withColumn("label", nearest["i"])


def estimated_bandwidth(p: DataFrame, quantile: float = 0.1, samples: int = 100) -> DataFrame:
    """(raster_id, bandwidth): of `samples` pixels of a raster, picked by a hash of their place, the mean distance of heights to the quantile's nearest one, itself counted."""
    picked = p.withColumn("rn", F.row_number().over(Window.partitionBy("raster_id").orderBy(F.xxhash64("y", "x"), "y", "x"))).where(F.col("rn") <= samples)
    lists = picked.groupBy("raster_id").agg(F.collect_list("v").alias("l"))  # `samples` heights at most
    k = F.greatest(F.lit(1), F.floor(F.size("l") * F.lit(quantile)).cast("int"))
    kth = F.transform("l", lambda a: F.element_at(F.array_sort(F.transform("l", lambda b: F.abs(a - b))), k))
    return lists.select("raster_id", (F.aggregate(kth, F.lit(0.0), lambda s, d: s + d) / F.size("l")).alias("bandwidth"))


def meanshift_1d(p: DataFrame, bandwidth: float, least: int = 5, rounds: int = 300) -> DataFrame:
    """p with a label by mean shift over the heights of each raster: 0 for the densest mode.

    Seeds are the bins of the bandwidth with `least` pixels or more. Each moves to the mean of the
    pixels within the bandwidth until none moves by a thousandth of it; of modes closer than the
    bandwidth the one with more pixels stays, and a pixel takes the nearest mode.
    """
    h = written(histogram(p))
    to = lambda c: F.floor(F.col(c) / bandwidth)
    near = F.explode(F.array(*[F.col("bin") + i for i in (-1, 0, 1)]))
    cells = written(h.withColumn("bin", to("v")))
    seeds = h.groupBy("raster_id", F.round(F.col("v") / bandwidth).alias("b")).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    seeds = written(seeds.select("raster_id", F.col("b").alias("seed"), (F.col("b") * bandwidth).alias("at"), F.lit(0).cast("long").alias("size")))
    for _ in range(rounds):
        met = seeds.withColumn("bin", to("at")).withColumn("bin", near).join(cells, ["raster_id", "bin"]).where(F.abs(F.col("v") - F.col("at")) <= bandwidth)
        moved = written(met.groupBy("raster_id", "seed", "at").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("new"), F.sum("n").alias("size")))
        seeds = moved.select("raster_id", "seed", F.col("new").alias("at"), "size")
        if moved.where(F.abs(F.col("new") - F.col("at")) > 1e-3 * bandwidth).isEmpty():
            break
    # Modes are as few as the bins; the larger of two close ones stays (ties: the lower).
    modes = seeds.groupBy("raster_id", F.round("at", 6).alias("at")).agg(F.max("size").alias("size"))
    every = modes.groupBy("raster_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), "at"))).alias("all"))
    far = lambda kept, m: F.forall(kept, lambda x: F.abs(x - m["at"]) >= bandwidth)
    kept = F.aggregate("all", F.array().cast("array<double>"), lambda acc, m: F.when(far(acc, m), F.concat(acc, F.array(m["at"]))).otherwise(acc))
    nearest = lambda modes: F.array_min(F.transform(modes, lambda x, i: F.struct(F.abs(F.col("v") - x).alias("d"), i.alias("i"))))["i"]
    named = h.join(every.select("raster_id", kept.alias("modes")), "raster_id").select("raster_id", "v", nearest(F.col("modes")).alias("label"))
    return p.join(named, ["raster_id", "v"])


def dbscan_1d(p: DataFrame, eps: float, least: int = 10) -> DataFrame:
    """(raster_id, v, n, label): clusters of heights by density, labelled from 1 by rising height; 0 is noise.

    A height is core if `least` pixels or more lie within eps of it; cores up to eps apart are one
    cluster, and another height within eps of a core takes the nearest one's (ties: the lower).
    Counts within eps are differences of a running count, and an open cluster is carried from
    range partition to range partition, so a raster may have as many heights as pixels.
    """
    h = written(histogram(p))
    none = F.lit(0).cast("long")
    asked = F.explode(F.array(F.struct((F.col("v") - eps).alias("at"), F.lit(0).alias("kind"), none.alias("m")), F.struct(F.col("v").alias("at"), F.lit(1).alias("kind"), F.col("n").alias("m")), F.struct((F.col("v") + eps).alias("at"), F.lit(2).alias("kind"), none.alias("m"))))
    counted = running(h.select("raster_id", "v", "n", asked.alias("q")).select("raster_id", "v", "n", "q.*"), ["at", "kind", "v"], {"upto": F.col("m")})
    end = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("upto")))
    h = counted.groupBy("raster_id", "v", "n").agg((end(2) - end(0) >= least).alias("core"))
    core = F.when(F.col("core"), F.col("v"))
    h = running(h, ["v"], before={"below": core})
    first = F.col("core") & (F.col("below").isNull() | (F.col("v") - F.col("below") > eps))
    h = running(h, ["v"], {"c": F.when(first, 1).otherwise(0)})
    h = running(h.withColumn("down", -F.col("v")), ["down"], before={"up": F.when(F.col("core"), F.struct("v", "c"))})
    down = F.when(F.col("v") - F.col("below") <= eps, F.col("v") - F.col("below"))
    rise = F.when(F.col("up.v") - F.col("v") <= eps, F.col("up.v") - F.col("v"))
    label = F.when(F.col("core"), F.col("c")).when(down.isNotNull() & (rise.isNull() | (down <= rise)), F.col("c")).when(rise.isNotNull(), F.col("up.c")).otherwise(0)
    return h.select("raster_id", "v", "n", label.cast("long").alias("label"))


def _reduced(p: DataFrame, width: int, height: int, levels: int) -> DataFrame:
    """p by a median of 5 and `levels` halvings (pyr_down), in one pass over tiles."""
    step, row = 2**levels, taps(5, 0)

    def halved(a):
        a = tiles.median(5)(a)
        for _ in range(levels):
            a = tiles.weighed(row, 0)(tiles.weighed(row, 1)(a))[::2, ::2]
        return a

    return tiles.on_tiles(p, 2 + 2 * (step - 1), width, height, halved, step=step)


def dbscan_reduced(p: DataFrame, eps: float, least: int, width: int, height: int, levels: int = 4) -> DataFrame:
    """p with the label of dbscan_1d over the raster that a median of 5 and `levels` halvings leave; a pixel takes that of the reduced pixel over it (0 where there is none)."""
    named = _named_reduced(p, eps, least, width, height, levels)
    over = p.withColumns({"sy": F.shiftright("y", levels), "sx": F.shiftright("x", levels)})
    return over.join(named, ["raster_id", "sy", "sx"], "left").select(*p.columns, F.coalesce("label", F.lit(0).cast("long")).alias("label"))


def _named_reduced(p: DataFrame, eps: float, least: int, width: int, height: int, levels: int) -> DataFrame:
    """(raster_id, sy, sx, label): the reduced raster's pixels, labelled by dbscan_1d."""
    small = written(_reduced(p, width, height, levels))
    labels = written(dbscan_1d(small, eps, least))
    return small.join(labels, ["raster_id", "v"]).select("raster_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "label")


def reduced_argmax(p: DataFrame, eps: float, least: int, width: int, height: int, levels: int = 4) -> DataFrame:
    """cluster_argmax(dbscan_reduced(...)): the highest pixel under each reduced one is found first, so only these are joined."""
    named = _named_reduced(p, eps, least, width, height, levels).where("label > 0")
    best = highest(p.select("raster_id", "y", "x", "v", F.shiftright("y", levels).alias("sy"), F.shiftright("x", levels).alias("sx")), ["raster_id", "sy", "sx"])
    return cluster_argmax(best.join(named, ["raster_id", "sy", "sx"]))


def highest(p: DataFrame, by: list[str]) -> DataFrame:
    """(by, v, y, x): the highest pixel of each group; ties go to the smallest y, then x.

    First the least place of each height of a group, as one number: numbers are aggregated by hashing
    where the pixels are read, whereas the greatest of structs takes a sort of all pixels.
    """
    place = F.col("y").cast("long") * (1 << 32) + F.col("x").cast("long") + (1 << 31)
    first = p.groupBy(*by, "v").agg(F.min(place).alias("at"))
    best = first.groupBy(*by).agg(F.max(F.struct(F.col("v"), (-F.col("at")).alias("less"))).alias("t")).select(*by, "t.v", (-F.col("t.less")).alias("at"))
    x = F.col("at").bitwiseAND((1 << 32) - 1) - (1 << 31)
    return best.select(*by, "v", F.shiftright("at", 32).cast("int").alias("y"), x.cast("int").alias("x"))


def cluster_argmax(labelled: DataFrame) -> DataFrame:
    """(raster_id, label, v, y, x): the highest pixel of each cluster above 0; ties go to the smallest y, then x."""
    return highest(labelled.where("label > 0"), ["raster_id", "label"])
