"""Confusion matrices, per-class metrics, prediction gates and experiment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(rated: DataFrame) -> DataFrame:
    return rated.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """(cls, sensitivity, specificity, accuracy) from (actual, predicted, n); sensitivity is 0 for a class that isn't in actual."""
    rows = matrix.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("p"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("said"))
    total = matrix.agg(F.sum("n").alias("total"))
    m = rows.join(cols, "cls", "full").na.fill(0).crossJoin(F.broadcast(total))
    tn = F.col("total") - F.col("p") - F.col("said") + F.col("tp")
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return m.select("cls", share(F.col("tp"), F.col("p")).alias("sensitivity"), share(tn, F.col("total") - F.col("p")).alias("specificity"), ((F.col("tp") + tn) / F.col("total")).alias("accuracy"))


def accept(predictions: DataFrame, least: float = 0.6) -> DataFrame:
    """(cls, n, predicted, lost): predictions of that probability or more, and the others."""
    return predictions.groupBy("cls").agg(F.count("*").alias("n"), F.count_if(F.col("p") >= least).alias("predicted"), F.count_if(F.col("p") < least).alias("lost"))


def coverage(counts: DataFrame, share: float = 0.99) -> DataFrame:
    """(total, covered, ok) of accept()."""
    one = counts.agg(F.sum("n").alias("total"), F.sum(F.col("predicted") + F.col("lost")).alias("covered"))
    return one.withColumn("ok", F.col("covered") >= share * F.col("total"))


def param_grid(configs: dict[str, list[int]], spark) -> DataFrame:
    """Every combination of parameter values, named s<size>mpt<pixels>ts<step>."""
    out = None
    for name, values in configs.items():
        one = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
        out = one if out is None else out.crossJoin(one)
    a, b, c = configs
    return out.withColumn("config", F.concat(F.lit("s"), F.col(a).cast("string"), F.lit("mpt"), F.col(b).cast("string"), F.lit("ts"), F.col(c).cast("string")))


def best_config(metrics: DataFrame, threshold: float, by: tuple[str, ...] = ("mosaic",), order: tuple[str, ...] = ("config_ord",), values: tuple[str, ...] = ("match", "point_diff", "euc", "euc_matched", "haus", "repeats")) -> DataFrame:
    """The row of the best match among those with |point_diff| < threshold; ties by `order`; zeros where no row has a match above 0."""
    w = Window.partitionBy(*by).orderBy(F.desc("match"), *order)
    ok = metrics.where((F.abs("point_diff") < threshold) & (F.col("match") > 0))
    best = ok.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*by, "config", *values)
    every = metrics.select(*by).distinct()
    out = every.join(best, list(by), "left")
    return out.select(*by, F.coalesce("config", F.lit("")).alias("config"), *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def zip_lines(a: DataFrame, b: DataFrame, drop: int) -> DataFrame:
    """(line_no, line): b's line without its first `drop` tokens after a's, up to the shorter's end."""
    tokens = F.split("lb", " ")
    return a.select("line_no", F.col("line").alias("la")).join(b.select("line_no", F.col("line").alias("lb")), "line_no").select("line_no", F.concat_ws(" ", "la", F.array_join(F.slice(tokens, drop + 1, F.greatest(F.size(tokens) - drop, F.lit(0))), " ")).alias("line"))


#: What a line of a training log must hold, or begin with, to be read.
LOG_PHRASES = ["models", "all sites", "training site 3 done", "sensitivity", "exp4UNF"]
LOG_START = "9 "


def select_log(log: DataFrame, phrases: list[str] = LOG_PHRASES, start: str = LOG_START) -> DataFrame:
    keep = F.col("line").startswith(start)
    for p in phrases:
        keep = keep | F.col("line").contains(p)
    return log.where(keep)


def log_metrics(log: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """(log_id, line_no, model, cls, sensitivity, specificity, accuracy) of the lines "<class> sensitivity : ...".

    The model is that of the last line that names one, after the augmentation that was named
    last before it, if any; the class is the word before "sensitivity".
    """
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.last(c, ignorenulls=True).over(w)
    tag = F.concat(F.lit("augm"), F.regexp_extract("line", r"exp4UNF[^Fa]*a.{6}([^Fa]*)", 1))
    named = F.concat(F.coalesce("augm", F.lit("")), F.regexp_extract("line", r"model(\S+?)epochs", 1))
    out = log.withColumn("augm", carried(F.when(F.col("line").contains("exp4UNF"), tag)))
    out = out.withColumn("model", carried(F.when(F.col("line").contains("models"), named))).withColumn("cls", F.regexp_extract("line", r"(\S+) sensitivity", 1))
    value = lambda m: F.regexp_extract("line", m + r" : ([0-9.]+)", 1).try_cast("double").alias(m)
    out = out.where((F.col("cls") != "") & F.col("model").isNotNull())
    out = out if classes is None else out.where(F.col("cls").isin(classes))
    return out.select("log_id", "line_no", "model", "cls", value("sensitivity"), value("specificity"), value("accuracy"))


def mean_triplets(m: DataFrame) -> DataFrame:
    return m.groupBy("model", "cls").agg(*[F.avg(c).alias(c) for c in ("sensitivity", "specificity", "accuracy")])


def weighted_average(values: DataFrame, weights: dict[int, float], key: str = "site") -> DataFrame:
    """(model, value, best): mean over sites, weighted; sites without a weight don't count. best marks the largest mean, the first by name of equal ones."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])[F.col(key)]
    means = values.withColumn("w", w).where("w IS NOT NULL").groupBy("model").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    top = means.agg(F.min(F.struct(-F.round("value", 9), F.col("model").alias("model")))["model"].alias("top"))
    return means.join(F.broadcast(top), means["model"] == top["top"], "left").select("model", "value", F.col("top").isNotNull().alias("best"))
