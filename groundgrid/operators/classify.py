"""Species of patches by Spark ML: statistics of a patch's pixels as features, and tuning over model settings."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dataset import on_boxes

BANDS = ("r", "g", "b")
FEATURES = [f"{c}_{s}" for c in BANDS for s in ("mean", "std", "low", "mid", "high", "white")]


def patch_features(patches: DataFrame, key: list[str], white: float = 170) -> DataFrame:
    """(key, FEATURES) of patch pixels (key, r, g, b): mean, deviation, quartiles and share of bright pixels of each band."""
    of = lambda c: [F.avg(c), F.coalesce(F.stddev_pop(c), F.lit(0.0)), *(F.percentile(c, F.lit(q)) for q in (0.25, 0.5, 0.75)), 100.0 * F.count_if(F.col(c) > white) / F.count("*")]
    return patches.groupBy(*key).agg(*[v.alias(n) for n, v in zip(FEATURES, [v for c in BANDS for v in of(c)])])


def box_features(pixels: DataFrame, boxes: DataFrame, key: str, size: int, white: float = 170) -> DataFrame:
    """patch_features() of the patch of each box (raster_id, key, y0, x0), made where their tile is: patches are not listed pixel by pixel."""

    def made(a):
        n = (~np.isnan(a)).sum(axis=2)
        mean = np.nansum(a, axis=2) / n
        std = np.sqrt(np.nansum((a - mean[:, :, None]) ** 2, axis=2) / n)
        ranked = np.sort(a, axis=2)  # absent pixels last

        def share(q):
            place = (n - 1) * q
            low = np.floor(place).astype(int)
            ends = [np.take_along_axis(ranked, i[:, :, None], 2)[:, :, 0] for i in (low, np.ceil(place).astype(int))]
            return ends[0] + (place - low) * (ends[1] - ends[0])

        each = [mean, std, share(0.25), share(0.5), share(0.75), 100.0 * (a > white).sum(axis=2) / n]
        return {name: each[i % len(each)][:, i // len(each)] for i, name in enumerate(FEATURES)}

    return on_boxes(pixels, boxes, key, size, BANDS, made, ", ".join(f"{name} double" for name in FEATURES))


def train(features: DataFrame, label: str = "cls", trees: int = 20, seed: int = 7, regularisation: float | None = None) -> PipelineModel:
    """A random forest, or with `regularisation` a logistic regression, over FEATURES; its transform() adds predicted and probability."""
    index = StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(features)
    model = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=seed) if regularisation is None else LogisticRegression(regParam=regularisation, maxIter=40)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), model]).fit(index.transform(features))
    return PipelineModel([*fitted.stages, back])


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """features with predicted; their class, if they have one, isn't looked at."""
    return model.transform(features).drop("features", "rawPrediction", "probability", "prediction")


#: The penalties and the augmentation factors of the training grid.
PENALTIES = [n * 10.0**e for e in (-2, -3, -4) for n in range(1, 10)]
FACTORS = [0, 2, 6, 10, 20]


def tune(features: DataFrame, penalties: list[float] = PENALTIES, depths: list[int] = (3, 6), factors: list[int] = FACTORS, folds: int = 3, label: str = "cls", key: tuple[str, ...] = ("raster_id", "tid"), parallelism: int = 4, seed: int = 7) -> tuple[DataFrame, PipelineModel]:
    """((family, setting, factor, accuracy) of every setting, the best one fitted to all rows), by cross-validation.

    Families are logistic regression (setting: the penalty) and random forest (setting: the
    depth). A row of the rarest class weighs as 1 + factor rows. Folds go by a hash of the key, so
    that settings are compared on the same rows; `parallelism` models are fitted at a time.
    """
    index = StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(features)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(index.transform(features))
    rare = features.where(F.col(label).isNotNull()).groupBy(label).count().orderBy("count", label).first()
    weights = {f"weight_{f}": F.when(F.col(label) == (rare[0] if rare else None), 1.0 + f).otherwise(1.0) for f in factors}
    rows = rows.withColumns(weights | {"fold": F.pmod(F.xxhash64(*key), F.lit(folds)).cast("int")})
    line, forest = LogisticRegression(maxIter=40), RandomForestClassifier(numTrees=20, seed=seed)
    grids = {
        "logistic": (line, ParamGridBuilder().addGrid(line.regParam, list(penalties)).addGrid(line.weightCol, list(weights)).build(), line.regParam),
        "forest": (forest, ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.weightCol, list(weights)).build(), forest.maxDepth),
    }
    found, best = [], None
    for family, (model, grid, param) in grids.items():
        if not grid:
            continue
        weight = model.weightCol
        done = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=folds, foldCol="fold", parallelism=parallelism).fit(rows)
        found += [(family, float(g[param]), int(g[weight].removeprefix("weight_")), float(m)) for g, m in zip(grid, done.avgMetrics)]
        if best is None or max(done.avgMetrics) > best[0]:
            best = (max(done.avgMetrics), done.bestModel)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    chosen = PipelineModel([VectorAssembler(inputCols=FEATURES, outputCol="features"), best[1], back])
    return features.sparkSession.createDataFrame(found, "family string, setting double, factor int, accuracy double"), chosen
