"""Quality classifier (9): a sparse rule ensemble, compiled into Spark column expressions."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, map_arrow

#: Statistics of a text; all are 0 for a null or empty one.
STATISTICS = ["log_chars", "upper", "digits", "spaces", "newlines", "symbols", "bangs", "stops", "pipes", "non_ascii", "word_chars", "distinct_words", "distinct_lines", "symbol_words"]

_CLASS = np.zeros(256, int)
for _k, _set in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", "%$#&*@^~<>{}[]\\/=+_", "!?", ".,;:", "|"), 1):
    _CLASS[[ord(c) for c in _set]] = _k
_CLASS[128:] = 9


def _of(text: bytes | None) -> list[float]:
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    kinds = np.bincount(_CLASS[np.arange(256)], weights=np.bincount(np.frombuffer(text, "uint8"), minlength=256), minlength=10)
    words, lines = text.split(), text.split(b"\n")
    m = max(1, len(words))
    odd = sum(1 for w in words if w[-1] in b"%$#&*|@^~" or w[0] in b"%$#&*|@^~")
    return [float(np.log1p(n)), *(float(x) / n for x in kinds[1:10]), (n - kinds[3] - kinds[4]) / m, len(set(words)) / m, len(set(lines)) / len(lines), odd / m]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with one double column stat_<name> for each of STATISTICS, over the whole text; columns so named are replaced."""
    names = ["stat_" + s for s in STATISTICS]
    docs = docs.drop(*names)
    kept = docs.columns

    def run(batches):
        for b in batches:
            rows = np.array([_of(t.as_py()) for t in b.column(len(kept))], "float64").reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *(pa.array(np.ascontiguousarray(x)) for x in rows.T)], names=[*kept, *names])

    schema = docs.select("*", *(F.lit(0.0).alias(n) for n in names)).schema
    return map_arrow(docs.select("*", F.col("text").cast("binary").alias(*fresh(docs, "text_bytes"))), run, schema)


def sample_labels(labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """(doc_id, label 0.0/1.0) of at most `rows` labelled documents for which learn holds, by order of a hash of the id.

    Null ids and labels are left out; of several labels of one document the largest counts.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    one = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _rules(tree) -> list[tuple[tuple[int, bool, float], ...]]:
    """The path to every node below the root as (statistic, at most?, threshold) conditions."""
    found: list = []

    def walk(node, path):
        if path:
            found.append(tuple(sorted(path)))
        if "Internal" in node.getClass().getSimpleName():
            split = node.split()
            at, threshold = split.featureIndex(), split.threshold()
            walk(node.leftChild(), [*path, (at, True, threshold)])
            walk(node.rightChild(), [*path, (at, False, threshold)])

    walk(tree._call_java("rootNode"), [])
    return found


def _holds(rule) -> Column:
    parts = [F.col("stat_" + STATISTICS[i]) <= t if low else F.col("stat_" + STATISTICS[i]) > t for i, low, t in rule]
    return functools.reduce(operator.and_, parts)


class RuleEnsemble:
    """score: a logistic column expression over the statistics, 0 to 1."""

    def __init__(self, rules, weights, bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    @property
    def score(self) -> Column:
        total = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights):
            total = total + F.when(_holds(rule), float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample_rows: int = 20_000, trees: int = 12, depth: int = 3, penalty: float = 0.001) -> RuleEnsemble:
    """Rules from the paths of a random forest over the statistics of at most sample_rows
    labelled documents, weighted by lasso logistic regression; rules of weight 0 are left out.

    learn: a condition on rows of labels, which alone are learnt from. Without rows, or with
    one class only, the score is constant (0.5, or near that class).
    """
    # Bounded by sample_rows, so that it can be broadcast at any size of the corpus.
    ids = cut(sample_labels(labels, label, learn, sample_rows))
    train = cut(with_statistics(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")).drop("text"))
    ones, n = train.agg(F.sum("label"), F.count("*")).first()
    if not n or ones in (0, n):
        return RuleEnsemble([], [], 0.0 if not n else 4.0 if ones else -4.0)
    names = ["stat_" + s for s in STATISTICS]
    points = train.select("label", array_to_vector(F.array(*names)).alias("features")).coalesce(4).cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(points)
    rules = sorted({r for t in forest.trees for r in _rules(t)})
    if not rules:
        points.unpersist()
        p = min(max(ones / n, 0.01), 0.99)
        return RuleEnsemble([], [], float(np.log(p / (1 - p))))
    held = train.select("label", array_to_vector(F.array(*[F.when(_holds(r), 1.0).otherwise(0.0) for r in rules])).alias("features")).coalesce(4).cache()
    model = LogisticRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=80).fit(held)
    points.unpersist()
    held.unpersist()
    weights = model.coefficients.toArray()
    used = [i for i in range(len(rules)) if abs(weights[i]) > 1e-9]
    return RuleEnsemble([rules[i] for i in used], [weights[i] for i in used], model.intercept)


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier); null and empty texts are scored as texts whose statistics are 0."""
    made = with_statistics(docs.drop("score")).withColumn("score", model.score)
    return made.drop(*["stat_" + s for s in STATISTICS])
