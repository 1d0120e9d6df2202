"""Toxicity (7): a subsequence string-kernel support vector machine with Nyström landmarks."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .quality import sample_labels

#: Subsequences of three characters within SPAN; each skipped character costs a factor DECAY. Chosen by folds inside the learning rows.
SPAN, DECAY = 6, 0.85
#: Of the squared weights, against 4,000 times the mean squared hinge loss.
RIDGE = 0.02
#: Weight of the gapped forms of a string, against its own.
GAPPED = 4
#: Weight of all negatives, against that of the strings of toxic documents.
AGAINST = 4
#: Weight of a toxic document, against a clean one, where decisions are made probabilities.
MISSED = 3
_SPLIT = re.compile(r"[^\W_]+(?:['.*_\-+~^|][^\W_]+)*")
_INSIDE = re.compile(r"[\W_]+")
#: Features are hashed into so many slots, whatever the script.
_SLOTS = 1 << 20
_DIGITS = {ord(c): "0" for c in "123456789"}


def strings_of(text: str | None) -> list[str]:
    """The candidate strings of a text: lower-cased words without the marks inside them; three
    or more single characters in a row, as in a spaced-out word, also make a string."""
    words = [_INSIDE.sub("", w) if not w.isalnum() else w for w in _SPLIT.findall((text or "").lower())]
    if sum(len(w) == 1 for w in words) >= 3:
        run, more = [], []
        for w in [*words, "  "]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) >= 3:
                    more.append("".join(run))
                run = []
        words += more
    return words


def features(words: list[str], most: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse kernel features of words, of unit length: (word number, feature, value), by word.

    A feature is a subsequence of three characters that lie within SPAN, ends marked and digits
    alike; its value sums DECAY to the number of characters skipped. Of strings over `most`
    characters each stretch of `most` is a string of its own to the caller (see pieces()).
    """
    coded = [[0, *map(ord, w.translate(_DIGITS)), 1] for w in words]
    lengths = np.array([len(c) for c in coded], "int64")
    flat = np.concatenate([np.array(c, "uint64") for c in coded]) if coded else np.zeros(0, "uint64")
    owner = np.repeat(np.arange(len(coded)), lengths)
    keys, values = [], []
    for j in range(1, SPAN - 1):
        for k in range(j + 1, SPAN):
            n = len(flat) - k
            if n <= 0:
                continue
            same = owner[:n] == owner[k:]
            mixed = ((flat[:n] << np.uint64(42)) ^ (flat[j : j + n] << np.uint64(21)) ^ flat[k:]) * np.uint64(0x9E3779B97F4A7C15)
            key = owner[:n] * _SLOTS + ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(44)).astype("int64")
            keys.append(key[same])
            values.append(np.full(int(same.sum()), DECAY ** (k - 2)))
    key, value = np.concatenate(keys or [np.zeros(0, "int64")]), np.concatenate(values or [np.zeros(0)])
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, "int64")
    value = np.add.reduceat(value, start) if len(start) else value
    key = key[start]
    word = key // _SLOTS
    norm = np.sqrt(np.bincount(word, value * value, minlength=len(coded)))
    return word, key % _SLOTS, value / norm[word]


def pieces(word: str, most: int = 40) -> list[str]:
    """Words of over `most` characters in overlapping stretches, so that none is too long for the kernel to see a short string in it."""
    return [word] if len(word) <= most else [word[i : i + most] for i in range(0, len(word) - 10, most - 10)]


@dataclass
class Toxicity:
    weights: np.ndarray  # by feature: the landmarks' weighted sum, so scoring needs no kernel row
    bias: float
    slope: float
    offset: float

    def strings(self, words: list[str]) -> np.ndarray:
        """Decision values of words."""
        word, feature, value = features(words)
        return np.bincount(word, value * self.weights[feature], minlength=len(words)) + self.bias

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -40, 40)))


def gapped(word: str) -> list[str]:
    """A word with one letter inserted, or one character doubled, at each inner place."""
    letter = lambda i: "abcdefghijklmnopqrstuvwxyz"[(7 * i + sum(map(ord, word))) % 26]
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in (letter(i), word[i])] if 3 < len(word) <= 40 else []


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 40, block: int = 4096) -> np.ndarray:
    """Weights of a linear SVM of squared hinge loss (y in -1, 1), the last one a bias; sums go by blocks of rows."""
    n = x.shape[1]
    w = np.zeros(n + 1)
    for _ in range(rounds):
        gradient, hessian = ridge * w, ridge * np.eye(n + 1)
        for at in range(0, len(x), block):
            part, side, c = x[at : at + block], y[at : at + block], weight[at : at + block]
            gap = 1 - side * (part @ w[:n] + w[n])
            on = gap > 0
            rows, c = np.hstack([part[on], np.ones((int(on.sum()), 1))]), c[on]
            gradient = gradient - 2 * rows.T @ (c * side[on] * gap[on])
            hessian += 2 * (rows * c[:, None]).T @ rows
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample_rows: int = 20_000, landmarks: int = 480, most_strings: int = 30_000, rounds: int = 2, least_odds: float = 2.0) -> Toxicity:
    """Learn from the sentences of at most sample_rows labelled documents for which learn holds.

    A sentence has its document's label, and is clean if a clean document holds it, too. It is a
    bag of strings; a toxic document holds an insult somewhere, which explains its label, so each
    toxic document gives one vote, split over its strings by the square of how much each tells for
    toxic sentences in the whole sample (otherwise all words of a document with copies would be
    positives). Strings weigh as their votes (half a vote or more) as positives of a first machine;
    strings of clean sentences are its negatives. In each of `rounds` further ones votes count
    what the machine before says, too, and the strings of clean sentences that it scores highest
    join the negatives. Each side is bounded by most_strings; the kernel is reduced to
    `landmarks` of them by the Nyström method, half of them positives with an inserted letter. The
    decision value is made a probability by logistic regression on the documents' strongest
    strings. With no rows, one class, or no string that has half a vote, the score is constant.
    """
    import pandas as pd

    # Bounded by sample_rows.
    ids = cut(sample_labels(labels, label, learn, sample_rows))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text"))

    def explode(batches):
        for b in batches:
            rows = [sorted({p for w in strings_of(t) for p in pieces(w) if len(w) > 1}) for t in b.column("sentence").to_pylist()]
            which = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            kept = b.drop_columns(["sentence"]).take(pa.array(which))
            yield kept.append_column("w", pa.array([w for r in rows for w in r], pa.string()))

    sentences = sample.select("doc_id", "label", F.explode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("sentence"))
    # Copies of a document repeat its sentences, so each distinct sentence counts once.
    single = cut(sentences.groupBy("sentence").agg(F.min("label").alias("label"), F.min("doc_id").alias("doc_id")))
    sides = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pos, neg = sides.get(1.0, 0), sides.get(0.0, 0)
    if not pos or not neg:
        return Toxicity(np.zeros(_SLOTS), 0.0, 0.0, 0.0 if pos == neg else 4.0 if pos else -4.0)
    words = cut(map_arrow(single, explode, "label double, doc_id long, w string"))
    counts = cut(words.groupBy("w").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n")))
    bags = words.where("label = 1").select("doc_id", "w").distinct()
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    counts = counts.withColumn("odds", odds)
    # A clean document may hold an insult, too: a string is of the side whose sentences hold it oftener.
    clean = counts.where("n > 0 AND odds <= 0")
    telling = counts.where(F.col("odds") >= least_odds).select("w", (F.col("p") * F.col("odds")).alias("tells"))

    def explaining(scored: DataFrame):
        """(w, votes) of the strings that have half a vote or more."""
        held = bags.join(scored, "w").withColumn("tells", F.col("tells") * F.col("tells"))
        total = held.groupBy("doc_id").agg(F.sum("tells").alias("total"))
        votes = held.join(total, "doc_id").groupBy("w").agg(F.round(F.sum(F.col("tells") / F.col("total")), 6).alias("votes"))
        return votes.where("votes >= 0.5").orderBy(F.desc("votes"), "w").limit(most_strings).toPandas()

    seeds = explaining(telling)
    plain = clean.orderBy(F.desc("n"), F.xxhash64("w")).limit(most_strings // 2)
    rare = clean.orderBy(F.xxhash64("w"), "w").limit(most_strings // 2)
    negatives = pd.concat([plain.toPandas(), rare.toPandas()]).drop_duplicates("w")[["w"]]
    if not len(seeds):
        p = pos / (pos + neg)
        return Toxicity(np.zeros(_SLOTS), 0.0, 0.0, float(np.log(p / (1 - p))))

    def machine(seeds: list[str], share: np.ndarray) -> tuple[np.ndarray, float]:
        variants = [(v, w_share / len(made)) for w, w_share in zip(seeds, share) for made in [gapped(w)] for v in made][:most_strings]
        positive = [*seeds, *(v for v, _ in variants)]
        share = np.concatenate([share, [GAPPED * w for _, w in variants]])
        every = [*positive, *negatives.w]
        marks = [*positive[: landmarks // 4], *(v for v, _ in variants[: landmarks // 2])]
        marks += list(negatives.w)[: (landmarks - len(marks)) // 2]
        marks += list(negatives.w)[-(landmarks - len(marks)) :]
        marks = list(dict.fromkeys(marks))
        used = np.unique(features(marks)[1])
        column = np.full(_SLOTS, -1)
        column[used] = np.arange(len(used))

        def rows(words: list[str]) -> np.ndarray:
            word, feature, value = features(words)
            on = column[feature] >= 0
            dense = np.zeros((len(words), len(used)), "float32")
            dense[word[on], column[feature[on]]] = value[on]
            return dense

        own = rows(marks)
        near = np.empty((len(every), len(marks)), "float32")
        for i in range(0, len(every), 500):
            near[i : i + 500] = rows(every[i : i + 500]) @ own.T
        spectrum, vectors = np.linalg.eigh((own @ own.T).astype("float64"))
        root = vectors / np.sqrt(np.maximum(spectrum, 1e-3)) @ vectors.T  # Nyström: kernel to the power -1/2
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negatives))])
        weight = np.concatenate([share / share.sum(), np.full(len(negatives), AGAINST / len(negatives))]) * 4000
        for i in range(0, len(near), 4096):  # in place
            near[i : i + 4096] = near[i : i + 4096] @ root
        w = _newton(near, y, weight, RIDGE)
        weights = np.zeros(_SLOTS)
        weights[used] = (root @ w[:-1]) @ own
        return weights, float(w[-1])

    negatives = negatives[~negatives.w.isin(set(seeds.w))]
    model = Toxicity(*machine(list(seeds.w), seeds.votes.to_numpy("float64") ** 0.5), 1.0, 0.0)
    for _ in range(rounds):
        more = explaining(score_strings(telling, model).select("w", (F.col("tells") * F.exp("decision")).alias("tells")))
        if not len(more):  # no string stands out any more
            break
        seeds = more
        mined = score_strings(clean.select("w"), model)
        hard = mined.orderBy(F.desc("decision"), "w").limit(most_strings // 2).drop("decision").toPandas()
        negatives = pd.concat([negatives, hard]).drop_duplicates("w")
        negatives = negatives[~negatives.w.isin(set(seeds.w))]
        model = Toxicity(*machine(list(seeds.w), seeds.votes.to_numpy("float64") ** 0.5), 1.0, 0.0)
    best = score(sample, model).select("label", "decision").toPandas()  # at most sample_rows
    # Strings with an inserted letter are as toxic as those they are made of, so the threshold has to let them pass, too.
    gapped_too = [v for w in seeds.w[: landmarks // 20] for v in gapped(w)[::2]]
    gapped_too = gapped_too[:: max(1, 4 * len(gapped_too) // pos)]
    x = np.concatenate([best.decision.to_numpy(), model.strings(gapped_too)])
    model.slope, model.offset = _platt(x, np.concatenate([best.label.to_numpy(), np.ones(len(gapped_too))]))
    return model


def score_strings(strings: DataFrame, model: Toxicity) -> DataFrame:
    """strings (w, ...) with the machine's decision value of w."""
    shared = strings.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.append_column("decision", pa.array(shared.value.strings(b.column("w").to_pylist())))

    return map_arrow(strings, run, strings.withColumn("decision", F.lit(0.0)).schema)


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of logistic regression on one value; ties are smoothed, so that it ends on separable data."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.column_stack([x, np.ones(len(x))])
    w, weight = np.zeros(2), np.where(y > 0, MISSED, 1.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, a.T @ (weight * (p - target)))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Toxicity, most_cached: int = 500_000) -> DataFrame:
    """docs with decision (of the strongest string of the whole text) and score (its probability) instead of text.

    Distinct strings are scored once in a task, as long as its cache (most_cached strings) holds
    them. Null and empty texts, and texts without letters, have the decision of no string, the
    machine's bias less 1. Columns so named are replaced; every row keeps its own score.
    """
    kept = [c for c in docs.columns if c not in ("text", "decision", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        machine, cache = shared.value, {}
        for b in batches:
            decisions = []
            texts = b.column("text")
            for at in range(0, len(texts), 200):
                rows = [set(strings_of(t.as_py())) for t in texts[at : at + 200]]
                new = [w for w in set().union(*rows) if w not in cache]
                if len(cache) + len(new) > most_cached:
                    cache.clear()
                    new = list(set().union(*rows))
                parts = [(w, p) for w in new for p in pieces(w)]
                for i in range(0, len(parts), 20_000):
                    some = parts[i : i + 20_000]
                    for (w, _), d in zip(some, machine.strings([p for _, p in some]).tolist()):
                        if d > cache.get(w, -1e9):
                            cache[w] = d
                none = machine.bias - 1
                decisions += [max(map(cache.__getitem__, r), default=none) for r in rows]
            found = np.array(decisions, "float64")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found), pa.array(machine.probability(found))], names=[*kept, "decision", "score"])

    schema = docs.select(*kept, F.lit(0.0).alias("decision"), F.lit(0.0).alias("score")).schema
    return map_arrow(docs.select(*kept, "text"), run, schema)
