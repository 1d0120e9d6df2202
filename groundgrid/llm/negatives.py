"""Hard-negative mining (13): exact integer scores from Kronecker-packed products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

_LEAST = np.iinfo("int64").min
#: Components are cut here, scores at the range of a long.
_WIDEST = 2**62


def packed_scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products (len(a), len(c)) of whole numbers, exact, cut to the range of a long.

    Both sides are biased to be non-negative. The same component of several candidates lies in
    separate fields of one wide integer, so each component of an anchor is multiplied once for
    all of them, and no field's sum reaches the next. Where one field needs more than 64 bits,
    Python's own integers are the words.
    """
    most = max((int(abs(x).max()) for x in (a, c) if x.size), default=0)
    kind = "uint64" if most < 2**31 else object
    if kind is object:
        a, c = a.astype(object), c.astype(object)
    low_a, low_c = (int(x.min()) if x.size else 0 for x in (a, c))
    a, c, dims = a - low_a, c - low_c, a.shape[1]
    width = max(1, (dims * int(a.max() if a.size else 0) * int(c.max() if c.size else 0)).bit_length())
    if width > 64 and kind != object:
        kind, a, c = object, a.astype(object), c.astype(object)
    fields = 64 // width if kind != object else 4
    n = len(c)
    filled = np.zeros((-(-n // fields) * fields, dims), kind)
    filled[:n] = c
    filled = filled.reshape(-1, fields, dims)
    words = filled[:, 0].copy()
    for j in range(1, fields):
        words |= filled[:, j] << (np.uint64(j * width) if kind != object else j * width)
    products = a.astype(kind) @ words.T
    mask = (1 << width) - 1
    out = np.empty((len(a), len(words), fields), object if kind is object else "int64")
    for j in range(fields):
        out[:, :, j] = (products >> j * width) & mask if kind is object else (products >> np.uint64(j * width)) & np.uint64(mask)
    out = out.reshape(len(a), len(words) * fields)[:, :n]
    if kind is object or dims * (abs(low_a) + 1) * (most + 1) * 4 >= 2**62:
        out = out.astype(object) + low_c * a.astype(object).sum(1)[:, None] + low_a * c.astype(object).sum(1)[None, :] + dims * low_a * low_c
        return np.clip(out, _LEAST + 1, -(_LEAST + 1)).astype("int64")
    return out + (low_c * a.sum(1))[:, None] + (low_a * c.sum(1))[None, :] + dims * low_a * low_c


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    column = column.combine_chunks()
    sizes, values = np.asarray(column.value_lengths()), column.flatten().to_numpy()
    out = np.zeros((len(sizes), dims), "int64")
    out[np.arange(dims)[None, :] < sizes[:, None]] = values
    return out


def _largest(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's k largest scores above the sentinel; ties go to the smaller id."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores != _LEAST))
    else:
        row, col = np.nonzero(scores != _LEAST)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def _read(left: pa.Table, right: pa.Table):
    longest = max((int(np.asarray(t.column("c").combine_chunks().value_lengths()).max(initial=0)) for t in (left, right)), default=0)
    col = lambda t, name: t.column(name).to_numpy()
    scores = packed_scores(_matrix(left.column("c"), longest), _matrix(right.column("c"), longest))
    same = col(left, "label")[:, None] == col(right, "label")[None, :]
    return scores, same, col


def _blocks(anchors: DataFrame, rows: DataFrame, anchor_rows: int, group_rows: int, n_anchors: int, n_rows: int):
    """anchors by (block, group), rows by (block, group): each block of anchors meets each group of rows in one small task."""
    rows = rows.toDF(*rows.columns)  # columns of its own, where anchors come from the same table
    blocks = max(1, -(-n_anchors // anchor_rows))
    groups = max(1, -(-n_rows // group_rows), min(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // 256)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")
    return (
        anchors.withColumn("block", own(blocks)).withColumn("group", every(groups)).groupBy("block", "group"),
        rows.withColumn("group", own(groups)).withColumn("block", every(blocks)).groupBy("block", "group"),
    )


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, c, row): rows with an id, a label and a finite vector, each distinct row once; c is floor(256 x) of each component, row its hash.

    Components are cut to 2^62 either way.
    """
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    c = F.transform(x, lambda v: F.floor(F.least(F.greatest(256 * v, F.lit(-float(_WIDEST))), F.lit(float(_WIDEST)))).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), c.alias("c"))
    return rows.withColumn("row", F.xxhash64("label", "c")).distinct()


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, anchor_rows: int = 2048, group_rows: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over prepared() rows.

    An anchor's positives are its best other rows of its label; for each, the best rows of other
    labels follow whose score is low to high percent of the positive's. Higher scores come first,
    ties by smaller id. All rows are read twice, in groups, against the anchors, in blocks; what a
    task returns is an anchor's best of one group. Rows of other lengths score as if filled up
    with zeros. A positive's score below zero has no negatives, as the two bounds then cross.
    Two different rows of one vec_id are two rows. No rows or no anchors give no rows.
    """
    rows = cut(rows)
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        scores, same, col = _read(left, right)
        ids = col(right, "vec_id")
        itself = (col(left, "vec_id")[:, None] == ids[None, :]) & (col(left, "row")[:, None] == col(right, "row")[None, :])
        scores[~same | itself] = _LEAST
        r, c = _largest(scores, ids, positives)
        return pa.table({"anchor_id": col(left, "vec_id")[r], "row": col(left, "row")[r], "positive_id": ids[c], "score": scores[r, c]})

    a, b = _blocks(anchors, rows, anchor_rows, group_rows, n_anchors, n_rows)
    found = a.cogroup(b).applyInArrow(nearest, "anchor_id long, row long, positive_id long, score long")
    best = Window.partitionBy("anchor_id", "row").orderBy(F.desc("score"), "positive_id")
    found = cut(found.withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= positives))
    bounds = found.groupBy("anchor_id", "row").agg(F.sort_array(F.collect_list(F.struct("slot", "score")))["score"].alias("scores"))
    sought = anchors.withColumnRenamed("vec_id", "anchor_id").join(bounds, ["anchor_id", "row"]).withColumnRenamed("anchor_id", "vec_id")

    def between(left: pa.Table, right: pa.Table) -> pa.Table:
        scores, same, col = _read(left, right)
        ids, wanted, parts = col(right, "vec_id"), left.column("scores").to_pylist(), []
        for slot in range(max(map(len, wanted), default=0)):
            # Python's integers, as 100 times a long may not be one.
            span = [(-(-low * w[slot] // 100), high * w[slot] // 100) if slot < len(w) else (1, 0) for w in wanted]
            least, most = (np.array([s[i] for s in span], "int64")[:, None] for i in (0, 1))
            fit = np.where(~same & (scores >= least) & (scores <= most), scores, _LEAST)
            r, c = _largest(fit, ids, negatives)
            parts.append(pa.table({"anchor_id": col(left, "vec_id")[r], "row": col(left, "row")[r], "slot": np.full(len(r), slot + 1, "int32"), "negative_id": ids[c], "negative_score": fit[r, c]}))
        schema = pa.schema([("anchor_id", pa.int64()), ("row", pa.int64()), ("slot", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
        return pa.concat_tables(parts) if parts else schema.empty_table()

    a, b = _blocks(sought, rows, anchor_rows, group_rows, n_anchors, n_rows)
    made = a.cogroup(b).applyInArrow(between, "anchor_id long, row long, slot int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "row", "slot").orderBy(F.desc("negative_score"), "negative_id")
    made = made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return made.join(found, ["anchor_id", "row", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
