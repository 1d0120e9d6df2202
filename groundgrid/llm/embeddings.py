"""Embedding near-dedup (5): inverted lists with product-quantised residuals, exact cosine rerank."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop, map_arrow

#: Floating-point slack of distances between unit vectors.
SLACK = 1e-5


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), "int64")
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        out[at : at + 4096] = ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)
    return out


def _borders(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each x and centre: no vector of the centre's cell is nearer to x than this, the farthest
    of the cell's borders with the (up to four) centres nearest to x."""
    far = ((x[:, None] - centres) ** 2).sum(2)
    bound = np.zeros_like(far)
    for i in np.argsort(far, axis=1)[:, :4].T:
        apart = np.sqrt(((centres[i][:, None] - centres) ** 2).sum(2))
        gap = far - far[np.arange(len(x)), i][:, None]
        bound = np.maximum(bound, np.divide(gap, 2 * apart, out=np.zeros_like(far), where=apart > 0))
    return bound


@dataclass
class Quantiser:
    """An inverted index for each subspace of unit vectors. Its lists are pairs of coarse centres,
    one for either half of the subspace; members are coded by their residuals, two dimensions a code."""

    halves: np.ndarray  # subspace, half, centre, dimension
    books: np.ndarray  # subspace, part, code, dimension
    radius: float  # chord between unit vectors at the least cosine

    @classmethod
    def fit(cls, x: np.ndarray, centres: int, subspaces: int, codes: int, radius: float) -> Quantiser:
        width = x.shape[1] // subspaces
        parts = x.reshape(len(x), subspaces, 2, width // 2)
        halves = np.stack([np.stack([_kmeans(np.ascontiguousarray(parts[:, s, h]), centres, 8, 2 * s + h) for h in (0, 1)]) for s in range(subspaces)])
        q = cls(halves, np.zeros((subspaces, 1, 1, width)), radius)
        rest = np.stack([(x.reshape(len(x), subspaces, -1)[:, s] - q.centre(s, q.cells(x, s))).reshape(len(x), width // 2, 2) for s in range(subspaces)])
        q.books = np.stack([np.stack([_kmeans(np.ascontiguousarray(rest[s, :, p]), codes, 6, p) for p in range(width // 2)]) for s in range(subspaces)])
        return q

    def sub(self, x: np.ndarray, s: int) -> np.ndarray:
        return x.reshape(len(x), len(self.halves), -1)[:, s]

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors, zeros appended up to the dimension of the subspaces."""
        x = vectors / np.abs(vectors).max(1, keepdims=True)  # so that no square overflows
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        return np.pad(x, ((0, 0), (0, self.halves.shape[0] * 2 * self.halves.shape[3] - x.shape[1])))

    def cells(self, x: np.ndarray, s: int) -> np.ndarray:
        """List of each vector in subspace s."""
        sub, n = self.sub(x, s), self.halves.shape[2]
        d = sub.shape[1] // 2
        return _nearest(np.ascontiguousarray(sub[:, :d]), self.halves[s, 0]) * n + _nearest(np.ascontiguousarray(sub[:, d:]), self.halves[s, 1])

    def centre(self, s: int, cells) -> np.ndarray:
        n = self.halves.shape[2]
        return np.concatenate([self.halves[s, 0][cells // n], self.halves[s, 1][cells % n]], -1)

    def code(self, x: np.ndarray, s: int, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and distance in the subspace from the vector to what they stand for."""
        rest = (self.sub(x, s) - self.centre(s, cells)).reshape(len(x), -1, 2)
        codes = np.stack([_nearest(np.ascontiguousarray(rest[:, p]), b) for p, b in enumerate(self.books[s])], 1)
        error = np.sqrt(sum(((rest[:, p] - b[codes[:, p]]) ** 2).sum(1) for p, b in enumerate(self.books[s])))
        return codes.astype("uint8"), error

    @property
    def reach(self) -> float:
        """Two vectors within the radius are within this in one of the subspaces at least."""
        return self.radius / math.sqrt(len(self.halves)) + SLACK

    def probes(self, x: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for all lists of subspace s that can hold a vector within reach of a row."""
        sub = self.sub(x, s)
        d, n = sub.shape[1] // 2, self.halves.shape[2]
        one, two = _borders(sub[:, :d], self.halves[s, 0]), _borders(sub[:, d:], self.halves[s, 1])
        row, a = np.nonzero(one <= self.reach)
        near = one[row, a][:, None] ** 2 + two[row] ** 2 <= self.reach**2
        i, b = np.nonzero(near)
        return row[i], a[i] * n + b

    def table_distances(self, sub: np.ndarray, s: int, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: each part of a vector against the coded members of a list, by one table a part."""
        rest = (sub - self.centre(s, np.array([cell]))).reshape(len(sub), -1, 2)
        total = np.zeros((len(sub), len(codes)), "float32")
        for p, b in enumerate(self.books[s]):
            table = ((rest[:, p][:, None] - b) ** 2).sum(2).astype("float32")
            total += table[:, codes[:, p]]
        return np.sqrt(total)

    def first_subspace(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first subspace in which x and y, row by row, are within reach: there their link is counted."""
        apart = np.sqrt(((x - y) ** 2).reshape(len(x), len(self.halves), -1).sum(2))
        return (apart <= self.reach - SLACK / 2).argmax(1)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), -1)


def _links(q: Quantiser, least: float, s: int, probes: pa.Table, members: pa.Table):
    """Links between two bounded blocks that belong to subspace s, as counts per probe and a spanning forest."""
    px, mx = _vectors(probes.column("embedding")), _vectors(members.column("embedding"))
    pid, mid = (t.column("node").to_numpy() for t in (probes, members))
    scale = lambda v: v / np.abs(v).max(1, keepdims=True)
    px, mx = scale(px), scale(mx)
    pn, mn = np.sqrt((px * px).sum(1)), np.sqrt((mx * mx).sum(1))
    i, j = np.nonzero(((px / pn[:, None]) @ (mx / mn[:, None]).T >= least - SLACK) & (pid[:, None] != mid))
    near = np.zeros((len(pid), len(mid)), bool)
    for at in range(0, len(i), 4096):
        a, b = i[at : at + 4096], j[at : at + 4096]
        fine = np.einsum("nd,nd->n", px[a], mx[b]) / (pn[a] * mn[b]) >= least
        a, b = a[fine], b[fine]
        own = q.first_subspace(q.unit(px[a]), q.unit(mx[b])) == s if len(a) else np.zeros(0, bool)
        near[a[own], b[own]] = True
    count = near @ members.column("copies").to_numpy()
    big = len(pid)
    label = np.arange(big)
    while True:
        other = np.where(near, label[:, None], big).min(0, initial=big)
        new = np.minimum(label, np.where(near, other, big).min(1, initial=big))
        if (new == label).all():
            break
        label = new
    rows = np.flatnonzero(near.any(1))
    cols = np.flatnonzero(near.any(0))
    a = np.concatenate([pid[rows], mid[cols]])
    b = np.concatenate([pid[label[rows]], pid[other[cols]]]) if len(rows) else a
    n = np.concatenate([count[rows], np.zeros(len(cols), "int64")])
    return a, b, n


def near_duplicates(vectors: DataFrame, least: float = 0.98, sample_rows: int = 16_384, list_rows: int = 100, subspaces: int = 8, codes: int = 64, block: int = 1024) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows of equal, non-null label link at a cosine of `least` or more (double precision). Equal
    vectors of a label are one node with a count. Of the `subspaces` parts of two linked unit
    vectors one pair at least is within the chord's length over the square root of their number.
    So each subspace has inverted lists of its own, their number growing with that of the
    vectors (list_rows a list and label, 1,024 x 1,024 lists at most, beyond which lists grow):
    every vector is a member of one list in each and visits those that can hold a part so near.
    The quantiser is fitted on at most sample_rows vectors; what it was fitted on costs no link.

    Visits carry the vector's part only and are sifted by table distances less each member's
    code error, which loses no link. Whole vectors are fetched for the visits and members that
    a sift leaves, and verified exactly; a link is counted in the first subspace that brings it.
    Lists and their visits meet in blocks of `block` rows, whatever the size of a list, and a
    block returns ids, or counts and a spanning forest, not pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
    null label or vec_id, link with nothing (component_id: vec_id). Vectors of different
    lengths don't link. Repeated rows count as rows each. Other columns are not read. No rows give none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists("embedding", lambda x: x != 0)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    rows = cut(rows.withColumn("good", good))
    nodes = cut(rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))  # a vec_id may have several vectors
    n, labels, dim = nodes.agg(F.count("*"), F.approx_count_distinct("label"), F.max(F.size("embedding"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width = 4 * -(-dim // (4 * subspaces))  # of a subspace: two halves of whole pairs
    sample = nodes.orderBy(F.xxhash64("rep", "label")).limit(sample_rows).select("embedding").toArrow()["embedding"]  # bounded by sample_rows
    start = Quantiser(np.zeros((subspaces, 2, 1, width // 2)), np.zeros((subspaces, 1, 1, width)), 0.0)
    x = np.concatenate([start.unit(np.asarray(v.as_py(), "float64")[None]) for v in sample])
    centres = int(min(max(1, round(math.sqrt(n / (labels * list_rows)))), 1024, max(1, len(x) // 8)))
    shared = spark.sparkContext.broadcast(Quantiser.fit(x, centres, subspaces, codes, math.sqrt(2 - 2 * least)))

    def index(batches):
        q = shared.value
        for b in batches:
            sizes = np.diff(b.column("embedding").offsets.to_numpy())
            for size in np.unique(sizes):
                some = b.take(pa.array(np.flatnonzero(sizes == size)))
                x = q.unit(_vectors(some.column("embedding")))
                for s in range(subspaces):
                    cell = q.cells(x, s)
                    code, error = q.code(x, s, cell)
                    row, to = q.probes(x, s)
                    part = np.ascontiguousarray(q.sub(x, s).astype("float32"))
                    who = np.concatenate([np.arange(len(x)), row])
                    part = pa.array([None] * len(x) + [part[r].tobytes() for r in row], pa.binary())
                    code = pa.array([c.tobytes() for c in code] + [None] * len(row), pa.binary())
                    error = pa.array(np.concatenate([error, np.zeros(len(row))]).astype("float32"))
                    cols = [pa.array(np.full(len(who), v, "int32")) for v in (size, s)]
                    yield pa.RecordBatch.from_arrays([some.column("label").take(pa.array(who)), *cols, pa.array(np.concatenate([cell, to]).astype("int32")), some.column("node").take(pa.array(who)), code, error, part], names=["label", "size", "s", "cell", "node", "codes", "error", "part"])

    kind = nodes.schema["label"].dataType.simpleString()
    index_schema = f"label {kind}, size int, s int, cell int, node long, codes binary, error float, part binary"
    coded = cut(map_arrow(nodes.select("label", "embedding", "node"), index, index_schema))
    key = ["label", "size", "s", "cell"]
    held = coded.groupBy(key).agg(F.ceil(F.count("codes") / block).cast("int").alias("mb"), F.ceil(F.count("part") / block).cast("int").alias("pb"))
    held = cut(held.where("mb > 0 AND pb > 0"))
    member = F.col("codes").isNotNull()
    mine, other = F.when(member, F.col("mb")).otherwise(F.col("pb")), F.when(member, F.col("pb")).otherwise(F.col("mb"))
    # A list's members in mb blocks meet its visits in pb blocks; both are one unless the list is large.
    dealt = coded.join(held, key).withColumn("own", F.pmod(F.xxhash64("node"), mine).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), other - 1)))
    at = [*key, F.when(member, F.col("own")).otherwise(F.col("with")).alias("mi"), F.when(member, F.col("with")).otherwise(F.col("own")).alias("pi")]
    dealt = dealt.select(*at, "node", "codes", "error", "part")

    def sift(keys, table):
        q, (s, cell) = shared.value, (k.as_py() for k in keys[2:4])
        own = table.filter(pc.is_valid(table.column("codes")))
        others = table.filter(pc.is_null(table.column("codes")))
        keep = [np.zeros(0, "int64")] * 2
        if own.num_rows and others.num_rows:
            codes_of, parts = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for t, c, kind in ((own, "codes", "uint8"), (others, "part", "float32")))
            distance = q.table_distances(parts.reshape(others.num_rows, -1), s, cell, codes_of.reshape(own.num_rows, -1))
            pid, mid = others.column("node").to_numpy(), own.column("node").to_numpy()
            near = (distance - own.column("error").to_numpy() <= q.reach + SLACK) & (pid[:, None] != mid)
            keep = [pid[near.any(1)], mid[near.any(0)]]
        ids = np.concatenate(keep)
        fixed = [pa.array([k.as_py()] * len(ids), k.type) for k in keys]
        return pa.Table.from_arrays([*fixed, pa.array(ids, pa.int64()), pa.array(np.arange(len(ids)) < len(keep[0]))], names=[*key, "mi", "pi", "node", "visits"])

    left = cut(dealt.groupBy(*key, "mi", "pi").applyInArrow(sift, f"label {kind}, size int, s int, cell int, mi int, pi int, node long, visits boolean"))
    drop(coded, held)
    full = left.join(nodes.select("node", "embedding", "copies"), "node")

    def link(keys, table):
        probes, own = table.filter(table.column("visits")), table.filter(pc.invert(table.column("visits")))
        a = b = n = np.zeros(0, "int64")
        if probes.num_rows and own.num_rows:
            a, b, n = _links(shared.value, least, keys[2].as_py(), probes, own)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    found = cut(full.groupBy(*key, "mi", "pi").applyInArrow(link, "a long, b long, n long"))
    drop(left)
    counts = cut(found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id"))
    roots = cut(components(found.select("a", "b").where("a != b").distinct()).withColumnRenamed("node", "id"))
    least_id = cut(roots.join(nodes, roots["id"] == nodes["node"]).groupBy("root").agg(F.min("rep").alias("low")))
    roots = cut(roots.join(least_id, "root").select(F.col("id").alias("linked"), "low"))
    nodes = nodes.join(counts, nodes["node"] == counts["id"], "left").join(roots, nodes["node"] == roots["linked"], "left")
    nodes = cut(nodes.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("low", "rep").alias("low")))
    out = rows.join(nodes, rows["good"] & (rows["label"] == nodes["l"]) & (rows["embedding"] == nodes["e"]), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
