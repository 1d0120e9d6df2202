"""Conversation prefix trie (11): nodes by prefix hashes, subtree sums by centroid decomposition."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow

NODE = ["depth", "k1", "k2"]


def running(df: DataFrame, key: str, order: list[str], carry: list[str], xor: list[str]) -> DataFrame:
    """(key, carry, n, xor): n counts the rows of a key from 1 in the given order, and each column of xor becomes the exclusive-or of its rows so far.

    Rows are range-partitioned by key and order, so one key's rows spread over many tasks. A task
    counts from its own first row; what the tasks before hold of its first key is one row a task.
    key, carry and xor are longs without nulls.
    """
    names = [key, *carry]

    def run(batches):
        part, last, n, sums = TaskContext.get().partitionId(), None, 0, [0] * len(xor)
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(0).to_numpy()
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            row = np.arange(len(k))
            at = np.repeat(start, np.diff(np.r_[start, len(k)]))
            goes_on = (at == 0) & (last is not None and k[0] == last)
            count = row - at + 1 + np.where(goes_on, n, 0)
            made = []
            for i, name in enumerate(xor):
                total = np.bitwise_xor.accumulate(b.column(names.index(name)).to_numpy())
                made.append(total ^ np.where(at > 0, total[at - 1], 0) ^ np.where(goes_on, sums[i], 0))
            last, n, sums = k[-1], int(count[-1]), [int(m[-1]) for m in made]
            cols = [b.column(i) if c not in xor else pa.array(made[xor.index(c)]) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(count), pa.array(np.full(len(k), part))], names=[*names, "n", "part"])

    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).select(*names)
    local = cut(map_arrow(ranged, run, ", ".join(f"`{c}` long" for c in [*names, "n", "part"])))
    # One row a task from here to the join: its first key, and how far its last key has come.
    ends = local.groupBy("part").agg(F.min(key).alias("first"), F.max(F.struct(key, "n", *xor)).alias("e"))
    by_key, by_part = Window.partitionBy(f"e.{key}").orderBy("part"), Window.orderBy("part")
    far = ends.select("part", "first", F.col(f"e.{key}").alias("last"), *[(F.sum if c == "n" else F.bit_xor)(f"e.{c}").over(by_key).alias(c) for c in ["n", *xor]])
    before = far.select("part", "first", F.lag("last").over(by_part).alias("last"), *[F.lag(c).over(by_part).alias(f"before_{c}") for c in ["n", *xor]]).where("first = last")
    before = before.select(F.col("part").alias("p"), "first", *[f"before_{c}" for c in ["n", *xor]])
    joined = local.join(F.broadcast(before), (F.col("part") == F.col("p")) & (F.col(key) == F.col("first")), "left")
    zero = lambda c: F.coalesce(F.col(f"before_{c}"), F.lit(0))
    return joined.select(key, *[c for c in carry if c not in xor], (F.col("n") + zero("n")).alias("n"), *[F.col(c).bitwiseXOR(zero(c)).alias(c) for c in xor])


def rebuilt_paths(conversations: DataFrame, base_of: Column, head_of: Column, most_head: int) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars, total): every prefix of every rebuilt conversation.

    A conversation is the first head_of turns of conversation base_of (columns over conv_id), then
    its own turns after its first head_of. (depth, k1, k2) names the prefix by 128 bits of hashes,
    (depth - 1, p1, p2) the one before it; chars is the length of the last text and total the
    number of turns. Depth 0 is the prefix without turns, which every conversation has.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    hashed = turns.withColumns({f"t{i}": F.xxhash64(F.lit(i), "role", "text") for i in (1, 2)}).withColumn("chars", F.char_length("text").cast("long"))
    own = cut(running(hashed, "conv_id", ["turn", "role", "text"], ["t1", "t2", "chars"], []))
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n_own")).withColumns({"head": head_of.cast("long"), "base": base_of.cast("long")})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    sizes = cut(sizes.join(bases, "base", "left").select("conv_id", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))).alias("total")))
    first = own.where(F.col("n") <= most_head).withColumnRenamed("conv_id", "base")
    from_base = sizes.join(first, "base").where(F.col("n") <= F.col("head")).select("conv_id", F.col("n").alias("depth"), "t1", "t2", "chars", "total")
    from_own = own.join(sizes, "conv_id").where(F.col("n") > F.col("head")).select("conv_id", (F.col("taken") + F.col("n") - F.col("head")).alias("depth"), "t1", "t2", "chars", "total")
    mixed = from_base.union(from_own).withColumns({f"k{i}": F.xxhash64(F.lit(i), "depth", "t1", "t2") for i in (1, 2)}).withColumns({"p1": F.col("k1"), "p2": F.col("k2")})
    path = running(mixed, "conv_id", ["depth"], ["depth", "p1", "p2", "chars", "total", "k1", "k2"], ["k1", "k2"]).drop("n")
    path = path.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("p1")), "p2": F.col("k2").bitwiseXOR(F.col("p2"))})
    zero = F.lit(0).cast("long")
    roots = sizes.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"), "total")
    columns = ["conv_id", *NODE, "p1", "p2", "chars", "total"]
    return cut(path.select(columns).union(roots.select(columns)))


def trie_nodes(path: DataFrame) -> DataFrame:
    """(depth, k1, k2, p1, p2, least, n_convs, chars, below, n_children): a row for each prefix; below is the number of conversations' prefixes in its subtree."""
    nodes = path.groupBy(*NODE).agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.sum(F.col("total") - F.col("depth") + 1).alias("below"),
    )
    nodes = cut(nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    return cut(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))


def centroid_rollup(parents: list[int], sizes: list[int], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Subtree sums of values in one component. parents[i] < i (the top is 0, its parent is not read); sizes are subtree weights of 1 or more a node.

    A component's centroid is its deepest node whose subtree weighs half of it or more. Taken out,
    it leaves its children's components and the one above it; its own total goes to each node
    from it to the top, and the rest is done alike.
    """
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parents[i]].append(i)
    sizes, gone, out, tops = list(sizes), bytearray(n), [[0] * len(values[0]) for _ in range(n)], [0]
    while tops:
        top = z = tops.pop()
        half = sizes[top]
        while heavy := next((c for c in children[z] if not gone[c] and 2 * sizes[c] >= half), None):
            z = heavy
        total, stack = [0] * len(values[0]), [z]
        while stack:
            v = stack.pop()
            total = [a + b for a, b in zip(total, values[v])]
            stack += [c for c in children[v] if not gone[c]]
        gone[z] = 1
        tops += [c for c in children[z] if not gone[c]]
        v, taken = z, sizes[z]
        while True:
            out[v] = [a + b for a, b in zip(out[v], total)]
            if v == top:
                break
            v = parents[v]
            sizes[v] -= taken
        if z != top:
            tops.append(top)
    return out


def _small_components(batches):
    """Rows sorted by component and depth: (comp, node, parent, weight, values); each component ends within its weight's bound."""
    names = [*NODE, "leaves", "saved"]

    def done(rows):
        if len(rows) == 1:
            return [(*rows[0][3:6], *rows[0][9:11])]
        at = {r[3:6]: i for i, r in enumerate(rows)}
        sums = centroid_rollup([at.get((r[3] - 1, r[6], r[7]), -1) for r in rows], [r[8] for r in rows], [r[9:11] for r in rows])
        return [(*r[3:6], *s) for r, s in zip(rows, sums)]

    held: list[tuple] = []
    for b in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[0][:3] != row[:3]:
                out += done(held)
                held = []
            held.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done(held))], names=names)


def subtree_sums(nodes: DataFrame, path: DataFrame, block_rows: int = 50_000) -> DataFrame:
    """(depth, k1, k2, leaves, saved): sums over each node's subtree, by centroid decomposition.

    A node weighs as many rows as conversations pass it, so the weight of a subtree is known at
    once. While components weigh more than block_rows, each round takes out the centroid of each:
    its subtree within the component is totalled (pre-aggregated), the total goes to the nodes on
    the path to the component's top, found as the prefixes of one of the centroid's conversations,
    and the parts become components, each of at most half the weight. Smaller components are
    finished in one task each. So rounds grow with the logarithm of the rows, whatever the depth.
    """
    comp = ["c_depth", "c1", "c2"]
    top = lambda: [F.lit(0).cast("long").alias(c) for c in comp]
    values = [F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")]
    nodes = nodes.select(*top(), *NODE, "p1", "p2", "least", F.col("below").alias("weight"), *values)

    def weighed(df):
        whole = df.groupBy(*comp).agg(F.max("weight").alias("whole"))
        return cut(df.join(whole, comp))

    level, small, given = weighed(nodes), [], []
    while True:
        small.append(level.where(F.col("whole") <= block_rows).drop("whole"))
        active = level.where(F.col("whole") > block_rows)
        if active.isEmpty():
            break
        centre = active.where(2 * F.col("weight") >= F.col("whole")).groupBy(*comp).agg(F.min(F.struct("weight", *NODE, "least", "leaves", "saved")).alias("z"))
        centre = cut(centre.select(*comp, *[F.col(f"z.{c}").alias(f"z_{c}") for c in ("weight", *NODE, "least", "leaves", "saved")]))
        # Conversations that go on below a centroid, each with the child that it takes.
        into = path.join(centre, (F.col("depth") == F.col("z_depth") + 1) & (F.col("p1") == F.col("z_k1")) & (F.col("p2") == F.col("z_k2")))
        into = into.select(F.col("conv_id").alias("least"), *comp, F.col("depth").alias("n_depth"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
        rest = active.join(centre.select(*[F.col(f"z_{c}").alias(c) for c in NODE]), NODE, "left_anti")
        marked = cut(rest.join(into, ["least", *comp], "left").withColumn("under", F.coalesce(F.col("depth") >= F.col("n_depth"), F.lit(False))))
        sums = marked.where("under").groupBy(*comp).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        whole = centre.join(sums, comp, "left").select(*comp, "z_weight", *[f"z_{c}" for c in NODE], "z_least", *[(F.col(f"z_{c}") + F.coalesce(c, F.lit(0))).alias(c) for c in ("leaves", "saved")])
        whole = whole.withColumnsRenamed({"leaves": "t_leaves", "saved": "t_saved"})
        up = path.join(whole, (F.col("conv_id") == F.col("z_least")) & (F.col("depth") >= F.col("c_depth")) & (F.col("depth") <= F.col("z_depth")))
        up = cut(up.select(*NODE, "z_weight", F.col("t_leaves").alias("leaves"), F.col("t_saved").alias("saved")))
        given.append(up)
        marked = marked.drop("whole").join(up.select(*NODE, "z_weight"), NODE, "left")
        moved = [F.when(F.col("under"), F.col(n)).otherwise(F.col(c)).alias(c) for c, n in zip(comp, ("n_depth", "n1", "n2"))]
        weight = (F.col("weight") - F.coalesce("z_weight", F.lit(0))).alias("weight")
        level = weighed(marked.select(*moved, *NODE, "p1", "p2", "least", weight, "leaves", "saved"))
    parts = small[0]
    for s in small[1:]:
        parts = parts.union(s)
    parts = parts.select(*comp, *NODE, "p1", "p2", "weight", "leaves", "saved").repartition(*comp).sortWithinPartitions(*comp, "depth")
    sums = map_arrow(parts, _small_components, ", ".join(f"{c} long" for c in [*NODE, "leaves", "saved"]))
    for up in given:
        sums = sums.union(up.select(*NODE, "leaves", "saved"))
    return sums.groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def ends_digest(path: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending and comma-joined.

    Ids are sorted and joined in ranges; a node's pieces then meet in order and are hashed as they
    stream by, so memory is bounded, though one digest is computed one piece after the other.
    """

    def joined(batches):
        for b in batches:
            rows = list(zip(*(c.to_pylist() for c in b.columns)))
            out: list[list] = []
            for d, k1, k2, conv in rows:
                if out and out[-1][:3] == [d, k1, k2]:
                    out[-1][4].append(str(conv))
                else:
                    out.append([d, k1, k2, conv, [str(conv)]])
            yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], pa.int64()) for i in range(4)), pa.array([",".join(o[4]) for o in out], pa.string())], names=[*NODE, "conv_id", "ids"])

    def hashed(batches):
        key, h = None, None
        wrap = lambda rows: pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1] for r in rows], pa.string())], names=[*NODE, "ends_sha256"])
        for b in batches:
            out = []
            for d, k1, k2, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                if key == (d, k1, k2):
                    h.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, h.hexdigest()))
                key, h = (d, k1, k2), hashlib.sha256(ids.encode())
            if out:
                yield wrap(out)
        if key is not None:
            yield wrap([(key, h.hexdigest())])

    ends = path.where("depth = total").select(*NODE, "conv_id")
    order = [*NODE, "conv_id"]
    pieces = map_arrow(ends.repartitionByRange(*order).sortWithinPartitions(*order), joined, "depth long, k1 long, k2 long, conv_id long, ids string")
    return map_arrow(pieces.repartition(*NODE).sortWithinPartitions(*order), hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, base_of: Column, head_of: Column, most_head: int = 5, block_rows: int = 50_000) -> DataFrame:
    """The trie of rebuilt conversations, a row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: (conv_id, turn, role, text); see rebuilt_paths() for base_of and head_of, which
    is at most most_head. Turns go by turn (null first), ties by role, then text. Null roles and
    texts are empty, rows without a conv_id take no part, repeated rows are turns of their own, and
    other columns are not read. n_leaves and saved_tokens (members but one, times the code points
    of the last text) are sums over the subtree. No conversations give no nodes.
    """
    path = rebuilt_paths(conversations, base_of, head_of, most_head)
    nodes = trie_nodes(path)
    sums = subtree_sums(nodes, path, block_rows)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_conv_id"))
    made = nodes.join(above, ["depth", "p1", "p2"], "left").join(sums, NODE).join(ends_digest(path), NODE, "left")
    return made.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
