"""SimHash near-dedup (3): fingerprints of word shingles, linked through deletion-variant signatures."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, components, cut, drop, exploded, map_arrow

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: bytes | None, words: int) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: a bit is 1 if over half of the shingles' hashes set it."""
    import xxhash

    found = (text or b"").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    xxh = xxhash.xxh64_intdigest
    total, n = np.zeros(64, "int64"), len(found) - k + 1
    for at in range(0, n, 60_000):  # bounded memory for the longest texts
        upto = min(n, at + 60_000)
        hashes = np.fromiter((xxh(joined[s:e], 42) for s, e in zip(starts[at:upto].tolist(), ends[at + k - 1 : upto + k - 1].tolist())), "uint64", upto - at)
        bits = np.unpackbits(hashes.view("uint8").reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype="int64")
    return int(np.packbits(2 * total > n, bitorder="little").view("int64")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long): SimHash of the whole text's shingles of `words` words (A-Z lower-cased, ASCII white space).

    Fewer words: the whole sequence is the shingle; none, or null: fingerprint 0.
    """

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints fp that differ in 1 or 2 bits, each pair once.

    Two segments of 32 bits: of two bits, one segment has one at most. Segment one is indexed
    under its 32 one-wildcard variants; segment two is needed only where both bits fall into
    segment one, so whole. A pair is taken from one bucket only: the variant of its differing
    bit, the first variant where segment one agrees. A fingerprint has at most 2,080 others
    within two bits, so the verified pairs grow with the number of distinct fingerprints.
    """
    ones = F.shiftrightunsigned("fp", 32)
    wild = F.posexplode(F.array(*[ones.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))) for i in range(32)], F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))))
    index = fps.select("fp", wild.alias("slot", "part")).select("fp", "slot", F.shiftleft(F.col("slot").cast("long"), 32).bitwiseOR(F.col("part")).alias("key"))
    a, b = exploded(index).alias("a"), exploded(index).alias("b")  # 33 rows of each
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    upper = F.shiftrightunsigned(x, 32)
    slot = F.col("a.slot")
    once = F.when(slot == 32, F.bit_count(upper) == 2).otherwise(((upper == 0) & (slot == 0)) | (upper == F.expr("shiftleft(1L, a.slot)")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= 2) & once)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: component_id is the smallest doc_id that
    links of at most two differing bits reach, itself included.

    Copies share a fingerprint, so links are sought between distinct fingerprints only and a
    group of copies costs one row. Rows with a null doc_id get the component of their text
    (null if no other row is in it); repeated ids keep a row each; an empty table gives none.
    """
    own = cut(fingerprints(docs, words))
    least = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least.select("fp")))
    nodes = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    nodes = cut(nodes)
    comp = cut(nodes.groupBy("root").agg(F.min("least").alias("component_id")))
    nodes = cut(nodes.select("fp", "root").join(comp, "root").select(F.col("fp").alias("node"), "component_id"))
    return own.join(nodes, own["fp"] == nodes["node"]).select("doc_id", "fp", "component_id")


#: Bits of a set's parity map, as longs: each shingle flips one bit, so two maps differ in no more bits than the sets in shingles.
_MAP = [f"p{k}" for k in range(8)]


def _shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words; of fewer words, of the whole sequence."""
    import xxhash

    if not words:
        return np.zeros(0, "uint64")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "uint64", len(words))
    k = min(size, len(words))
    n = len(words) - k + 1
    z = np.full(n, 0x9E3779B97F4A7C15, "uint64")
    for i in range(k):
        z = (z ^ h[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
    return np.unique(z)


def _words(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    """A text's words (A-Z lower-cased), and the 128-bit hash of their sequence as two int64."""
    import xxhash

    words = (text or b"").translate(_LOWER).split()
    return words, np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "int64")


def _prefix(found: np.ndarray, similarity: float, hot: np.ndarray, heat: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 shingles, the least frequent of `hot` first and those not in it before them.

    Two sets of at least that Jaccard similarity share one of these, whatever the order, as long as it is the same for all sets.
    """
    take = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1
    if not len(found):
        return found
    weight = np.zeros(len(found), "int64")
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        weight = np.where(hot[at] == found, heat[at], 0)
    return found[np.lexsort((found, weight))[:take]]


def _sketches(size: int, similarity: float, shared):
    def run(batches):
        hot, heat = shared.value
        for b in batches:
            heads, prefixes, maps = [], [], []
            fps = [fingerprint(t.as_py(), 3) for t in b.column(1)]
            for t in b.column(1):
                words, digest = _words(t.as_py())
                found = _shingle_set(words, size)
                heads.append([*digest, len(found)])
                prefixes.append(_prefix(found, similarity, hot, heat).view("int64"))
                odd = np.bincount((found >> np.uint64(55)).view("int64"), minlength=64 * len(_MAP)) & 1
                maps.append(np.packbits(odd.astype("uint8"), bitorder="little").view("int64"))
            heads, maps = np.array(heads, "int64").reshape(-1, 3).T, np.array(maps, "int64").reshape(-1, len(_MAP)).T
            cols = [pa.array(np.ascontiguousarray(x)) for x in (*heads, *maps)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(prefixes, pa.list_(pa.int64())), pa.array(fps, pa.int64())], names=["doc_id", "h1", "h2", "n", *_MAP, "prefix", "fp"])

    return run


def _frequent(texts: DataFrame, size: int, least: int = 3, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least `least` texts of a sixteenth hold, at most `most` of them, with the number of texts.

    They only order the prefixes: hot shingles last, so that few texts meet under them. No result depends on them.
    """

    def run(batches):
        for b in batches:
            sets = [_shingle_set(_words(t.as_py())[0], size).view("int64") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], names=["shingles"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).select("text")
    counts = map_arrow(some, run, "shingles array<long>").select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    counts = cut(counts.where(F.col("n") >= least))
    total, floor = 0, least
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("m")).collect(), key=lambda r: -r["n"]):
        total += r["m"]
        if total > most:
            floor = r["n"] + 1
            break
    found = counts.where(F.col("n") >= floor).toArrow()  # at most `most` rows
    shingle, n = found.column("shingle").to_numpy().view("uint64"), found.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of word shingles have at least that Jaccard similarity."""

    def run(batches):
        for b in batches:
            digests, sets = [], []
            for t in b.column(1):
                found, digest = _words(t.as_py())
                digests.append(digest)
                sets.append(_shingle_set(found, words).view("int64"))
            h = np.array(digests, "int64").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(x)) for x in h), pa.array(sets, pa.list_(pa.int64()))], names=["id", "h1", "h2", "shingles"])

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(nodes.select("node", "id", "h1", "h2").join(wanted, "node", "left_semi"))
    held = texts.withColumnRenamed("doc_id", "id").join(wanted.select("id").distinct(), "id", "left_semi")
    # A doc_id may have several texts, so a set belongs to a text's hash.
    sets = map_arrow(held.select("id", "text"), run, "id long, h1 long, h2 long, shingles array<long>").join(wanted, ["id", "h1", "h2"])
    sets = cut(sets.select("node", "shingles").dropDuplicates(["node"]))
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    found = cut(pairs.join(left, "a").join(right, "b").where(both >= similarity * (F.size("sa") + F.size("sb") - both) - 1e-9).select("a", "b"))
    drop(wanted, sets)
    return found


def signed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes (node, fp) that SimHash links, linear in the nodes: each with the first node of its
    fingerprint, and that with the first one of a fingerprint that differs in at most two bits (see links)."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    same = nodes.join(first, "fp").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = cut(links(first.select("fp")))
    near = near.union(near.select("b", "a")).join(first.select(F.col("fp").alias("b"), F.col("rep").alias("to")), "b")
    near = near.groupBy(F.col("a").alias("fp")).agg(F.min("to").alias("to")).join(first, "fp")
    return same.union(near.select(F.least("rep", "to").alias("a"), F.greatest("rep", "to").alias("b"))).distinct()


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, hubs: int = 8, few: int = 32) -> DataFrame:
    """(doc_id, component_id) of every distinct non-null doc_id: component_id is the smallest doc_id
    that links reach. Texts link if their sets of `words`-word shingles have Jaccard similarity >= `similarity`.

    SimHash links texts first, by fingerprints of three-word shingles that differ in at most two
    bits; each of its links is checked on the shingles. Those that fingerprints miss come from an
    exact join, so no link is lost: two such sets share a shingle of their prefixes (see _prefix),
    which are joined by equality. Pairs are sifted by bounds that no link exceeds: the sets' sizes, the
    places of the shared shingle, and the bits in which parity maps differ; then verified on
    the shingles themselves. Texts with equal word sequences are one node.

    A first pass verifies each text against one text of its keys, beside SimHash's links, so a group of n near copies
    costs about n verifications. As long as the texts of shared keys that hang together by no
    link yet make more than `few` pairs a row, a round compares `hubs` texts of each key with
    the others, which is linear; what is left is compared pair by pair. Rounds also end when
    one has not halved the pairs: many texts that share a rare shingle and aren't similar then
    cost a sifted comparison of each pair, in place of a lost link.

    Rows of one doc_id are one document (linked through each of its texts); null doc_ids give
    no row; empty and null texts are equal; texts shorter than a shingle are one shingle.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(texts, words))
    schema = f"doc_id long, h1 long, h2 long, n long, {', '.join(f'{p} long' for p in _MAP)}, prefix array<long>, fp long"
    own = cut(map_arrow(texts, _sketches(words, similarity, shared), schema))
    sketch = F.first(F.struct("n", *_MAP, "prefix", "fp")).alias("s")  # equal for equal sequences
    nodes = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), sketch).select("h1", "h2", "id", "s.*")
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    index = exploded(nodes.select("node", F.posexplode("prefix").alias("pos", "key")))
    keys = cut(index.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub != other").select("key", "hub"))
    met = cut(index.join(keys, "key").join(nodes.select("node", "n", *_MAP), "node"))
    drop(keys)

    def close(x: str, y: str):
        c = lambda side, name: F.col(f"{side}.{name}")
        n = c(x, "n") + c(y, "n")
        least = n * (similarity / (1 + similarity)) - 1e-9  # shingles in common
        sizes = F.least(c(x, "n"), c(y, "n")) >= similarity * F.greatest(c(x, "n"), c(y, "n")) - 1e-9
        # A pair's first common key leaves no more than this; its other keys may be dropped.
        places = F.least(c(x, "n") - c(x, "pos"), c(y, "n") - c(y, "pos")) >= least
        bits = sum((F.bit_count(c(x, p).bitwiseXOR(c(y, p))) for p in _MAP[1:]), F.bit_count(c(x, _MAP[0]).bitwiseXOR(c(y, _MAP[0]))))
        return sizes & places & (bits <= n - 2 * least)

    first = exploded(met.where("node = hub").select("key", "pos", "n", *_MAP))
    near = met.alias("x").join(first.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("x.hub")) & close("x", "y"))
    near = near.groupBy(F.col("x.node").alias("node")).agg(F.min("x.hub").alias("hub"))
    tried = cut(signed(nodes.select("node", "fp")).union(near.select(F.col("hub").alias("a"), F.col("node").alias("b"))).distinct())
    found = _verified(tried, nodes, texts, words, similarity)
    live, left = met.drop("hub"), None
    for turn in itertools.count():
        roots = cut(components(found))
        named = live.join(roots.withColumnRenamed("node", "was"), F.col("node") == F.col("was"), "left")
        named = cut(named.withColumn("comp", F.coalesce("root", "node")).drop("was", "root"))
        drop(roots, *([live] if turn else [met]))
        sides = named.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"))
        sides = cut(sides.where("m * m > q"))
        live = cut(named.join(sides.select("key"), "key", "left_semi"))
        pairs, rows = sides.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2), F.sum("m")).first()
        drop(named, sides)
        if not rows or pairs <= few * rows or (left and 2 * pairs > left):
            break
        left = pairs
        # A hub is compared with all texts of its bucket that hang together with it by no link yet, and is done with there.
        rank = F.struct(F.xxhash64(F.lit(turn), "node").alias("rank"), F.col("node").alias("hub"))
        chosen = live.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(hubs)).alias("salt")).agg(F.min(rank)["hub"].alias("node"))
        chosen = cut(live.join(chosen.select("key", "node"), ["key", "node"]))
        x, y = exploded(live).alias("x"), exploded(chosen).alias("y")
        more = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & close("x", "y"))
        more = more.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        more = cut(more.join(tried, ["a", "b"], "left_anti"))
        found, tried = found.union(_verified(more, nodes, texts, words, similarity)), tried.union(more)
        rest = cut(live.join(chosen.select("key", "node"), ["key", "node"], "left_anti").drop("comp"))
        drop(live, chosen)
        live = rest
    x, y = exploded(live).alias("x"), exploded(live).alias("y")
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & close("x", "y"))
    rest = cut(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    found = found.union(_verified(rest, nodes, texts, words, similarity))
    drop(live)

    # All texts of a doc_id hang together, and so do all doc_ids of a text.
    ids = nodes.select("node", "id")
    found = found.join(ids.toDF("a", "ida"), "a").join(ids.toDF("b", "idb"), "b").select("ida", "idb").toDF("a", "b")
    member = own.select("doc_id", "h1", "h2").join(nodes.select("h1", "h2", "id"), ["h1", "h2"]).select("doc_id", "id")
    roots = components(found.union(member.distinct()))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    roots = cut(cut(roots).join(cut(least), "root").select("node", "component_id"))
    every = own.select("doc_id").distinct()
    return every.join(roots, every["doc_id"] == roots["node"], "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without the documents that are near copies of one of a smaller doc_id; rows with a null doc_id stay."""
    lost = similar_documents(docs, **how).where("doc_id != component_id").select("doc_id")
    return docs.join(cut(lost), "doc_id", "left_anti")
