"""Suffix-array dedup (12): bytes under strings of a given length that occur earlier, by external induced sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, drop, fresh, map_arrow

#: A sample suffix begins with the least of the hashed strings of GRAM bytes that a window of `length` bytes holds.
GRAM = 24
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
ROW = "h long, u long, doc long, text_hash long, place long"


def sample_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window, sample suffix) for each run of windows that have the same sample suffix.

    A window's sample suffix begins at the leftmost least gram inside it, so equal windows have
    theirs at the same distance. data holds one window at least.
    """
    h1 = (data.astype("uint64") + np.uint64(1)) * _ODD[0]
    h1 ^= h1 >> np.uint64(29)
    h2 = h1[:-1] * _ODD[1] + h1[1:]
    h4 = h2[:-2] * _ODD[2] + h2[2:]
    h8 = h4[:-4] * _ODD[3] + h4[4:]
    h16 = h8[:-8] * _ODD[4] + h8[8:]
    h = h16[:-8] * _ODD[5] + h8[16:]
    h ^= h >> np.uint64(32)
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    # The low byte becomes the distance, so that ties go to the left while ranges double.
    least, reach, span = h & ~np.uint64(255), 1, length - GRAM + 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:] + np.uint64(reach))
        reach *= 2
    if reach < span:
        least = np.minimum(least[: reach - span], least[span - reach :] + np.uint64(span - reach))
    at = np.arange(len(least)) + (least & np.uint64(255)).astype("int64")
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return h[at[first]].view("int64"), first, last, at[first]


def _samples(length: int, chunk: int):
    """Out: a row for each run of windows: its gram's hash, a hash of all its bytes, document, and place (first window, distance, size - 1)."""

    def run(batches):
        for b in batches:
            docs, hashes, texts = (b.column(i) for i in range(3))
            made: list[list] = [[], [], [], [], []]
            for i in range(b.num_rows):
                view = memoryview(texts[i].as_buffer())
                for begin in range(0, max(0, len(view) - length + 1), chunk):
                    part = view[begin : begin + chunk + length - 1]
                    h, first, last, at = sample_runs(np.frombuffer(part, "uint8"), length)
                    made[0].append(h)
                    made[1].append(np.array([xxhash.xxh3_64_intdigest(part[a : z + length]) for a, z in zip(first.tolist(), last.tolist())], "uint64").view("int64"))
                    made[2].append(np.full(len(h), docs[i].as_py()))
                    made[3].append(np.full(len(h), hashes[i].as_py()))
                    made[4].append((first + begin) << 16 | (at - first) << 8 | (last - first))
            if made[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(m), pa.int64()) for m in made], names=["h", "u", "doc", "text_hash", "place"])

    return run


def _settle(batches):
    """Rows sorted by gram, bytes, document and place. Out, by kind: 0, a run whose bytes occurred
    before; 1, the first run of its bytes, where its gram has other bytes, too; and of each task
    2, its first row, 3, its last row, 4, a first run that is alone so far when the task ends.
    many: this task holds several bytes of the gram."""

    def out(cols, kind, many):
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(n, kind, "int32")), pa.array(np.broadcast_to(many, n).copy())], names=["h", "u", "doc", "text_hash", "place", "kind", "many"])

    top = last = alone = None  # the task's first row; the row before; the first run of the gram so far, while it is the only one
    top_many = top_open = False
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(i).to_numpy() for i in range(5)]
        h, u = cols[0], cols[1]
        new_h, new_u = np.ones(n, bool), np.ones(n, bool)
        new_h[1:] = h[1:] != h[:-1]
        new_u[1:] = new_h[1:] | (u[1:] != u[:-1])
        if last is not None:
            new_h[0] = h[0] != last[0]
            new_u[0] = new_h[0] or u[0] != last[1]
        if (~new_u).any():
            yield out([c[~new_u] for c in cols], 0, False)
        firsts = [c[new_u] for c in cols]
        group = np.cumsum(new_h)[new_u]  # 0: the gram of the batch before goes on
        sizes = np.bincount(group, minlength=group.max(initial=0) + 1) if len(group) else np.zeros(1, int)
        came = sizes[0] > 0  # other bytes for the gram of the batch before
        if came and alone is not None:
            yield out([np.array([x]) for x in alone], 1, True)
            alone = None
        if came and top_open:
            top_many = True
        several = (sizes > 1) | (np.arange(len(sizes)) == 0)
        take = several[group] if len(group) else np.zeros(0, bool)
        if top is None:
            top, top_open = tuple(c[0] for c in cols), True
            take[0] = False  # the task's first row is settled with the other tasks'
            top_many = bool(sizes[1] > 1)
        if take.any():
            yield out([c[take] for c in firsts], 1, True)
        if new_h.any():
            top_open = bool(h[-1] == top[0])
            alone = None
            if sizes[-1] == 1 and len(sizes) > 1:
                row = tuple(c[-1] for c in firsts)
                alone = None if row == top else row
        last = tuple(c[-1] for c in cols)
    if top is not None:
        one = lambda row: [np.array([x]) for x in row]
        yield out(one(top), 2, top_many)
        yield out(one(last), 3, bool(top_many and last[0] == top[0]))
        if alone is not None:
            yield out(one(alone), 4, False)


def _texts(length: int):
    """Rows of a document with places: out, each run's suffix from the sample on and what stands before it, backwards."""

    def run(batches):
        for b in batches:
            docs, hashes, texts, places, grams = (b.column(i) for i in range(5))
            made: list[list] = [[], [], [], [], [], []]
            for i in range(b.num_rows):
                view = texts[i].as_buffer().to_pybytes()
                for place, h in zip(places[i].as_py(), grams[i].as_py()):
                    first, distance, more = place >> 16, place >> 8 & 255, place & 255
                    at = first + distance
                    made[0].append(h)
                    made[1].append(view[at : first + more + length])
                    made[2].append(view[first:at][::-1])
                    made[3].append(docs[i].as_py())
                    made[4].append(hashes[i].as_py())
                    made[5].append(at)
            if made[0]:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, kinds)], names=["h", "suffix", "before", "doc", "text_hash", "at"])

    return run


def _padded(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), "uint8").reshape(len(rows), width)


def _left_shared(batches):
    """Rows sorted by gram and what stands before the sample: out, with the most bytes of it that another row of the gram shares. At a task's two ends, where the neighbour isn't known, that is all."""

    def counted(batch, left, right):
        h, before = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        rows = [left, *zip(h, before), right]
        width = max((len(r[1]) for r in rows if r), default=0) + 1
        text, size = _padded([r[1] if r else b"" for r in rows], width), np.array([len(r[1]) if r else 0 for r in rows])
        differs = np.ones((len(rows) - 1, width + 1), bool)
        differs[:, :-1] = text[1:] != text[:-1]
        same = np.minimum(differs.argmax(1), np.minimum(size[1:], size[:-1]))
        for i, (a, b) in enumerate(zip(rows, rows[1:])):
            if a is None or b is None:
                same[i] = width
            elif a[0] != b[0]:
                same[i] = 0
        return batch.append_column("left", pa.array(np.minimum(np.maximum(same[:-1], same[1:]), size[1:-1])))

    held = last = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield counted(held, last, (b.column(0)[0].as_py(), b.column(2)[0].as_py()))
            last = (held.column(0)[-1].as_py(), held.column(2)[-1].as_py())
        held = b
    if held is not None:
        yield counted(held, last, None)


def _common(rows: np.ndarray, size: np.ndarray, to: int) -> np.ndarray:
    """Length of the prefix that each row shares with the row `to`."""
    differs = np.ones((len(rows), rows.shape[1] + 1), bool)
    differs[:, :-1] = rows != rows[to]
    return np.minimum(differs.argmax(1), np.minimum(size, size[to]))


def induce(h: np.ndarray, suffixes: list[bytes], before: list[bytes], rank: np.ndarray, open_: np.ndarray, shared_left: np.ndarray, length: int):
    """Windows of one block of sample suffixes, sorted by gram and suffix: yields for each distance
    (distance, repeated rows, first rows of classes that other blocks may have, too).

    The order and common prefixes of suffixes one byte longer to the left are induced from those at
    hand: a stable sort by the byte before keeps the order inside each byte's bucket, and the
    common prefix of bucket neighbours is one more than the least of those between them. Windows
    are equal where common prefixes reach `length`, and a suffix that can't reach it any more is
    dropped. open_ says that a row's gram goes on in another block: rows there share no more of a
    suffix here than the block's first or last row does, and no more than shared_left of what
    stands before it.
    """
    width = length + 1
    right, size = _padded([s[:width] for s in suffixes], width), np.array([len(s) for s in suffixes])
    reach = np.array([len(x) for x in before])
    left = _padded(before, int(reach.max(initial=0)) + 1)
    differs = np.ones((len(h), width + 1), bool)
    differs[1:, :width] = right[1:] != right[:-1]
    common = np.minimum(differs.argmax(1), np.minimum(size, np.r_[0, size[:-1]]))
    common[0] = 0
    common[1:][h[1:] != h[:-1]] = 0
    group = np.cumsum(np.r_[True, h[1:] != h[:-1]])
    shared = np.full(len(h), -1)
    for end in (0, -1):
        here = open_ & (h == h[end])
        if here.any():
            shared = np.where(here, np.maximum(shared, _common(right, size, end)), shared)
    order, distance = np.arange(len(h)), 0
    while len(order):
        start = common < length
        start[0] = True
        begins = np.flatnonzero(start)
        first = np.repeat(np.minimum.reduceat(rank[order], begins), np.diff(np.r_[begins, len(order)]))
        is_first = rank[order] == first
        elsewhere = (shared[order] + distance >= length) & (shared_left[order] >= distance)
        yield distance, order[~is_first], order[is_first & elsewhere]
        # One byte to the left; what is dropped hands its common prefix on to the next.
        hope = np.maximum(common, np.r_[common[1:], 0]) + (reach[order] - distance) >= length
        maybe = (shared[order] + reach[order] >= length) & (shared_left[order] > distance)
        stay = (reach[order] > distance) & (hope | maybe)
        if not stay.any():
            return
        byte = group[order].astype("int64") << 8 | left[order, distance]
        kept = np.flatnonzero(stay)
        old = kept[np.argsort(byte[kept], kind="stable")]
        same = byte[old[1:]] == byte[old[:-1]]
        spans = np.empty(2 * (len(old) - 1), "int64")
        spans[0::2], spans[1::2] = np.where(same, old[:-1] + 1, 0), np.where(same, old[1:] + 1, 1)
        new = np.zeros(len(old), "int64")
        if len(spans):
            new[1:] = np.where(same, np.minimum.reduceat(np.r_[common, 0], spans)[::2] + 1, 0)
        order, common, distance = order[old], new, distance + 1


def _induced(length: int, block: int):
    """Sorted sample suffixes, in blocks that end with a gram where they can. Out: kind 0, a span of windows (first, last) that occurred before; kind 1, the first window in this block of a class that other blocks may have, with its digest."""

    def work(rows, open_grams):
        h, suffixes, before, doc, text_hash, at, left = rows
        h, doc, text_hash, at = (np.array(x, "int64") for x in (h, doc, text_hash, at))
        rank = np.empty(len(h), "int64")
        rank[np.lexsort((at, text_hash, doc))] = np.arange(len(h))
        flagged: list[tuple] = []
        firsts: list[tuple] = []
        for distance, again, first in induce(h, suffixes, before, rank, np.isin(h, open_grams), np.array(left, 'int64'), length):
            if len(again):
                flagged.append((again, np.full(len(again), distance)))
            for i in first.tolist():
                window = (before[i][:distance][::-1] + suffixes[i])[:length]
                firsts.append((doc[i], text_hash[i], at[i] - distance, at[i] - distance, xxhash.xxh3_128_digest(window), 1))
        if flagged:
            row, begin = (np.concatenate(x) for x in zip(*flagged))
            begin = at[row] - begin
            order = np.lexsort((begin, row))
            row, begin = row[order], begin[order]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (begin[1:] != begin[:-1] + 1)])
            end = begin[np.r_[new[1:], len(row)] - 1]
            yield pa.RecordBatch.from_arrays([pa.array(doc[row[new]]), pa.array(text_hash[row[new]]), pa.array(begin[new]), pa.array(end), pa.nulls(len(new), pa.binary()), pa.array(np.zeros(len(new), "int32"))], names=names)
        if firsts:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*firsts), kinds)], names=names)

    names = ["doc", "text_hash", "first", "last", "digest", "kind"]

    def run(batches):
        held: list[list] = [[] for _ in range(7)]
        open_grams: list[int] = []  # the task's first gram, and one that a block's end cuts
        for b in batches:
            if not b.num_rows:
                continue
            for col, more in zip(held, b.columns):
                col.extend(more.to_pylist())
            if not open_grams:
                open_grams = [held[0][0]]
            if len(held[0]) >= block:
                end = next((i for i in range(len(held[0]) - 1, 0, -1) if held[0][i] != held[0][i - 1]), len(held[0]))
                if end == len(held[0]):
                    open_grams.append(held[0][-1])
                yield from work([c[:end] for c in held], open_grams)
                held = [c[end:] for c in held]
                open_grams = open_grams[-1:]
        if held[0]:
            yield from work(held, [*open_grams, held[0][-1]])

    return run


def repeated_windows(docs: DataFrame, length: int = 100, chunk: int = 1 << 17, block: int = 50_000) -> DataFrame:
    """(doc, text_hash, windows): for documents with windows of `length` bytes that occur earlier, their first bytes as spans (first << 16 | number - 1).

    docs: (doc, text_hash, text), doc a long, text not null. Earlier is a smaller doc, of one doc a
    smaller text_hash, and then a smaller start.

    External induced sorting, with Spark's sorted shuffles as the queues on disk. Sample suffixes
    stand for runs of windows. First queue: runs by gram and all their bytes; runs whose bytes came
    before are settled, and grams that occur with one run of bytes only can't repeat, so they go.
    Second queue: the suffixes left, with their texts, in suffix order; blocks of bounded size carry
    order and common prefixes to the left, byte by byte (induce()). Third queue: the first windows
    of classes that may go on in another block, by digest. A gram that a third of all rows
    hold spreads over tasks and blocks, as its rows differ in document and place.
    """
    order = ["h", "u", "doc", "text_hash", "place"]
    runs = map_arrow(docs.select("doc", "text_hash", "text"), _samples(length, chunk), ROW)
    ranged = runs.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(map_arrow(ranged, _settle, f"{ROW}, kind int, many boolean").withColumn("part", F.spark_partition_id()))
    # At most three rows a task from here to the joins.
    edges = found.where("kind >= 2")
    by_part = Window.orderBy("part")
    ends = edges.where("kind = 3").select(F.col("part").alias("p"), F.lag("h").over(by_part).alias("h0"), F.lag("u").over(by_part).alias("u0"))
    grams = edges.groupBy(F.col("h").alias("g")).agg((F.max("many") | (F.min("u") != F.max("u"))).alias("several"))
    tops = edges.where("kind = 2").join(F.broadcast(ends), F.col("part") == F.col("p")).withColumn("again", F.coalesce((F.col("h") == F.col("h0")) & (F.col("u") == F.col("u0")), F.lit(False)))
    tops = tops.select(*order, "again").union(edges.where("kind = 4").select(*order, F.lit(False).alias("again")))
    tops = tops.join(F.broadcast(grams), F.col("h") == F.col("g")).select(*order, "again", "several")
    settled = found.where("kind = 0").select("doc", "text_hash", "place").union(tops.where("again").select("doc", "text_hash", "place"))
    spans = settled.select("doc", "text_hash", (F.shiftrightunsigned("place", 16) * 65536 + F.col("place").bitwiseAND(255)).alias("span"))
    left = found.where("kind = 1").select(*order).union(tops.where("several AND NOT again").select(*order))
    places = left.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("place", "h")).alias("r"))
    with_text = docs.join(places, ["doc", "text_hash"]).select("doc", "text_hash", "text", "r.place", "r.h")
    suffixes = cut(map_arrow(with_text, _texts(length), "h long, suffix binary, before binary, doc long, text_hash long, at long"))
    by = ["h", "suffix", "before", "doc", "text_hash", "at"]
    # In the order of what stands before them first, which bounds what can go on in another block.
    left = suffixes.select(*by).repartitionByRange("h", "before", "doc", "text_hash", "at").sortWithinPartitions("h", "before")
    left = cut(map_arrow(left, _left_shared, "h long, suffix binary, before binary, doc long, text_hash long, at long, left long"))
    made = cut(map_arrow(left.repartitionByRange(*by).sortWithinPartitions(*by), _induced(length, block), "doc long, text_hash long, first long, last long, digest binary, kind int"))
    drop(left)
    drop(suffixes)
    shared = made.where("kind = 1")
    earliest = shared.groupBy("digest").agg(F.min(F.struct("doc", "text_hash", "first")).alias("e"), F.count("*").alias("n")).where("n > 1")
    later = shared.join(earliest, "digest").where(F.struct("doc", "text_hash", "first") != F.col("e"))
    more = made.where("kind = 0").select("doc", "text_hash", "first", "last").union(later.select("doc", "text_hash", "first", "last"))
    spans = spans.union(more.select("doc", "text_hash", (F.col("first") * 65536 + F.col("last") - F.col("first")).alias("span")))
    return spans.groupBy("doc", "text_hash").agg(F.collect_list("span").alias("windows"))


def _applied(length: int):
    """Rows with text and windows: out, without them, the counts, the spans and the bytes that stay."""

    def run(batches):
        for b in batches:
            texts, windows = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            made: list[list] = [[], [], [], [], []]
            for i in range(b.num_rows):
                data = np.frombuffer(texts[i].as_buffer() or b"", "uint8") if texts[i].is_valid and len(texts[i].as_buffer()) else np.zeros(0, "uint8")
                spans = windows[i].values.to_numpy() if windows[i].is_valid else np.zeros(0, "int64")
                edge = np.zeros(len(data) + 1, "int64")
                np.add.at(edge, spans >> 16, 1)
                np.add.at(edge, (spans >> 16) + (spans & 65535) + length, -1)
                gone = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
                turns = np.flatnonzero(gone[1:] != gone[:-1])
                made[0].append(len(data))
                made[1].append(int(gone.sum()))
                made[2].append(len(turns) // 2)
                made[3].append([{"first": a, "last": z - 1} for a, z in turns.reshape(-1, 2).tolist()])
                made[4].append(data[~gone[1:-1]].tobytes())
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            new = [pa.array(m, k) for m, k in zip(made, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *new], names=[*b.schema.names[:-2], "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs without text, plus n_bytes, n_removed, n_spans, removed (spans first, last in bytes) and kept, the bytes that stay.

    Each byte under a string of `length` bytes goes that also starts earlier: in a smaller doc_id
    (null: after all others, as 2^63 - 1) or in the same document. Strings are those of the input,
    overlaps count, and matches don't cross documents. Rows of one doc_id with different texts are
    documents in the order of their texts' hashes; repeated rows are one document and get the same
    result. A null text is empty. kept may cut a character, so it is binary. Columns of docs with the new names are
    replaced; an empty table gives no rows.
    """
    new = ["n_bytes", "n_removed", "n_spans", "removed", "kept"]
    if length < GRAM or length > 255:
        raise ValueError(f"length must be {GRAM} to 255 bytes")
    docs = docs.drop(*new)
    doc, text_hash, text, windows = fresh(docs, "doc", "text_hash", "whole_text", "windows")
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), text: F.coalesce("text", F.lit(""))}).withColumn(text_hash, F.xxhash64(text))
    sources = keyed.select(F.col(doc).alias("doc"), F.col(text_hash).alias("text_hash"), F.col(text).alias("text"))
    once = sources.where(F.octet_length("text") >= length)
    twice = once.groupBy("doc", "text_hash").count().where("count > 1").select("doc", "text_hash")
    if not twice.isEmpty():  # repeated rows would be earlier copies of themselves
        once = once.join(twice, ["doc", "text_hash"], "left_anti").union(once.join(twice, ["doc", "text_hash"]).dropDuplicates(["doc", "text_hash"]))
    found = repeated_windows(once, length).toDF("found_doc", "found_hash", "found")
    rows = keyed.join(found, (keyed[doc] == found["found_doc"]) & (keyed[text_hash] == found["found_hash"]), "left")
    rows = rows.select(*[c for c in docs.columns if c != "text"], F.col(text), F.col("found").alias(windows))
    kept = [f for f in rows.schema.fields if f.name not in (text, windows)]
    made = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, removed array<struct<first: long, last: long>>, kept binary")
    return map_arrow(rows, _applied(length), StructType(kept + made.fields))
