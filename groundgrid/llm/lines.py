"""Line dedup (6): the first document of a repeated line keeps it."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, cut, fresh, map_arrow


def _first_occurrences(batches):
    """Stream rows sorted by (h1, h2, doc, pos). Out: kind 0, a row of a later document than its
    line's first; kind 1, a row of the partition's first line, which may begin in an earlier
    partition; kind 2, the first document here of the partition's first and last line."""
    head = last = None  # (h1, h2) of the partition's first line; (h1, h2, null, doc) of the line that goes on
    heads = []

    def out(cols):
        return pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "id_null", "doc_id", "text_hash", "pos", "kind"])

    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h1, h2, gone, doc, th, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        new = np.ones(n, bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if last and (h1[0], h2[0]) == last[:2]:
            new[0] = False
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1  # -1: goes on from the batch before
        first_gone, first_doc = np.empty(n, gone.dtype), np.empty(n, doc.dtype)
        on = run >= 0
        first_gone[on], first_doc[on] = gone[start][run[on]], doc[start][run[on]]
        if not on.all():
            first_gone[~on], first_doc[~on] = last[2], last[3]
        if head is None:
            head = (h1[0], h2[0])
            heads.append((h1[0], h2[0], gone[0], doc[0]))
        opened = (h1 == head[0]) & (h2 == head[1])
        take = opened | (doc != first_doc) | (gone != first_gone)
        if take.any():
            yield out([pa.array(x[take]) for x in (h1, h2, gone, doc, th, pos)] + [pa.array(opened[take].astype("int32"))])
        last = (h1[-1], h2[-1], first_gone[-1], first_doc[-1])
    if last:
        heads.append(last)
        cols = [np.array([x[i] for x in heads]) for i in range(4)]
        zero = np.zeros(len(heads), "int64")
        yield out([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype("int32")), pa.array(cols[3].astype("int64")), pa.array(zero), pa.array(zero.astype("int32")), pa.array(np.full(len(heads), 2, "int32"))])


def _pack(n_lines, dropped):
    import pandas as pd

    made = []
    for n, lost in zip(n_lines, dropped):
        keep = np.ones(int(n), bool)
        keep[np.asarray(lost, "int64")] = False
        made.append(zlib.compress(np.packbits(keep).tobytes(), 1))
    return pd.Series(made, dtype=object)


def _apply(batches):
    for b in batches:
        texts, maps = b.column("text").to_pylist(), b.column(b.num_columns - 1).to_pylist()
        for i, (t, m) in enumerate(zip(texts, maps)):
            if m is not None:
                lines = t.split("\n")
                keep = np.unpackbits(np.frombuffer(zlib.decompress(m), "uint8"), count=len(lines))
                texts[i] = "\n".join(x for x, k in zip(lines, keep) if k)
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string())).select(range(b.num_columns - 1))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Bitmaps (doc_id, text_hash, n_dropped, keep) of the documents that lose a line.

    A line's key is the line stripped of ASCII white space at both ends with A-Z lower-cased.
    Keys of at least min_chars code points that several documents hold stay in the smallest
    doc_id only. keep: one bit a line, packed and deflated; documents without a row keep all.
    The hashes (128 bits) are range-partitioned with document and position in the range key,
    so that a line that a third of all rows hold spreads over many partitions; where it crosses
    a border, one row per partition tells the next ones its first document.

    Null text is one empty line. Rows of one doc_id are one document, also with different
    texts (told apart by text_hash) or repeated; null doc_ids count as one document after all
    others. An empty table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", ascii_lower(F.btrim("line", F.lit(SPACE)))).where(F.char_length("key") >= min_chars)
    rows = lines.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.col("doc_id").isNull().cast("int").alias("id_null"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text_hash", "pos",
    )
    order = ["h1", "h2", "id_null", "doc_id", "text_hash", "pos"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(map_arrow(ranged, _first_occurrences, "h1 long, h2 long, id_null int, doc_id long, text_hash long, pos int, kind int"))
    first = found.where("kind = 2").groupBy("h1", "h2").agg(F.min(F.struct("id_null", "doc_id")).alias("first"))
    # At most two rows for each partition of the range exchange, however large the input.
    opened = found.where("kind = 1").join(F.broadcast(first), ["h1", "h2"]).where(F.struct("id_null", "doc_id") != F.col("first"))
    dropped = found.where("kind = 0").select("id_null", "doc_id", "text_hash", "pos").union(opened.select("id_null", "doc_id", "text_hash", "pos"))
    per_doc = dropped.groupBy("id_null", "doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))
    doc_id = F.when(F.col("id_null") == 0, F.col("doc_id")).alias("doc_id")
    sizes = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.size(F.split(text, "\n", -1)).alias("n_lines"))
    sizes = sizes.select(F.col("doc_id").isNull().cast("int").alias("id_null"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "text_hash", "n_lines").distinct()
    pack = F.pandas_udf(_pack, "binary")
    both = sizes.join(per_doc, ["id_null", "doc_id", "text_hash"])
    return both.select(doc_id, "text_hash", F.size("dropped").cast("long").alias("n_dropped"), pack("n_lines", "dropped").alias("keep"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """docs with the bitmaps applied to text, plus n_lines (before) and n_dropped.

    A text of which all lines go becomes empty; a null text stays null. Columns of docs named
    n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    map_id, map_hash, own_hash, keep = fresh(docs, "map_id", "map_hash", "text_hash", "keep")
    maps = keep_bitmaps(docs, min_chars).toDF(map_id, map_hash, "n_dropped", keep)
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("n_lines", F.size(F.split(text, "\n", -1)).cast("long")).withColumn(own_hash, F.xxhash64(text))
    rows = rows.join(maps, rows["doc_id"].eqNullSafe(maps[map_id]) & (rows[own_hash] == maps[map_hash]), "left").drop(map_id, map_hash, own_hash)
    rows = rows.withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long")).select(*docs.columns, "n_lines", "n_dropped", keep)
    return map_arrow(rows, _apply, rows.drop(keep).schema)
