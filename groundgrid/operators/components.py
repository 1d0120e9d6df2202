"""Connected components of pixel sets: row runs, edges between rows' runs, and a contraction of the run graph."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .tiles import blocks, codes

_own: list[str] = []


def new_path(spark: SparkSession) -> str:
    """A path not in use yet in the folder of spark.checkpoint.dir; a temporary folder only where that is unset and Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = _own[0]
    return f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch: with a bound, Spark adds up its buffers after every row, which costs pixels three times the rest.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def sized(spark: SparkSession) -> None:
    """Let Spark, for this session, take a row of a compressed file for what it needs in memory (about 3 bytes of a pixel are 100 in a broadcast), unless the setting was changed.

    Batches of pixels are bounded by rows alone; what sends whole files sets its own bound of bytes.
    """
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name)) == 1:
        spark.conf.set(name, "30")
    spark.conf.set(BATCH_BYTES, str(2**31 - 1))


def exploded(df: DataFrame) -> DataFrame:
    """df, of which a row was made many: Spark takes it to be as small as what it was made of, so joins must not broadcast it."""
    return df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, which cuts its lineage."""
    spark = df.sparkSession
    sized(spark)
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partial_runs(pixels: DataFrame, by: tuple[str, ...] = ("raster_id",), tops: bool = False) -> DataFrame:
    """Horizontal runs (by, y, x0, x1) of the pixels that a task has read together: whole runs, or parts of them that share no pixel. Nothing is shuffled.

    With tops, the largest v of each and the first x that has it (v, x).
    """
    best = [pixels.schema[c] for c in ("v", "x")] if tops else []
    kind = StructType([*[pixels.schema[c] for c in (*by, "y")], *[StructField(c, pixels.schema["x"].dataType) for c in ("x0", "x1")], *best])

    def join(table: pa.Table) -> pa.Table:
        places = [table.column("x").to_numpy(), table.column("y").to_numpy(), *[codes(table.column(c)) for c in by]]
        order = np.lexsort(places)
        x, *row = (k[order] for k in places)
        follows = np.logical_and.reduce([x[1:] <= x[:-1] + 1, *[k[1:] == k[:-1] for k in row]])
        first = np.flatnonzero(np.append(True, ~follows))
        out = table.select([*by, "y"]).take(pa.array(order[first])).combine_chunks()
        out = out.append_column("x0", pa.array(x[first])).append_column("x1", pa.array(x[np.append(first[1:], len(x)) - 1]))
        if tops:
            v, null = table.column("v").to_numpy()[order].astype("float64"), table.column("v").is_null().to_numpy()[order]
            v = np.where(null, -np.inf, np.where(np.isnan(v), np.inf, v))
            high = np.maximum.reduceat(v, first)[np.cumsum(np.append(True, ~follows)) - 1]
            at = order[np.minimum.reduceat(np.where(v == high, np.arange(len(v)), len(v)), first)]
            out = out.append_column("v", table.column("v").take(pa.array(at))).append_column("x", table.column("x").take(pa.array(at)))
        return out

    there = pixels.select(*by, "y", "x", *["v"][: int(tops)]).where("y IS NOT NULL AND x IS NOT NULL")
    return there.mapInArrow(lambda batches: (b for t in blocks(batches) for b in join(t).to_batches()), kind)


def runs(pixels: DataFrame, by: tuple[str, ...] = ("raster_id",), tops: bool = False) -> DataFrame:
    """Maximal horizontal runs (by, y, x0, x1) of marked pixels; with tops, the largest v of each and the first x that has it (v, x).

    A task joins the pixels that it reads first, so parts of runs are shuffled, not pixels.
    """
    w = Window.partitionBy(*by, "y")
    before = F.sum(F.col("x1") - F.col("x0") + 1).over(w.orderBy("x0").rowsBetween(Window.unboundedPreceding, -1))
    islands = partial_runs(pixels, by, tops).withColumn("g", F.col("x0") - F.coalesce(before, F.lit(0)))
    ends = [F.min("x0").alias("x0"), F.max("x1").alias("x1")]
    if not tops:
        return islands.groupBy(*by, "y", "g").agg(*ends).drop("g")
    best = islands.groupBy(*by, "y", "g").agg(*ends, F.max(F.struct("v", (-F.col("x")).alias("less"))).alias("t"))
    return best.select(*by, "y", "x0", "x1", "t.v", (-F.col("t.less")).alias("x"))


def label_runs(pixels: DataFrame, connectivity: int = 8, by: tuple[str, ...] = ("raster_id",), rounds: int = 60) -> DataFrame:
    """Runs with comp_y, comp_x: the smallest (y, x0) of their component, which names it.

    Runs of neighbouring rows that touch (by a corner, too, for 8) are edges of a graph, which
    is contracted: see contracted().
    """
    return label_given(runs(pixels, by), connectivity, by, rounds)


def contracted(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): nodes that hang together share a root.

    Each round every node moves to whichever of itself and its neighbours has the least
    pseudo-random rank, and the edges move along, so the graph shrinks by a constant factor a
    round, whatever its diameter. Moves are put together backwards at the end.
    """
    left = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct())
    moves: list[DataFrame] = []
    while not left.isEmpty():
        if len(moves) == rounds:
            raise RuntimeError("labels of connected components did not settle")
        rank = lambda c, turn=len(moves): F.struct(F.xxhash64(F.lit(turn), c), c.alias("id"))
        best = left.groupBy("a").agg(F.min(rank(F.col("b"))).alias("best"))
        move = written(best.select("a", F.least("best", rank(F.col("a")))["id"].alias("to")))
        moves.append(move)
        ends = move.select(F.col("a").alias("b"), F.col("to").alias("end"))
        left = written(left.join(move, "a").join(ends, "b").select(F.col("to").alias("a"), F.col("end").alias("b")).where("a != b").distinct())
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    out = moves[-1].toDF("node", "root")
    for move in reversed(moves[:-1]):
        further = out.select(F.col("node").alias("to"), "root")
        out = written(move.join(further, "to", "left").select(F.col("a").alias("node"), F.coalesce("root", "to").alias("root")))
    return out


def _parts(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """For runs sorted by (y, x0), the first run of those that hang together with it."""
    y, x0, x1 = (c.astype("int64") for c in (y, x0, x1))
    wide = int(x1.max() - x0.min()) + 4
    at = lambda row, x: (row - y[0]) * wide + x - x0.min() + 1
    low, high = np.searchsorted(at(y, x1), at(y + 1, x0 - reach)), np.searchsorted(at(y, x0), at(y + 1, x1 + reach), "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = low[a] + np.arange(len(a)) - (np.cumsum(n) - n)[a]
    first = np.arange(len(y))
    while len(a):
        less, more = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
        np.minimum.at(first, more, less)
        while not np.array_equal(first, further := first[first]):
            first = further
        apart = first[a] != first[b]
        a, b = a[apart], b[apart]
    return first


def label_given(found: DataFrame, connectivity: int = 8, by: tuple[str, ...] = ("raster_id",), rounds: int = 60, tile: int = 256) -> DataFrame:
    """label_runs over runs (by, y, x0, x1) that are known already.

    Runs are cut at the columns between tiles, and a tile joins its own pieces. Only parts with a
    piece on the border of their tile are nodes of the graph that is contracted, and only their
    pieces are joined with its result.
    """
    reach = 1 if connectivity == 8 else 0
    at = lambda c: F.floor(c / tile).cast("int")
    cut = found.withColumns({"ty": at(F.col("y")), "tx": F.explode(F.sequence(at(F.col("x0")), at(F.col("x1"))))})
    extra = ["p0", "p1", "first_y", "first_x", "back", "open"]

    def join(table: pa.Table) -> pa.Table:
        left = table.column("tx")[0].as_py() * tile
        order = np.lexsort([table.column(c).to_numpy() for c in ("x0", "y")])
        table = table.take(pa.array(order)).combine_chunks()
        y, x0, x1 = (table.column(c).to_numpy() for c in ("y", "x0", "x1"))
        p0, p1 = np.maximum(x0, left), np.minimum(x1, left + tile - 1)
        first = _parts(y, p0, p1, reach)
        border = (y % tile == 0) | (y % tile == tile - 1) | (p0 == left) | (p1 == left + tile - 1)
        opened = np.zeros(len(y), bool)
        opened[first[border]] = True
        # One bit of `open` tells of the part, the other of the piece.
        for name, column in zip(extra, (p0, p1, y[first], p0[first], np.arange(len(y)) - first, opened[first] + 2 * border)):
            table = table.append_column(name, pa.array(column.astype("int64")))
        return table

    kind = StructType([*cut.schema.fields, *[StructField(c, LongType()) for c in extra]])
    # Rows of a tile stay together, so its parts are named by the number of their first row.
    pieces = cut.groupBy(*by, "ty", "tx").applyInArrow(join, kind).withColumn("node", F.monotonically_increasing_id() - F.col("back")).drop("back", "ty")
    pieces = written(pieces)
    edge = pieces.where("open = 3")
    # What a piece looks for: pieces of the next row, and its own run beyond the cut. Pieces lie in one tile, so a pair meets once.
    below = edge.select(*by, (F.col("y") + 1).alias("y"), (F.col("p0") - reach).alias("a0"), (F.col("p1") + reach).alias("a1"), F.col("node").alias("a"), F.explode(F.sequence(at(F.col("p0") - reach), at(F.col("p1") + reach))).alias("tx"))
    beyond = edge.where("p1 < x1").select(*by, "y", (F.col("p1") + 1).alias("a0"), (F.col("p1") + 1).alias("a1"), F.col("node").alias("a"), (F.col("tx") + 1).alias("tx"))
    edges = below.unionByName(beyond).join(edge.select(*by, "y", "tx", "p0", "p1", F.col("node").alias("b")), [*by, "y", "tx"]).where("a0 <= p1 AND p0 <= a1").select("a", "b")
    roots = contracted(edges, rounds)
    named = edge.select("node", F.struct("first_y", "first_x").alias("own")).distinct().join(roots, "node")
    least = named.groupBy("root").agg(F.min("own").alias("least"))
    named = named.join(least, "root").select(F.col("node").alias("n"), "least")
    keep = [c for c in found.columns]
    # The first piece of a run stands for the whole of it.
    whole, opened = (pieces.where("p0 = x0").where(c) for c in ("open = 0", "open > 0"))
    name = [F.col(f"first_{c}").alias(f"comp_{c}") for c in "yx"], [F.coalesce(F.col(f"least.first_{c}"), F.col(f"first_{c}")).alias(f"comp_{c}") for c in "yx"]
    out = whole.select(*keep, *name[0]).union(opened.join(named, F.col("node") == F.col("n"), "left").select(*keep, *name[1]))
    return out.withColumns({"comp_y": F.col("comp_y").cast(found.schema["y"].dataType), "comp_x": F.col("comp_x").cast(found.schema["x0"].dataType)})


def stats(labelled: DataFrame, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """One row per component: left, top, width, height, area, cx, cy."""
    n = F.col("x1") - F.col("x0") + 1
    area = F.sum(n).cast("long")
    return labelled.groupBy(*by, "comp_y", "comp_x").agg(
        F.min("x0").alias("left"), F.min("y").alias("top"), (F.max("x1") - F.min("x0") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), area.alias("area"),
        (F.sum(n * (F.col("x0") + F.col("x1")) / 2) / F.sum(n)).alias("cx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"),
    )


def large_regions(labelled: DataFrame, least: int, least_fat: int, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """(by, comp_y, comp_x, area, fat): components of `least` pixels or more, of which least_fat or more lie in the square at the top left of their box, as wide as its shorter side."""
    box = stats(labelled, by).select(*by, "comp_y", "comp_x", "left", "top", F.least("width", "height").alias("side"), "area")
    inside = F.greatest(F.lit(0), F.least("x1", F.col("left") + F.col("side") - 1) - F.col("x0") + 1)
    box = box.where((F.col("area") >= least) & (F.col("side").cast("long") * F.col("side") >= least_fat))  # others can't be fat enough
    fat = labelled.join(box, [*by, "comp_y", "comp_x"]).groupBy(*by, "comp_y", "comp_x", "area").agg(F.sum(F.when(F.col("y") < F.col("top") + F.col("side"), inside).otherwise(0)).cast("long").alias("fat"))
    return fat.where((F.col("area") >= least) & (F.col("fat") >= least_fat))


def component_pixels(labelled: DataFrame, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    return exploded(labelled.select(*by, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "comp_y", "comp_x"))


def argmax(labelled: DataFrame, by: tuple[str, ...] = ("raster_id",)) -> DataFrame:
    """The highest pixel of each component; ties go to the smallest x, then y. Runs bring theirs along (runs(tops=True)), so no pixel is joined."""
    found = labelled.groupBy(*by, "comp_y", "comp_x").agg(F.max(F.struct("v", -F.col("x"), -F.col("y"))).alias("t"))
    return found.select(*by, "comp_y", "comp_x", F.col("t.v").alias("v"), (-F.col("t.col2")).alias("x"), (-F.col("t.col3")).alias("y"))


def looked_up(points: DataFrame, labelled: DataFrame, how: str = "left", tile: int = 256) -> DataFrame:
    """points with the columns of the run that they (truncated) lie on, but for its ends: joined by row and tile, so no run is listed pixel by pixel."""
    at = lambda c: F.floor(c / tile).cast("int")
    rest = [c for c in labelled.columns if c not in ("raster_id", "y", "x0", "x1")]
    cells = labelled.select(F.col("raster_id").alias("r_"), F.col("y").alias("y_"), F.col("x0").alias("a_"), F.col("x1").alias("b_"), *rest, F.explode(F.sequence(at(F.col("x0")), at(F.col("x1")))).alias("tile_"))
    on = (F.col("raster_id") == F.col("r_")) & (F.floor("y") == F.col("y_")) & (at(F.col("x")) == F.col("tile_")) & F.floor("x").between(F.col("a_"), F.col("b_"))
    return points.join(exploded(cells), on, how).drop("r_", "y_", "a_", "b_", "tile_")
