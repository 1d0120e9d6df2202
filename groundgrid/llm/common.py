"""What the corpus operators share: tables written to cut lineage, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The ASCII white space of the contracts: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in this process."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own_dir


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, once nothing that is still to be computed reads them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exploded(df: DataFrame) -> DataFrame:
    """df, of which a row was made many, or whose files hold much in few bytes: Spark takes it to be smaller than it is, so joins must not broadcast it."""
    return df.hint("merge")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, each with as many underscores before it as columns of docs of that name need."""
    taken, made = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        made.append(name)
    return made


def map_arrow(df: DataFrame, run, schema, size: int = 512 << 10) -> DataFrame:
    """df.mapInArrow(run, schema) with record batches of about `size` bytes at most (or one row), for this session, as a row holds a whole text."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) != f"{size}b":
        df.sparkSession.conf.set(name, f"{size}b")
    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def scan(rows: Column, begin: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What a pass over the array emits: step(state, row) gives the next state and an array of `kind`.

    Arrays are copied when they grow, so the pass goes by chunks of the square root of the rows,
    and n rows cost n to the power 1.5 at most instead of the square.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc, row):
        state, new = step(acc["state"], row)
        return F.struct(state.alias("state"), F.concat(acc["out"], new).alias("out"))

    def chunks(r):
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(r))).cast("int"))
        return F.when(F.size(r) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / width).cast("int")), lambda i: F.slice(r, i * width + 1, width))).otherwise(F.slice(F.array(r), F.lit(1), F.lit(0)))

    def chunk(acc, part):
        return F.concat(acc, F.array(F.aggregate(part, F.struct(F.element_at(acc, -1)["state"].alias("state"), none.alias("out")), one)))

    start = F.array(F.struct(begin.alias("state"), none.alias("out")))
    return F.flatten(F.transform(F.aggregate(let(rows, chunks), start, chunk), lambda d: d["out"]))


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of an id's text, modulo n (null for a null id)."""
    return F.crc32(c.cast("string").cast("binary")) % n


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): nodes of one connected component share a root.

    Local contraction: in each round every node moves to the neighbour (or itself) of least
    pseudo-random priority, and the edges are mapped along, which shrinks the graph by a
    constant factor whatever its diameter. Each aggregation is combined before its shuffle,
    and both inputs of each join are shuffled scans, which Spark splits where a key is hot.
    No edges give no rows; self-loops and repeats are allowed, null ends are ignored.
    """
    spark = edges.sparkSession
    half = edges.where(F.col("a") != F.col("b"))
    e = cut(half.select("a", "b").union(half.select(F.col("b"), F.col("a"))).distinct())
    moves = []
    for r in range(rounds):
        if e.isEmpty():
            break
        rank = lambda c, r=r: F.struct(F.xxhash64(F.lit(r), c), c.alias("to"))
        best = e.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        move = cut(best.select(F.col("a").alias("was"), F.least("m", rank(F.col("a")))["to"].alias("now")))
        moves.append(move)
        moved = e.join(move, F.col("a") == F.col("was")).select(F.col("now").alias("a"), "b")
        moved = moved.join(move, F.col("b") == F.col("was")).select("a", F.col("now").alias("b"))
        moved = cut(moved.where("a != b").distinct())
        drop(e)
        e = moved
    else:
        raise RuntimeError("the contraction of components did not end")
    if not moves:
        return spark.createDataFrame([], f"node {edges.schema['a'].dataType.simpleString()}, root {edges.schema['a'].dataType.simpleString()}")
    out = moves[0].select(F.col("was").alias("node"), F.col("now").alias("root"))
    for move in moves[1:]:
        out = out.join(move, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))
    return out
