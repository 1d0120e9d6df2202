"""From raw documents to token ids: quality filter, line dedup, near-dedup, decontamination, BPE.

Each stage reads all that its predecessor kept, and each but the last returns the columns of
documents. A stage with an empty table, null columns or repeated rows behaves as its operator
in groundgrid.llm does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundgrid.llm import bpe, decontaminate, lines, quality, simhash
from groundgrid.llm.common import crc_mod, cut


def _on_own_names(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) while the columns but doc_id and text bear names that no operator's result has."""
    own = [c if c in ("doc_id", "text") else f"own_{i}" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*own)).select(*(F.col(o).alias(c) for o, c in zip(own, docs.columns)))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at 0.7 or more; it learns from labels of which crc32(doc_id) mod 4 is not 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, crc_mod(F.col("doc_id"), 4) != 2)
    return _on_own_names(docs, lambda d: quality.score(d, model).where("score >= 0.7"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines of 10 code points or more stay in the smallest doc_id that holds them; a document that had text and loses all of it goes.

    n_chars and other columns stay as they were read, here and in decontamination.
    """
    left = (F.col("n_dropped") == 0) | (F.btrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) != "")
    return _on_own_names(docs, lambda d: lines.drop_repeated_lines(d).where(left))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: SimHash's links, each checked for similarity 0.8 of five-word shingles, and the ones that fingerprints miss by an exact join."""
    return simhash.keep_one(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items (10 words, or a whole shorter item)."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip): token ids of each text, and whether they decode to it."""
    done = bpe.decode(cut(bpe.encode(docs.select("doc_id", "text"))))  # two passes, so that one codec a core is in memory
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: A trained classifier, near copies by Jaccard similarity and BPE can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
