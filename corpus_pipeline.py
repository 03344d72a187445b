"""The corpus pipeline: quality, near copies, repeated passages, mixture, tokens.

Each stage takes the rows that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import bpe, mixing, ngram_join, quality_fm, spans
from gridcast.llm.store import settle, small_batches

# Entries of a worker's memo in the last stage, which shares its executor with what the others left in the heap.
MEMO = 100_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.  It learns from ``docs`` and their labels.

    Null and empty texts are scored like others; rows with null or repeated ids are judged one by one.
    """
    small_batches(spark)
    machine = quality_fm.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.keep_good(docs, machine, threshold=0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by runs of five words at a similarity of 0.8 or more.

    The smallest id stays; rows without id, and texts without words, link with nothing and stay.
    """
    small_batches(spark)
    return ngram_join.one_of_each(docs, 80, 100, 5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences that an earlier one has in the same run; n_chars follows the text.

    Every row is a document of its own, also with a null or repeated id; no row goes.
    """
    small_batches(spark)
    return spans.dedup_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target weights choose, each once: an epoch at most, so that ids stay unique.

    Null languages and sources are leaves of their own; texts without words cost nothing.
    """
    return mixing.repeated(mixing.mix(docs, share=0.6, epochs=1, seed=17))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text that they decode to.

    A null text is an empty one.  Empty tables give empty ones at every stage.
    """
    small_batches(spark)
    return bpe.round_trip(docs, entries=MEMO)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", passages),
    ("source mixture", mixture),
    ("byte-level BPE", tokens),
]
# The classifier is not a thing of SQL; stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
