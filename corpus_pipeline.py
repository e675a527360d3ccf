"""A training-data pipeline over `documents`: five stages, each on all that the one before it kept.

A stage's result is lazy: write it before the next stage starts in the same thread, which deletes the scratch tables behind it.

Defined results, for every stage: a null, empty or blank text is a document without words, which no stage but the mixing
(nothing to take) removes, and the packing gives it its end id alone; texts are read whole, however long; rows with null or
repeated ids are documents of their own; equal rows fall to the n-gram stage, which keeps one; ties are settled by id, then
by a hash; columns of any name besides doc_id, text and source pass through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import common, line_dedup, mixing, ngram_join, packing, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_own = threading.local()


def _stage(f: Stage) -> Stage:
    """Deletes what earlier stages of this thread left in the scratch folder: their results are written elsewhere by now."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _own.__dict__.setdefault("left", [])
        while left:
            common.drop_path(spark, left.pop())
        with common.recorded(spark, left):
            return f(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("toxic_predicted = 0").select(*docs.columns)


def _without_repeats(docs: DataFrame, min_docs: int) -> DataFrame:
    """Lines of 30 characters or more that min_docs documents or more have stay in the first of these; a document of which nothing is left goes."""
    got = line_dedup.dedup(docs, min_docs=min_docs, min_chars=30, keep="first")
    got = got.where(~((F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that 10 documents or more have stay in the first of these."""
    return _without_repeats(docs, 10)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those that share 80 % of their five-word shingles; then lines that 2 documents or more still have stay in the first.

    Before, lines of 2 documents would leave near copies as scraps that are no near copies any more.
    """
    return _without_repeats(common.materialize(ngram_join.distinct_documents(docs, words=5, percent=80), "distinct"), 2)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for."""
    return mixing.mix(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences of 1024 tokens."""
    pieces, places = packing.pack(docs)
    return pieces.select("piece_id", "doc_id", "piece", "start", "length").join(places, "piece_id").select("doc_id", "piece", "start", "length", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the trained model nor the packing; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            common.drop_path(spark, f"{folder}/{k - 1}")
    return docs
