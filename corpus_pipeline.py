"""A corpus pipeline of five stages: each takes the documents its predecessor kept, written as Parquet and read again.

1. quality: documents that the classifier scores below 0.7 go.
2. line_dedup: lines covered by later occurrences of three-line windows go.
3. near_dedup: of each group of near duplicates the smallest doc_id stays.
4. decontaminate: documents that contain a benchmark item go.
5. encode: one row per document that is left, with its pieces' number and digests.

Stages 1 to 4 return the columns of documents. A stage deletes the working
tables of the one before, whose result has been written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegraph import storage
from lodegraph.llm import decontam, linededup, quality, simhash, subword


def _stage(fn):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.ship(spark)
        storage.release(spark, "pipeline")
        with storage.owner("pipeline"):
            return fn(spark, docs, sf_dir)

    run_stage.__doc__ = fn.__doc__
    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.7."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that later occurrences of repeated windows cover."""
    return linededup.dedup(docs).select(*docs.columns)


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


@_stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, decoded_sha256, round_trip."""
    return subword.encode_and_decode(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("encode", encode_stage),
]

#: The classifier, the fingerprints and the codec have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = storage.materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
