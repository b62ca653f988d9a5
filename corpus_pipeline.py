"""Training-data pipeline: quality, near duplicates, benchmark leaks, mixture, shards."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from glyphwarden.llm import decontamination, mixing, ngram_join, quality, sharding
from glyphwarden.llm.common import delete_folder, discard_steps, recorded_steps
from glyphwarden.session import apply_settings, fresh_folder

#: Folders of what the stage before has stored on its way. Its rows are written and read again before the next
#: stage starts, so that these are used up then.
_used_up: list[str] = []


def stage(function):
    """A stage that first deletes the intermediate steps of the one before.

    Stages run in sessions made elsewhere, whose Arrow batches may hold ten thousand whole texts, in the executor and
    in Python each; the library's settings bound them.
    """

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_settings(spark)
        discard_steps(spark, _used_up)
        with recorded_steps() as folders:
            rows = function(spark, docs, sf_dir)
        _used_up.extend(folders)
        return rows

    return run_stage


@stage
def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the trusted target are the documents labelled good."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8 or more)."""
    return ngram_join.keep_first(docs)


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.mix_documents(docs)


@stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality rules", rate), ("near duplicates", dedupe), ("benchmark decontamination", decontaminate), ("source mix", mix),
    ("shards", shard),
]

#: SQL cannot express the hashed scores of the first stage; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, run_stage in STAGES:
        path = fresh_folder(spark, "pipeline-" + name.replace(" ", "-"))
        run_stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    discard_steps(spark, _used_up)
    return docs
