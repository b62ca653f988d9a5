"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A table of more splits is never shuffled for the sake of more tasks, whatever the cluster has.
MOST_SPREAD_SPLITS = 16


def read_spread(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table whose rows are expensive to process, spread over all cores if it is small.

    A scan of a few splits (small files, one row group) is hash-partitioned by its key; a larger
    scan keeps its splits and its text is not shuffled.
    """
    table = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= min(cores, MOST_SPREAD_SPLITS):
        return table
    return table.repartition(cores, key)
