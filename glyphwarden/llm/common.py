"""What the operators of this folder share: word pattern, row keys, stored steps, distributed ranks."""

from __future__ import annotations

import gc
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glyphwarden.session import fresh_folder

WORD = r"[^\x20\x09-\x0D]+"
MAX_LONG = (1 << 63) - 1


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_key(column: Column) -> Column:
    """The id as it is compared: a null id comes after every other."""
    return F.coalesce(column.cast("long"), F.lit(MAX_LONG))


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id apart (repeated ids with other texts; very many texts may share a null id)."""
    return F.xxhash64(text)


_recorded: list[list[str]] = []


@contextmanager
def recorded_steps():
    """The folders of all steps that are stored within the block, for ``discard_steps`` once their reader is done."""
    folders: list[str] = []
    _recorded.append(folders)
    try:
        yield folders
    finally:
        _recorded.remove(folders)


def discard_steps(spark: SparkSession, folders: list[str]) -> None:
    while folders:
        delete_folder(spark, folders.pop())


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: it is computed once and survives lost executors.

    The shuffle files behind a stored step are not needed any more. Spark drops them when the
    driver has collected its garbage, which may be long after; so that is asked for here.
    """
    spark, schema = df.sparkSession, df.schema
    path = fresh_folder(spark, name)
    for folders in _recorded:
        folders.append(path)
    df.write.parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stored step that nothing reads any more."""
    for place in {file.rpartition("/")[0] for file in df.inputFiles()}:
        delete_folder(df.sparkSession, place)


def ranked(rows: DataFrame, group: str, bucket: str, order: list, rank: str, total: str) -> DataFrame:
    """Add the rank (from 0) of each row within its group and the group's size, without gathering a group.

    Rows are ordered by (bucket, order); a bucket is a coarse, order-preserving key. Only the
    counts of the buckets meet per group; rows are sorted within their bucket. ``rows`` is read
    twice, so it should be a stored step.
    """
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, bucket).agg(F.count("*").alias("_count"))
    offsets = counts.select(
        group, bucket, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"),
        F.sum("_count").over(Window.partitionBy(group)).alias(total),
    )
    inside = Window.partitionBy(group, bucket).orderBy(*order)
    return rows.join(offsets, [group, bucket]).withColumn(
        rank, F.col("_before") + F.row_number().over(inside) - 1
    ).drop("_before")
