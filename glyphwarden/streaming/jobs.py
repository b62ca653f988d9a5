"""The online side as Structured Streaming jobs.

Every job writes each micro-batch under its own ``batch=<id>`` folder with overwrite, so
a batch that is run again after a failure replaces its own output and nothing else. Counts that
change are kept as the newest row per key (``keyed_log``), badges with a state store per
user (``badge_state``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphwarden import rules
from glyphwarden.operators import badges, documents as scans
from glyphwarden.session import fresh_folder
from glyphwarden.streaming import badge_state
from glyphwarden.streaming.keyed_log import COMPACT_EVERY, KeyedLog


def _holds_folders(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern meets folders of files, as tables of several files are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return any(status.isDirectory() for status in found or [])


def read_stream(spark: SparkSession, folder: str, file_name: str, max_files: int | None = None) -> DataFrame:
    """The parquet files of a name in a folder as a stream; the schema comes from the files already there.

    A name may stand for a single file or for a folder of part files.
    """
    path, named = (f"{folder}/{file_name}", {}) if _holds_folders(spark, f"{folder}/{file_name}") else (folder, {"pathGlobFilter": file_name})
    schema = spark.read.options(**named).parquet(path).schema
    reader = spark.readStream.schema(schema).options(**named)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_batches(stream: DataFrame, checkpoint: str, output_mode: str, write: Callable[[DataFrame, int], None]) -> None:
    """Process what is there, micro-batch by micro-batch, then stop."""
    query = (
        stream.writeStream.outputMode(output_mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def run_available(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append the rows of each micro-batch in a folder of its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    run_batches(stream, checkpoint, "append", write)


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    return fresh_folder(spark, name), fresh_folder(spark, f"{name}-checkpoint")


def scan_stream(documents: DataFrame, target: str, checkpoint: str) -> None:
    """Scan every arriving document and append its result."""
    run_available(scans.scan_plain(documents), target, checkpoint)


def counter_log(spark: SparkSession, target: str, compact_every: int = COMPACT_EVERY) -> KeyedLog:
    return KeyedLog(spark, target, ["user_id"], compact_every)


def counter_stream(records: DataFrame, target: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> None:
    """Keep scan_count, threat_count and formats per user; a batch reads and writes the users it touches."""
    log = counter_log(records.sparkSession, target, compact_every)
    run_batches(badges.user_counters(records), checkpoint, "update", log.write)


def latest_counters(spark: SparkSession, target: str) -> DataFrame:
    """Current counters: each user's row of the last batch that changed them."""
    return counter_log(spark, target).latest()


def trend_log(spark: SparkSession, target: str, compact_every: int = COMPACT_EVERY) -> KeyedLog:
    return KeyedLog(spark, target, ["user_id", "day"], compact_every)


def daily_trend_stream(
    records: DataFrame, target: str, checkpoint: str, delay: str = "1 day", compact_every: int = COMPACT_EVERY
) -> None:
    """Daily counts per user, open days included: a batch replaces the rows (user, day) that it changes.

    A day's counts leave the state store once the watermark has passed its end by ``delay``; scans
    that arrive later than that are not counted any more.
    """
    timed = records.withColumn("ts", F.col("created_at").cast("timestamp")).withWatermark("ts", delay)
    daily = timed.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict") == "BLOCKED").alias("blocked"),
        F.count_if(F.col("verdict") == "ALLOWED").alias("allowed"),
    )
    flat = daily.select("user_id", F.to_date("w.start").alias("day"), "total", "blocked", "allowed")
    run_batches(flat, checkpoint, "update", trend_log(records.sparkSession, target, compact_every).write)


def latest_trend(spark: SparkSession, target: str) -> DataFrame:
    """Current daily counts of every user and day that had a scan."""
    return trend_log(spark, target).latest()


def badge_stream(
    records: DataFrame, target: str, checkpoint: str, milestones: dict[str, int] = rules.SCAN_MILESTONES
) -> None:
    """Emit each badge once per user, at the scan that first meets its condition.

    What users bring along is in the state store of the checkpoint; a batch reads the state of the
    users it touches.
    """
    run_available(badge_state.awards(records, milestones), target, checkpoint)
