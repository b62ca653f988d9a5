"""Storing, exporting and erasing scan records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphwarden.operators import history, score


def stored_form(results: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Record rows of identified users, findings in output form and JSON-encoded.

    ``results`` are scanned documents with user_id, stored_format and created_at. Scans
    without a user are answered but never stored.
    """
    known = results.filter(F.col("user_id").isNotNull())
    records = known.select(
        F.col(id_column).alias("id"), "user_id", "filename", F.col("stored_format").alias("file_format"), "verdict",
        "risk_score", "total_pages", "text_length", score.findings_view(F.col("findings")).alias("findings"),
        "threat_summary", "created_at",
    )
    return score.encode_records(records)


def append_records(records: DataFrame, path: str, commit: str) -> None:
    """Add records under a commit key; rows are rebalanced so that big days split.

    The table is ``commit=<key>/scan_date=<day>``. Writing a commit again replaces it, so a batch that is
    repeated after a failure is there once.
    """
    dated = records.withColumn("scan_date", F.to_date("created_at")).hint("rebalance", "scan_date")
    dated.write.mode("overwrite").partitionBy("scan_date").parquet(f"{path}/commit={commit}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return score.decode_records(spark.read.parquet(path).drop("commit"))


def export_records(records: DataFrame, path: str, commit: str) -> None:
    """Indented JSON payloads with their file names, one row per record, under a commit key."""
    history.exported(records).write.mode("overwrite").parquet(f"{path}/commit={commit}")


_PARTITION = ["commit", "scan_date"]


def _partition_names(parts: DataFrame) -> list[tuple[str, str]]:
    """Partitions as they are named in the table; no more than the table has folders."""
    day = F.coalesce(F.col("scan_date").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return [tuple(r) for r in parts.select(F.col("commit").cast("string"), day).distinct().collect()]


def erase_records(spark: SparkSession, path: str, requests: DataFrame, job: str) -> None:
    """Erase the records that users ask for by (id, user_id), rewriting only the partitions that hold one.

    If requests name the ``scan_date``, only these days are looked at. What remains of the partitions is
    staged first and then put in their place, so that an erasure that did not end can be run
    again under the same ``job``, wherever it stopped. Files of other partitions are not touched.
    """
    staged = f"{path}/_erase-{job}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def place(name: str):
        return spark._jvm.org.apache.hadoop.fs.Path(name)

    if not files.exists(place(f"{staged}/rows/_SUCCESS")):
        table = spark.read.parquet(path)
        keys = [c for c in ("scan_date", "id", "user_id") if c in requests.columns]
        named = _partition_names(table.select(*_PARTITION, "id", "user_id").join(requests.select(*keys), keys, "left_semi"))
        if not named:
            return
        touched = spark.read.schema(table.schema).option("basePath", path).parquet(
            *[f"{path}/commit={commit}/scan_date={day}" for commit, day in named]
        )
        spark.createDataFrame(named, "commit string, day string").coalesce(1).write.mode("overwrite").parquet(f"{staged}/partitions")
        survivors = touched.join(requests.select(*keys), keys, "left_anti").hint("rebalance", *_PARTITION)
        survivors.write.mode("overwrite").partitionBy(*_PARTITION).parquet(f"{staged}/rows")
    named = [tuple(r) for r in spark.read.parquet(f"{staged}/partitions").collect()]
    left = {(c, d) for c, d in named if files.exists(place(f"{staged}/rows/commit={c}/scan_date={d}"))}
    if left:
        schema = spark.read.parquet(path).schema
        rows = spark.read.schema(schema).parquet(f"{staged}/rows").hint("rebalance", *_PARTITION)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTITION).parquet(path)
    for commit, day in set(named) - left:
        files.delete(place(f"{path}/commit={commit}/scan_date={day}"), True)
    files.delete(place(staged), True)
