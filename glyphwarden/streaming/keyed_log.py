"""The newest row of every key, as a snapshot and the batches since.

A stream in update mode writes the rows it has changed, batch by batch, under ``batch=<id>``.
Every few batches snapshot and batches are merged into the next ``snapshot=<id>`` and what went
into it is deleted, so that a reader never opens more than one snapshot and a few batches,
however long the stream has run.

Everything can be repeated: a batch overwrites its own folder; a snapshot counts once its writer
has left ``_SUCCESS``; folders are deleted only behind such a snapshot; and rows of a batch that
is written once more after it went into a snapshot are the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

COMPACT_EVERY = 10


class KeyedLog:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.keys, self.every = spark, path.rstrip("/"), keys, compact_every

    # ------------------------------------------------------------ folders

    def _place(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the complete folders ``<kind>=<number>``."""
        root, files = self._place()
        if not files.exists(root):
            return []
        names = [status.getPath().getName() for status in files.listStatus(root)]
        numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
        return [n for n in numbers if files.exists(self._place(f"{kind}={n}/_SUCCESS")[0])]

    def _delete(self, name: str) -> None:
        path, files = self._place(name)
        files.delete(path, True)

    # ------------------------------------------------------------ writing

    def write(self, rows: DataFrame, batch: int) -> None:
        """Take in the changed rows of a batch (one per key)."""
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if (batch + 1) % self.every == 0:
            self.compact(batch)

    def compact(self, upto: int) -> None:
        """Merge the snapshot and all batches up to ``upto`` into a new snapshot."""
        merged = self.latest(upto)
        if merged is None:
            return
        snapshots = self._numbers("snapshot")
        if upto not in snapshots:
            merged.write.mode("overwrite").parquet(f"{self.path}/snapshot={upto}")
        for old in snapshots:
            if old < upto:
                self._delete(f"snapshot={old}")
        for batch in self._numbers("batch"):
            if batch <= upto:
                self._delete(f"batch={batch}")

    # ------------------------------------------------------------ reading

    def parts(self, upto: int | None = None) -> list[tuple[int, str]]:
        """(order, folder) of the newest snapshot and the batches behind it."""
        snapshots = [n for n in self._numbers("snapshot") if upto is None or n <= upto]
        since = max(snapshots, default=-1)
        batches = [n for n in self._numbers("batch") if n > since and (upto is None or n <= upto)]
        return [(since, f"{self.path}/snapshot={since}")] * (since >= 0) + [(n, f"{self.path}/batch={n}") for n in batches]

    def latest(self, upto: int | None = None) -> DataFrame | None:
        """The newest row of each key; None if nothing has been written."""
        parts = self.parts(upto)
        if not parts:
            return None
        frames = [self.spark.read.parquet(folder).withColumn("_order", F.lit(order)) for order, folder in parts]
        log = frames[0]
        for frame in frames[1:]:
            log = log.unionByName(frame)
        columns = [c for c in log.columns if c not in (*self.keys, "_order")]
        newest = F.max_by(F.struct(*columns), "_order").alias("_row")
        return log.groupBy(*self.keys).agg(newest).select(*self.keys, "_row.*")
