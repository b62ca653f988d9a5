"""Line deduplication with levelled sorted runs of line hashes, with DataFrame operations only.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of some length
that are found in enough documents lose their lines everywhere but in the largest document id.

Documents come in batches, largest ids first. ``LineRuns`` keeps what is known of the keys as
*runs*: tables of (hash, owner, documents), bucketed and sorted by hash. A run is written once
and never changed. Each new batch is merge-anti-joined with the runs: keys that a run already
knows to be in enough documents have nothing to add, the others become the batch's own run.
Whenever ``FAN`` runs of a level have come together they are merged into one of the next level,
so the number of runs stays logarithmic in the number of batches. Runs and batches have
the same buckets, so a join does not shuffle a run again.

The runs in the end say which keys lose their lines; the lines of all documents are joined with
these keys only, and a document's text is cut where lines go.

Hot lines: counts are added up before they are shuffled, and once a line is settled no
later batch writes it again. Joins of single lines with the keys are split by Spark where a key
is hot (every key is there once); texts are never shuffled by line.

Defined cases: a null text is one empty line; a null id is smaller than all others; every row
counts as a document, so equal rows are several; if the largest id that holds a key is
repeated, all its rows keep their lines; an empty table gives an empty result; of other
columns, those named like the results are replaced. Hashes have 128 bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphwarden.llm.common import delete_folder, discard, store
from glyphwarden.session import fresh_folder

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
#: Parts of one table, and runs of a level that are merged. Both change the work only.
BATCHES = 4
FAN = 2

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NULL_ID = -(1 << 63)
_HASH = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(bare.rlike("[A-Z]"), F.translate(bare, _UPPER, _LOWER)).otherwise(bare)


def long_keys(least_chars: int) -> Column:
    """The key of each line; null where it is too short."""
    def key(line: Column) -> Column:
        bare = line_key(line)
        return F.when(F.char_length(bare) >= least_chars, bare)

    return F.transform(lines_of(F.col("text")), key)


def hashed(key: str) -> list[Column]:
    return [F.xxhash64(F.col(key)).alias("h1"), F.xxhash64(F.lit(1), F.col(key)).alias("h2")]


def document_columns() -> list[Column]:
    """The id as it is compared, and what tells rows of one id apart."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"),
        F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"),
    ]


class LineRuns:
    """What is known of line keys, as levels of sorted runs (``h1``, ``h2``, ``owner``, ``documents``)."""

    def __init__(self, spark: SparkSession, least_documents: int = LEAST_DOCUMENTS, fan: int = FAN, buckets: int | None = None):
        self.spark, self.least, self.fan = spark, least_documents, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).format("parquet")
        writer.option("path", fresh_folder(self.spark, "line-run")).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        files = self.spark.table(name)
        discard(files)
        self.spark.sql(f"DROP TABLE {name}")

    def _merged(self, runs: list[str]) -> DataFrame:
        """Runs have the same buckets and each key once, so this is a merge of sorted files."""
        merged = self.spark.table(runs[0])
        for name in runs[1:]:
            other = self.spark.table(name).select(*_HASH, F.col("owner").alias("_owner"), F.col("documents").alias("_documents"))
            merged = merged.join(other, _HASH, "full_outer").select(
                *_HASH, F.greatest("owner", "_owner").alias("owner"),
                (F.coalesce("documents", F.lit(0)) + F.coalesce("_documents", F.lit(0))).alias("documents"),
            )
        return merged

    def add(self, sightings: DataFrame) -> None:
        """Take in a batch (``h1``, ``h2``, ``doc``, one row per key and document) of smaller ids than any before."""
        own = sightings.groupBy(*_HASH).agg(F.max("doc").alias("owner"), F.count("*").alias("documents"))
        for name in self.runs():
            own = own.join(self.spark.table(name).filter(F.col("documents") >= self.least), _HASH, "left_anti")
        self._place(self._write(own), 0)

    def _place(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fan:
            runs, self.levels[level] = self.levels[level], []
            merged = self._write(self._merged(runs))
            for run in runs:
                self._drop(run)
            self._place(merged, level + 1)

    def runs(self) -> list[str]:
        """Largest first: they settle most keys."""
        return [name for level in reversed(self.levels) for name in level]

    def settled(self) -> DataFrame:
        """The keys found in enough documents, with the largest id that holds them; stored."""
        return store(self._merged(self.runs()).filter(F.col("documents") >= self.least).drop("documents"), "settled-lines")

    def drop(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = []


def _batched(sightings: DataFrame, documents: DataFrame, batches: int) -> DataFrame:
    """Add the number of the batch: ranges of the id, largest first, nulls last."""
    shares = [i / batches for i in range(1, batches)]
    bounds = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares).alias("b")).first()["b"] or []
    number = F.lit(0)
    for bound in set(bounds):
        number = number + F.when(F.col("doc") <= bound, 1).otherwise(0)
    return sightings.withColumn("batch", number)


def repeated_lines(
    documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES
) -> DataFrame:
    """The keys (``h1``, ``h2``) that lose their lines, with their ``owner``."""
    spark = documents.sparkSession
    keys = documents.select("doc_id", F.explode(F.array_distinct(F.array_compact(long_keys(least_chars)))).alias("key"))
    sightings = keys.select(*hashed("key"), document_columns()[0])
    batched = _batched(sightings, documents, batches)
    path = fresh_folder(spark, "line-sightings")
    batched.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(batched.schema).parquet(path)
    runs = LineRuns(spark, least_documents)
    for number in range(batches):
        runs.add(stored.filter(F.col("batch") == number).drop("batch"))
    settled = runs.settled()
    runs.drop()
    delete_folder(spark, path)
    return settled


def without_lines(text: Column, gone: Column) -> Column:
    """The lines that stay, joined; ``gone`` has the sorted numbers (from 0) of those that go.

    The text is put together from the stretches between them.
    """
    parts = F.array(F.struct(lines_of(text).alias("lines"), gone.alias("gone")))

    def kept(p: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(p["gone"], lambda i: i + 1))
        ends = F.concat(p["gone"], F.array(F.size(p["lines"])))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(p["lines"], a + 1, b - a))), "\n")

    return F.element_at(F.transform(parts, kept), 1)


def dedupe_lines(
    documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES
) -> DataFrame:
    """Every row with its text less the dropped lines, plus n_lines and n_dropped."""
    settled = repeated_lines(documents, least_chars, least_documents, batches)
    lines = documents.select(*document_columns(), F.posexplode(long_keys(least_chars)).alias("line", "key")).filter("key is not null")
    later = lines.select("doc", "t1", "t2", "line", *hashed("key")).join(settled, _HASH).filter(F.col("doc") < F.col("owner"))
    gone = later.groupBy("doc", "t1", "t2").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    kept = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    rows = documents.select(F.struct(*kept).alias("_row"), "text", *document_columns())
    joined = rows.join(gone, ["doc", "t1", "t2"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.col("gone")))
    others = [F.col("_row")[c].alias(c) for c in kept if c != "text"]
    return joined.select(
        *others, text.alias("text"), F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
