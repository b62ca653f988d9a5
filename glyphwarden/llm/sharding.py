"""Sharding: proportional stratified interleaving, with DataFrame operations only.

Rows are shuffled within their source by a seeded hash of id and text and ranked; the fractional rank
(rank - 1/2) / (rows of the source) spreads every source evenly over (0, 1). Sorting all
rows by it and cutting the order into equal pieces gives shards that each hold every
source in proportion (to within one row) and whose counts differ by one at most.

Hot sources: ranks are counts of hash buckets plus a rank within one bucket, so neither a
source nor the whole table is ever sorted in one task.

Defined cases: a null text counts as the empty text; null sources are a source of their
own; rows with null or repeated ids are rows like any other, and fully equal rows take
interchangeable places; an empty table gives an empty result; other columns are ignored by
``shard_rows`` and kept by ``shard_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwarden.llm.common import discard, ranked, store

#: Leading hexadecimal digits of the shuffle hash that make a bucket, and cells of the
#: fractional order. They change the size of the tasks, never the result.
BUCKET_DIGITS = 3
CELLS = 4096


def source_key(source: Column) -> Column:
    """Sources by code point, the null source last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def shuffle_key(seed: str) -> Column:
    """The seeded hash that rows are shuffled by: of id and text, so that rows without id or of one id spread."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64("text").cast("string")))


def interleaved(rows: DataFrame, shards: int) -> DataFrame:
    """Add shard and slot to stored rows (used up here) that have ``_source``, ``_shuffle`` (hash) and ``_tie`` (struct)."""
    by_source = ranked(
        rows.withColumn("_bucket", F.substring("_shuffle", 1, BUCKET_DIGITS)), "_source", "_bucket",
        ["_shuffle", "_tie"], "_rank", "_of",
    )
    fraction = (F.col("_rank") + 0.5) / F.col("_of")
    placed = store(
        by_source.withColumn("_fraction", fraction).withColumn("_cell", F.floor(F.col("_fraction") * CELLS))
        .withColumn("_all", F.lit(0)).drop("_bucket", "_rank", "_of"),
        "interleaved",
    )
    discard(rows)
    ordered = ranked(placed, "_all", "_cell", ["_fraction", "_source", "_shuffle", "_tie"], "_place", "_rows")
    shard = F.expr(f"_place * {shards} div _rows")
    # The first place of a shard: the least p with p * shards >= shard * rows.
    return ordered.withColumn("shard", shard.cast("int")).withColumn(
        "slot", F.col("_place") - F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
    ).drop("_all", "_cell", "_fraction", "_place", "_rows")


def shard_rows(documents: DataFrame, shards: int = 40, seed: str = "shards") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = store(
        documents.select(
            "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            source_key(F.col("source")).alias("_source"),
            shuffle_key(seed).alias("_shuffle"),
        ).withColumn("_tie", F.struct("size", "text_crc32")),
        "shard-rows",
    )
    return interleaved(rows, shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def shard_documents(documents: DataFrame, shards: int = 40, seed: str = "shards") -> DataFrame:
    """All columns of every row, plus shard and slot (which replace columns of these names)."""
    kept = [c for c in documents.columns if c not in ("shard", "slot")]
    rows = store(
        documents.select(
            F.struct(*kept).alias("_row"), source_key(F.col("source")).alias("_source"),
            shuffle_key(seed).alias("_shuffle"),
            F.struct(F.xxhash64("text")).alias("_tie"),
        ),
        "shard-documents",
    )
    return interleaved(rows, shards).select("_row.*", "shard", "slot")
