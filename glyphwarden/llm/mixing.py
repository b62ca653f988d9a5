"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / (size of the source) times. The expected
copies are summed up in a fixed order, one offset in [0, 1) is added per source, and a
document is taken once for each integer that its step crosses. As the copies expected are
the same for all documents of a source, the prefix sum is that number times the rank.

Order within a source: by size class (a power of two and its quarter), then by a seeded
hash of id and text. Neighbours have like sizes, so the words taken stay near the target even when some
texts are very long. Ranks are counts of (class, hash prefix) buckets plus a rank inside one
bucket: a hot source is never gathered.

Defined cases: a null or blank text has size 0 and is taken like the others (0 words); a
source whose sizes are all 0 has target 0 and takes nothing; null sources come last as a
source of their own; rows with null or repeated ids are rows like any other; an empty
table gives an empty result. Sizes and targets follow from all rows; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwarden.llm.common import ranked, store, word_count
from glyphwarden.llm.sharding import source_key

MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
_BUCKET_DIGITS = 2


def _hash_fraction(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def size_class(size: Column) -> Column:
    """Two characters for the position of the leading bit, then the two bits behind it."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.rpad(F.substring(bits, 2, 2), 2, "0"))


def targets(sizes: DataFrame, most: int = MOST_COPIES, weights: tuple = WEIGHTS) -> DataFrame:
    """Targets of the sources (``_source``, ``source_size``): one small row per source.

    Where the plain share passes ``most`` times the source's size, the target stops there and
    the excess is shared by weight among the rest, until none is above. The capped sources
    are a prefix of the order by size / weight: source i is capped if what is left, shared over
    the weights from i on, gives it more than its cap.
    """
    everything = Window.partitionBy(F.lit(0))
    position = F.row_number().over(everything.orderBy("_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position % len(weights) + 1).cast("int"))
    weighted = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = everything.orderBy(F.col("_cap") / F.col("_weight"), "_source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = weighted.withColumn("_level", left / F.sum("_weight").over(from_here))
    capped = level.withColumn("_capped", F.col("_level") * F.col("_weight") > F.col("_cap"))
    final = F.min(F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_weight"), "_source", F.col("_level")))).over(everything)
    return capped.withColumn("_final", final.getField("_level")).select(
        "_source", "source_size",
        F.when(F.col("_capped") | F.col("_final").isNull(), F.col("_cap")).otherwise(F.col("_final") * F.col("_weight")).alias("target"),
    )


def shuffle_key(seed: str) -> Column:
    """The seeded hash that orders a size class: of id and text, so that rows without id or of one id spread."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit(""))))


def mixed(rows: DataFrame, seed: str) -> DataFrame:
    """Add source_size, target and copies to stored rows that have size, ``_source``, ``_shuffle``, ``_tie``."""
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"))
    keyed = rows.withColumn("_bucket", F.concat(size_class(F.col("size")), F.substring("_shuffle", 1, _BUCKET_DIGITS)))
    placed = ranked(keyed, "_source", "_bucket", ["_shuffle", "size", "_tie"], "_rank", "_of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = _hash_fraction(F.lit(seed), F.lit("offset"), F.col("_source"))
    known = targets(sizes).withColumn("_rate", rate).withColumn("_start", start)
    joined = placed.join(known, "_source")
    crossed = F.floor(F.col("_start") + F.col("_rate") * (F.col("_rank") + 1)) - F.floor(F.col("_start") + F.col("_rate") * F.col("_rank"))
    return joined.withColumn("copies", F.least(crossed, F.lit(MOST_COPIES))).drop(
        "_shuffle", "_bucket", "_rank", "_of", "_rate", "_start"
    )


def mix_rows(documents: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    rows = store(
        documents.select(
            "doc_id", word_count(F.col("text")).alias("size"), source_key(F.col("source")).alias("_source"), shuffle_key(seed).alias("_shuffle"),
        ).withColumn("_tie", F.lit(0)),
        "mix-rows",
    )
    return mixed(rows, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix_documents(documents: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns it came with."""
    rows = store(
        documents.select(
            F.struct(*documents.columns).alias("_row"), "doc_id", word_count(F.col("text")).alias("size"),
            source_key(F.col("source")).alias("_source"), shuffle_key(seed).alias("_shuffle"), F.xxhash64("text").alias("_tie"),
        ),
        "mix-documents",
    )
    copied = mixed(rows, seed).filter("copies > 0").select("_row", F.explode(F.expr("sequence(1, copies)")).alias("_copy"))
    return copied.select("_row.*")
