"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphwarden.llm.common import discard, store


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them (u > v in every link)."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is not the least of its component; links are pairs (u, v).

    Minima are combined before the shuffle, so a node with very many links is not gathered.
    The two steps are repeated until the stars are stable; each round is stored.
    """
    directed = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = store(directed, "links")
    signature = None
    while True:
        before, now = now, store(_small_star(_large_star(now)), "stars")
        discard(before)
        # Stable when a round changes nothing: same count and same hash of the set of links.
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        if tuple(found) == signature or found["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        signature = tuple(found)
