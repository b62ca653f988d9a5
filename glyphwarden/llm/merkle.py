"""Merkle manifest of a dataset by time-forward processing.

Each document is a leaf: the SHA-256 of its fields, every field written with its length. The
leaves of a language, in the order of their ids, form a tree of fan-out 8; the subroots, in
the order of the languages, form one more tree whose top is the root.

A node has the label (tree, place in its level); levels follow one another, so that a child's
label always comes before its parent's. *Upwards*, every node sends its digest to the label
of its parent. The queue of messages is external: a table per level, range-partitioned and
sorted by label, from which the parents take what is addressed to them and insert their own
digests for the next level. *Downwards*, the sweep runs in reverse: a node that has got the
proof suffix from its place to the root sends each child that suffix with the child's
siblings in front. What arrives at the leaves is their proof.

Nothing is gathered beyond a node's own children: places are counts of sorted ranges plus the
position in one range, so neither a language that holds most rows nor a null id meets in one
task. The driver learns the size of the largest tree and the root.

Defined cases: null fields (also a null text) are written as ``-``; the null language is a
tree of its own and comes first; null ids come last in their tree; rows of one id are
ordered by their digest, so that repeated rows take interchangeable places; a tree of one
leaf has that leaf as its subroot and adds nothing to the proof; an empty table has no root and
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwarden.llm.common import discard, store

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<slot:int,siblings:array<string>>>"


def field(value: Column) -> Column:
    """A field as it is hashed: its length in bytes, a colon and the value; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(text: Column | None = None) -> Column:
    """The leaf of a row; ``text`` stands in for the row's own text."""
    return digest(*[field(F.col(c) if c != "text" or text is None else text) for c in FIELDS])


def tree_key(lang: Column) -> Column:
    """Languages bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def placed(leaves: DataFrame, order: list) -> DataFrame:
    """Add ``at`` (place in the tree, from 0) and ``n`` (size of the tree) to stored leaves (``tree``, ...).

    The rows are sorted into ranges; only the counts of (range, tree) meet per tree.
    """
    ranges = store(
        leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
        .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()),
        "merkle-ranges",
    )
    spans = ranges.groupBy("tree", "part").agg(F.count("*").alias("size"), F.min("row").alias("first"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(
        "tree", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("size").over(Window.partitionBy("tree")).alias("n"),
    )
    return ranges.join(offsets, ["tree", "part"]).withColumn("at", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def climb(leaves: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Sweep up placed leaves (``tree``, ``at``, ``n``, ``digest``, payload).

    Returns the stored levels of inner nodes, lowest first, and the tops: tree, digest, and depth
    (levels below the top). Children of the lowest level carry the payload.
    """
    largest = leaves.agg(F.max("n")).first()[0] or 0
    levels: list[DataFrame] = []
    queue, carried = leaves, ["digest", *payload]
    tops = leaves.filter("n = 1").select("tree", "digest", F.lit(0).alias("depth"))
    while largest > 1:
        messages = queue.filter("n > 1").select(
            "tree", F.expr(f"at div {FAN_OUT}").alias("at"), F.expr(f"cast(at % {FAN_OUT} as int)").alias("slot"), "n", *carried
        )
        delivered = messages.repartitionByRange("tree", "at").sortWithinPartitions("tree", "at")
        nodes = delivered.groupBy("tree", "at").agg(
            F.expr(f"(max(n) + {FAN_OUT - 1}) div {FAN_OUT}").alias("n"),
            F.array_sort(F.collect_list(F.struct("slot", *carried))).alias("children"),
        )
        queue = store(nodes.withColumn("digest", digest(F.array_join("children.digest", ""))), f"merkle-level-{len(levels)}")
        levels.append(queue)
        carried = ["digest"]
        largest = -(-largest // FAN_OUT)
        tops = tops.unionByName(queue.filter("n = 1").select("tree", "digest", F.lit(len(levels)).alias("depth")))
    return levels, tops


def descend(levels: list[DataFrame], leaves: DataFrame, starts: DataFrame, payload: list[str]) -> DataFrame:
    """Sweep down: each leaf with its digest, payload and proof.

    ``starts`` has one row per tree: tree, depth, ``proof`` (the suffix above its top) and columns
    that all leaves of the tree are to get.
    """
    common = [c for c in starts.columns if c not in ("tree", "depth", "proof")]
    lone = leaves.filter("n = 1").select("tree", "digest", *payload).join(starts.filter("depth = 0").drop("depth"), "tree")
    messages = None
    for i in reversed(range(len(levels))):
        own = starts.filter(F.col("depth") == i + 1).select("tree", F.lit(0).cast("long").alias("at"), "proof", *common)
        inbox = own if messages is None else messages.select("tree", "at", "proof", *common).unionByName(own)
        to_children = F.explode(F.transform("children", lambda c: F.struct(
            c.alias("child"), F.transform(F.filter("children", lambda d: d["slot"] != c["slot"]), lambda d: d["digest"]).alias("siblings")
        )))
        sent = levels[i].select("tree", "at", "children").join(inbox, ["tree", "at"]).select("*", to_children.alias("to")).drop("children")
        messages = sent.select(
            "tree", (F.col("at") * FAN_OUT + F.col("to.child.slot")).alias("at"),
            F.concat(F.array(F.struct("to.child.slot", "to.siblings")), F.col("proof")).alias("proof"), *common, "to.child.*",
        ).drop("slot")
    if messages is None:
        return lone
    return messages.drop("at").unionByName(lone)


def manifest(documents: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root and proof of every row, lowest level first.

    A step of the proof is the node's own slot and the digests of its siblings, left to right.
    ``claimed_text`` gives a text to check against the manifest where it is not null: ``claimed`` is
    the leaf that row would have with it.
    """
    claimed = F.lit(None).cast("string") if claimed_text is None else F.when(claimed_text.isNotNull(), leaf_digest(claimed_text))
    rows = store(
        documents.select(F.col("doc_id"), tree_key(F.col("lang")).alias("tree"), leaf_digest().alias("digest"), claimed.alias("claimed")),
        "merkle-leaves",
    )
    payload = ["doc_id", "claimed"]
    leaves = placed(rows, [F.asc_nulls_last("doc_id"), F.col("digest")])
    levels, tops = climb(leaves, payload)
    languages = tops.select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest", "depth")
    subroots = placed(languages, [F.col("language")]).withColumnRenamed("depth", "language_depth")
    top_payload = ["language", "language_depth"]
    top_levels, top = climb(subroots, top_payload)
    start = top.select("tree", "depth", F.expr(f"cast(array() as {_PROOF})").alias("proof"), F.col("digest").alias("root"))
    starts = descend(top_levels, subroots, start, top_payload).select(
        F.col("language").alias("tree"), F.col("language_depth").alias("depth"), "proof", F.col("digest").alias("subroot"), "root"
    )
    proved = descend(levels, leaves, starts, payload)
    discard(rows)
    return proved.select("doc_id", F.col("digest").alias("leaf"), "claimed", "subroot", "root", "proof")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    def step(below: Column, s: Column) -> Column:
        left = F.array_join(F.slice(s["siblings"], F.lit(1), s["slot"]), "")
        right = F.array_join(F.slice(s["siblings"], s["slot"] + 1, F.lit(FAN_OUT)), "")
        return digest(left, below, right)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), ""), 256)
