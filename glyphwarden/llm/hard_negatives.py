"""Hard negatives by slot-decomposed selection.

Every anchor has a few positives (its best rows of the same label). A positive asks for the
best rows of other labels whose score lies between a share of its own score and its own score:
windows of the score axis that overlap, one per positive.

The positives' scores, as upper limits, split the axis into disjoint slots, and a row belongs
to one slot of an anchor. Tasks keep the best few rows per (anchor, slot) of what they see
(combiners), these are cut to the best few once more where they meet, and one merge from the
lowest slot upwards gives, for each limit, the best rows at or below it. The lower end of a
window cuts off the tail of such a list.

Rows and anchors travel as packed blocks (ids, labels, one matrix). Anchors are a stated query
set and meet all rows, block by block: row blocks are dealt to lanes, every lane gets all blocks
of anchors, and a matrix product scores a pair of blocks at once.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no
part; vectors of different lengths are filled up with zeros; a null id is no anchor, keeps its
label and comes last among ties; rows with the id of an anchor are not its positives; repeated
anchor rows are anchors each; a positive with a negative score has an empty window; an
empty table gives an empty result; other columns are ignored. Scores are exact: blocks whose
products could pass 2**53 are computed with Python integers, and what does not fit 64 bits is
returned as the largest or least long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwarden.llm.common import discard, store

ROWS_PER_BLOCK = 2048
ANCHORS_PER_BLOCK = 512
BLOCKS_PER_LANE = 4
POSITIVES = 5
NEGATIVES = 5
LOWER_PERCENT = 80
_NO_ID = (1 << 63) - 1
_NO_LIMIT = -(1 << 63)
_PACKED = "n int, dim int, uids binary, ids binary, labels binary, limits binary, data binary"


def eligible(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and quantised components (floor of 256 times the value) of the rows that take part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))
    return rows.filter(F.col("label").isNotNull() & F.col(vector).isNotNull()).filter(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )


def _pack(uids, ids, labels, vectors: list, limits: list | None) -> dict:
    """One block, sorted by id so that the first of equal scores has the smallest."""
    known = np.array([_NO_ID if i is None else i for i in ids], np.int64)
    order = np.argsort(known, kind="stable")
    dim = max((len(v) for v in vectors), default=0)
    data = np.zeros((len(order), dim))
    for place, i in enumerate(order):
        data[place, : len(vectors[i])] = np.floor(256.0 * np.asarray(vectors[i], np.float64))
    lim = np.full((len(order), 0 if limits is None else max((len(x) for x in limits), default=0)), _NO_LIMIT, np.int64)
    if limits is not None:
        for place, i in enumerate(order):
            lim[place, : len(limits[i])] = limits[i]
    return {
        "n": len(order), "dim": dim, "uids": np.asarray(uids, np.int64)[order].tobytes(), "ids": known[order].tobytes(),
        "labels": np.asarray(labels, np.int64)[order].tobytes(), "limits": lim.tobytes(), "data": data.tobytes(),
    }


_PACK_SCHEMA = pa.schema([
    ("n", pa.int32()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("uids", "ids", "labels", "limits", "data")]
])


def packed(rows: DataFrame, per_block: int) -> DataFrame:
    """Rows (uid, vec_id, label, vector[, limits]) as blocks of at most ``per_block``."""
    limited = "limits" in rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(part: pa.Table) -> pa.RecordBatch:
            columns = part.to_pydict()
            limits = columns["limits"] if limited else None
            vectors = part["vector"].combine_chunks()
            arrays = [np.asarray(v.values, np.float64) for v in vectors]
            one = _pack(columns["uid"], columns["vec_id"], columns["label"], arrays, limits)
            return pa.RecordBatch.from_pylist([one], schema=_PACK_SCHEMA)

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for start in range(0, batch.num_rows, per_block):
                held.append(batch.slice(start, per_block))
                count += held[-1].num_rows
                while count >= per_block:
                    table = pa.Table.from_batches(held)
                    yield block(table.slice(0, per_block))
                    held = table.slice(per_block).to_batches()
                    count -= per_block
        if count:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(pack, _PACKED)


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict, prefix: str):
        n, dim = row[prefix + "n"], row[prefix + "dim"]
        self.uids, self.ids, self.labels = (np.frombuffer(row[prefix + c], np.int64) for c in ("uids", "ids", "labels"))
        self.data = np.frombuffer(row[prefix + "data"], np.float64).reshape(n, dim)
        limits = np.frombuffer(row[prefix + "limits"], np.int64)
        self.limits = limits.reshape(n, len(limits) // n)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows; floats where these are exact, else Python integers."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if dim * np.abs(a).max() * np.abs(b).max() * 100 < float(1 << 53):
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return whole[0] @ whole[1].T


def first_per_group(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the best ``most`` (score down, id up) of each group."""
    if score.dtype == object:
        score = np.unique(score, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    rank = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.r_[starts, len(ordered)]))
    return order[rank < most]


class Best:
    """Combiner: the best few rows per (anchor, slot) of the anchors' block at hand."""

    def __init__(self, anchors: Block, most: int):
        self.anchors, self.most, self.held = anchors, most, None

    def add(self, anchor: np.ndarray, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Candidates; ``anchor`` has places in the block."""
        new = (anchor, slot, ids, score)
        both = new if self.held is None else tuple(np.concatenate(x) for x in zip(self.held, new))
        best = first_per_group(both[0] * (self.anchors.limits.shape[1] + 1) + both[1], both[3], both[2], self.most)
        self.held = tuple(x[best] for x in both)

    def batch(self) -> pa.RecordBatch:
        anchor, slot, ids, score = self.held
        fits = [min(max(int(s), _NO_LIMIT), _NO_ID) for s in score]
        return pa.RecordBatch.from_arrays([
            pa.array(self.anchors.uids[anchor]), pa.array(self.anchors.ids[anchor]), pa.array(slot.astype(np.int32)),
            pa.array(ids), pa.array(fits, pa.int64()),
        ], names=["uid", "anchor_id", "slot", "vec_id", "score"])


def same_label(a: Block, r: Block, best: Best) -> None:
    """Candidates for positives: all in slot 0."""
    for label in np.unique(a.labels):
        at, rt = np.flatnonzero(a.labels == label), np.flatnonzero(r.labels == label)
        if len(rt):
            s = scores(a.data[at], r.data[rt])
            i, j = _top(s, a.ids[at][:, None] != r.ids[rt][None, :], best.most)
            best.add(at[i], np.zeros(len(i), np.int64), r.ids[rt][j], s[i, j])


def _top(s: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all allowed scores that can be among the best ``most`` of their row."""
    if s.dtype == object or s.shape[1] <= most:
        return np.nonzero(allowed)
    shown = np.where(allowed, s, -np.inf)
    least = -np.partition(-shown, most - 1, axis=1)[:, most - 1 : most]
    return np.nonzero(allowed & (shown >= least))


def other_label(a: Block, r: Block, best: Best, percent: int) -> None:
    """Candidates for negatives, each in the slot of its score.

    Slots are numbered from 1, highest first: slot k holds the scores that k limits are not below.
    Scores outside all windows belong to no answer and are left out at once.
    """
    s = scores(a.data, r.data)
    asked = a.limits >= 0
    high = np.where(asked, a.limits, -1).max(axis=1, initial=-1)
    low = np.where(asked, a.limits, _NO_ID).min(axis=1, initial=_NO_ID)
    if s.dtype == object:
        high, low = high.astype(object), low.astype(object)
    inside = (s <= high[:, None]) & (100 * s >= percent * low[:, None].astype(s.dtype))
    i, j = np.nonzero(inside.astype(bool) & (a.labels[:, None] != r.labels[None, :]))
    if len(i):
        score = s[i, j]
        best.add(i, (a.limits[i] >= score[:, None]).sum(axis=1), r.ids[j], score)


_FOUND = "uid long, anchor_id long, slot int, vec_id long, score long"


def selected(anchors: DataFrame, rows: DataFrame, lanes: int, most: int, choose) -> DataFrame:
    """The best ``most`` rows per (anchor, slot) over all rows: uid, anchor_id, slot, vec_id, score, rank.

    ``choose(anchor block, row block, combiner)`` adds the candidates of a pair of blocks.
    """
    # Always merged: every lane has all anchors, which Spark counts once when it asks whether the driver may broadcast
    # them. The merge also keeps the pairs of an anchor block together.
    left = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    right = rows.select("lane", *[F.col(c).alias(f"r_{c}") for c in rows.columns if c != "lane"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["a_uids"] != at:
                    if best is not None and best.held is not None:
                        yield best.batch()
                    at, best = row["a_uids"], Best(Block(row, "a_"), most)
                choose(best.anchors, Block(row, "r_"), best)
        if best is not None and best.held is not None:
            yield best.batch()

    pairs = left.hint("merge").join(right, "lane").drop("lane")
    place = Window.partitionBy("uid", "slot").orderBy(F.desc("score"), "vec_id")
    return pairs.mapInArrow(score, _FOUND).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)


def _blocks(count: int, size: int) -> int:
    return max(1, -(-count // size))


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower_percent: int = LOWER_PERCENT,
    rows_per_block: int = ROWS_PER_BLOCK, anchors_per_block: int = ANCHORS_PER_BLOCK, blocks_per_lane: int = BLOCKS_PER_LANE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` have vec_id, label and vector, as ``eligible`` gives them; ``is_anchor`` tells the anchors.
    """
    known = store(rows, "vectors")
    count = known.count()
    n_blocks = _blocks(count, rows_per_block)
    lanes = _blocks(n_blocks, blocks_per_lane)
    blocks = store(
        packed(known.repartition(n_blocks).select(F.lit(0).cast("long").alias("uid"), "vec_id", "label", "vector"), 2 * rows_per_block)
        .withColumn("lane", F.spark_partition_id() % lanes),
        "row-blocks",
    )
    anchors = store(known.filter(F.coalesce(is_anchor, F.lit(False))).withColumn("uid", F.monotonically_increasing_id()), "anchors")
    discard(known)
    spread = _blocks(anchors.count(), anchors_per_block)

    plain = packed(anchors.repartition(spread).select("uid", "vec_id", "label", "vector"), 2 * anchors_per_block)
    found = store(selected(plain, blocks, lanes, positives, same_label), "positives")
    limits = found.groupBy("uid").agg(F.collect_list("score").alias("limits"))
    limited = anchors.join(limits, "uid").repartition(spread).select("uid", "vec_id", "label", "vector", "limits")
    slots = selected(
        packed(limited, 2 * anchors_per_block), blocks, lanes, negatives, lambda a, r, best: other_label(a, r, best, lower_percent)
    )
    # Slots of an anchor from the highest on, each in order: what follows a slot is the merge of the lower ones.
    entry = F.struct("slot", "rank", "vec_id", "score")
    merged = slots.groupBy("uid").agg(F.array_sort(F.collect_list(entry)).alias("below"))
    asked = found.select("uid", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The slot that a limit opens: as many limits are not below it.
    not_below = Window.partitionBy("uid").orderBy(F.desc("positive_score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    opened = asked.withColumn("opens", F.count("*").over(not_below))
    suffix = F.slice(F.filter("below", lambda e: e["slot"] >= F.col("opens")), 1, negatives)
    inside = F.filter(suffix, lambda e: (e["score"].cast("decimal(38,0)") * 100 >= F.col("positive_score").cast("decimal(38,0)") * lower_percent)
                      & (e["score"] <= F.col("positive_score")))
    answers = opened.join(merged, "uid").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "e"))

    def identity(id_: Column) -> Column:
        return F.when(id_ != _NO_ID, id_)

    return answers.select(
        "anchor_id", identity(F.col("positive_id")).alias("positive_id"), (F.col("at") + 1).alias("rank"),
        identity(F.col("e.vec_id")).alias("negative_id"), "positive_score",
        F.col("e.score").alias("negative_score"),
    )
