"""Chat formatting: minimum-cost repair of turn roles, then rendering.

A legal conversation may begin with a system message, goes on with user and assistant
messages in turn, and ends with the assistant. For each turn of a conversation one may keep
its role (free), relabel it, merge it into the message before it, or insert empty messages
in front of it; the cheapest repair is the shortest path through the automaton of legal turns:

=========================  ====
keep a role                   0
merge with equal role         1
name a turn without a role    1
relabel a turn                2
insert an empty message       3
=========================  ====

(merging a turn of another role costs both). The cost of a stretch of turns is a 4 x 4
matrix (state before, state after), and matrices of neighbouring stretches compose, so a
conversation of any length is cut into blocks of 256 turns: block matrices are composed
level by level (256 at a time), the states at the block borders are chosen from the top down,
and each block is then repaired on its own. Turns are ranked in ranges of the whole order, so
that no conversation is gathered in one task, whatever its turn numbers are.

The result has one row per rendered piece; the pieces of a conversation in the order of
(block, step) are the rendered text. A message opens with ``<|role|>``, ends with ``<|end|>``;
merged turns are parted by a blank line; ``<|`` inside texts is written ``< |``.

Defined cases: turns go by number, null last, equal numbers by role, then text (null
first; the first ``HEAD`` characters, then a hash);
null texts are empty; roles are trimmed and lowered, usual synonyms are known, other roles and
null are turns without a role; a null conv_id is a conversation of its own; repeated rows are
repeated turns; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphwarden.llm.common import discard, ranked, store

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
KNOWN = {
    "system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
    "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT,
}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, GUESS, RELABEL, INSERT = 1, 1, 2, 3
_FAR = 1 << 40
BLOCK_BITS = 8
#: Characters of a text that order turns of one number and role (ranges are found from a sample of them).
HEAD = 256


@lru_cache(maxsize=None)
def inserted(before: int, after: int) -> tuple[int, ...] | None:
    """The fewest messages to insert to get from one state to another."""
    paths, seen = [(before, ())], {before}
    for state, path in paths:
        if state == after:
            return path
        for role in LEGAL[state]:
            if role not in seen:
                seen.add(role)
                paths.append((role, (*path, role)))
    return None


@lru_cache(maxsize=None)
def moves(state: int, role: int) -> tuple[tuple[int, int, tuple], ...]:
    """(cost, state after, steps) of all ways to take a turn, cheapest first; a step is (action, role)."""

    def change(to: int) -> int:
        return 0 if role == to else RELABEL if role else GUESS

    found = []
    if state != START:
        found.append((MERGE + change(state), state, (("merge", state),)))
    for middle in range(4):
        path = inserted(state, middle)
        if path is not None:
            for to in LEGAL[middle]:
                steps = (*(("insert", r) for r in path), ("keep" if role == to else "relabel", to))
                found.append((INSERT * len(path) + change(to), to, steps))
    best = {}
    for move in sorted(found, key=lambda m: (m[0], len(m[2]), m[1])):
        best.setdefault(move[1], move)
    return tuple(best.values())


def ending(state: int) -> tuple[int, tuple[int, ...]]:
    path = inserted(state, ASSISTANT) or ()
    return INSERT * len(path), path


@lru_cache(maxsize=4096)
def paths(roles: tuple[int, ...], start: int) -> tuple[tuple[int, ...], tuple[dict, ...]]:
    """Least costs to each state after the turns, and per turn how each state was reached best."""
    costs, back = {start: 0}, []
    for role in roles:
        reached: dict[int, tuple] = {}
        for state in sorted(costs):
            for cost, after, steps in moves(state, role):
                total = costs[state] + cost
                if after not in reached or total < reached[after][0]:
                    reached[after] = (total, state, steps)
        costs = {state: r[0] for state, r in reached.items()}
        back.append({state: r[1:] for state, r in reached.items()})
    return tuple(costs.get(s, _FAR) for s in range(4)), tuple(back)


def steps_between(roles: tuple[int, ...], start: int, end: int) -> list[tuple]:
    """The steps of the cheapest repair, turn by turn."""
    back = paths(roles, start)[1]
    out = []
    for reached in reversed(back):
        end, steps = reached[end]
        out.append(steps)
    return out[::-1]


def compose(matrices: list[list[int]]) -> list[int]:
    whole = matrices[0]
    for m in matrices[1:]:
        whole = [min(min(whole[4 * i + k] + m[4 * k + j] for k in range(4)), _FAR) for i in range(4) for j in range(4)]
    return whole


def border_states(matrices: list[list[int]], start: int, end: int) -> list[tuple[int, int]]:
    """(state before, state after) of each matrix on the cheapest way from start to end."""
    costs, back = [0 if s == start else _FAR for s in range(4)], []
    for m in matrices:
        came = [min(range(4), key=lambda k: (costs[k] + m[4 * k + j], k)) for j in range(4)]
        costs = [costs[came[j]] + m[4 * came[j] + j] for j in range(4)]
        back.append(came)
    out = []
    for came in reversed(back):
        out.append((came[end], end))
        end = came[end]
    return out[::-1]


def role_number(role: str | None) -> int:
    return KNOWN.get((role or "").strip().lower(), 0)


def _leaf_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for turns in batch.column("turns").to_pylist():
            roles = tuple(role_number(t["role"]) for t in turns)
            found.append([c for s in range(4) for c in paths(roles, s)[0]])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "block", "m"]
        )


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [compose([c["m"] for c in children]) for children in batch.column("children").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "block", "m"]
        )


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [min(range(4), key=lambda s: (m[s] + ending(s)[0], -s)) for m in batch.column("m").to_pylist()]
        zeros = pa.array([START] * len(ends), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), zeros, pa.array(ends, pa.int32()), pa.array([True] * len(ends))],
            names=["conv", "block", "before", "after", "last"],
        )


def _descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            children = x["children"]
            borders = border_states([c["m"] for c in children], x["before"], x["after"])
            for i, (child, (before, after)) in enumerate(zip(children, borders)):
                rows.append((x["conv"], child["block"], before, after, x["last"] and i == len(children) - 1))
        columns = list(zip(*rows)) if rows else [[]] * 5
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "block", "before", "after", "last"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            state, step = x["before"], 0
            roles = tuple(role_number(t["role"]) for t in x["turns"])

            def add(turn, action, role, text):
                nonlocal state, step
                close = "<|end|>\n" if state != START and action != "merge" else ""
                body = "\n\n" + text if action == "merge" else f"<|{NAMES[role]}|>\n{text}"
                rows.append([x["conv_id"], x["block"], step, turn, action, NAMES[role], close + body])
                state, step = role, step + 1

            for turn, steps in zip(x["turns"], steps_between(roles, x["before"], x["after"])):
                for action, role in steps:
                    inserted_ = action == "insert"
                    add(None if inserted_ else turn["turn"], action, role, "" if inserted_ else (turn["text"] or "").replace("<|", "< |"))
            if x["last"]:
                for role in ending(state)[1]:
                    add(None, "insert", role, "")
                if rows:
                    rows[-1][-1] += "<|end|>\n"
        columns = list(zip(*rows)) if rows else [[]] * 7
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "block", "step", "turn", "action", "role", "rendered"]
        )


_NODES = "conv string, block long, m array<long>"
_STATES = "conv string, block long, before int, after int, last boolean"
PIECES = "conv_id long, block long, step int, turn long, action string, role string, rendered string"


def _grouped(nodes: DataFrame) -> DataFrame:
    """Up to 256 neighbouring blocks under one parent block."""
    return nodes.groupBy("conv", F.shiftright("block", BLOCK_BITS).alias("block_")).agg(
        F.sort_array(F.collect_list(F.struct("block", "m"))).alias("children")
    ).withColumnRenamed("block_", "block")


def repaired(conversations: DataFrame) -> DataFrame:
    """The rendered pieces of every conversation, ordered by (block, step) within it."""
    spark = conversations.sparkSession
    order = [F.col("turn").asc_nulls_last(), F.col("role"), F.col("_head"), F.col("_hash")]
    rows = store(
        conversations.select(
            F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("~")).alias("conv"),
            F.col("turn").cast("long").alias("turn"), "role", "text", F.substring("text", 1, HEAD).alias("_head"), F.xxhash64("text").alias("_hash"),
        ).withColumn("_deal", F.xxhash64(F.monotonically_increasing_id())),
        "turns",
    )
    # Equal turns are dealt over several ranges: they are interchangeable.
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv", *order, "_deal")
    placed = store(ranges.withColumn("_range", F.spark_partition_id()), "turn-ranges")
    discard(rows)
    numbered = ranked(placed, "conv", "_range", order, "_at", "_turns")
    leaves = store(
        numbered.select(
            "conv", "conv_id", F.shiftright("_at", BLOCK_BITS).alias("block"), F.struct(F.col("_at").alias("at"), "role", "text", "turn").alias("t")
        ).groupBy("conv", "conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("turns")),
        "turn-blocks",
    )
    discard(placed)
    nodes = store(leaves.mapInArrow(_leaf_matrices, _NODES), "block-costs")
    levels, states = [], []
    while True:  # one round for all but conversations of more than 256 turns
        sizes = nodes.groupBy("conv").agg(F.count("*").alias("blocks"))
        whole = nodes.join(sizes.filter("blocks = 1"), "conv", "left_semi")
        states.append(store(whole.mapInArrow(_roots, _STATES), "roots"))
        many = sizes.filter("blocks > 1")
        if many.isEmpty():
            break
        parents = store(_grouped(nodes.join(many, "conv", "left_semi")), "parents")
        levels.append(parents)
        nodes = store(parents.mapInArrow(_composed, _NODES), "block-costs")
    known = states.pop()
    while levels:
        below = levels.pop().join(known, ["conv", "block"]).select("conv", "block", "children", "before", "after", "last")
        known = store(below.mapInArrow(_descended, _STATES).unionByName(states.pop()), "states")
    return leaves.join(known, ["conv", "block"]).select("conv_id", "block", "turns", "before", "after", "last").mapInArrow(_pieces, PIECES)


def assembled(pieces: DataFrame) -> DataFrame:
    """One row per conversation with the whole rendered text; for conversations that fit into a row."""
    return pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "step", "rendered"))).alias("p")).select(
        "conv_id", F.array_join(F.transform("p", lambda x: x["rendered"]), "").alias("rendered")
    )
