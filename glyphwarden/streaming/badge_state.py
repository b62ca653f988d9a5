"""Badges of a stream, with a keyed state store.

What a user has done so far is a few values in Spark's state store: scans, threats, formats used,
badges held, and the length of the run of clean scans at hand. A micro-batch brings its
scans to the state of their user and nothing else is read, however long the history is.

A user's scans of one micro-batch come in chunks and in no order. As long as a badge may still
be earned they are put in order as narrow arrays (time, id, counts), which the size of a
micro-batch bounds; a user who holds every badge is only counted, chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphwarden import rules

STATE = "scan_count long, threat_count long, formats_used string, clean_run long, held string"
EARNED = "user_id long, badge_key string, earned_micros long"
_NEW = (0, 0, "", 0, "")


def scans_of(records: DataFrame) -> DataFrame:
    """The narrow form in which scans meet their user; scans without a user earn nothing."""
    return records.filter(F.col("user_id").isNotNull()).select(
        F.col("user_id").cast("long").alias("user_id"), F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("id"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"), F.size("findings").cast("long").alias("n_findings"),
        F.lower(F.coalesce("file_format", F.lit(""))).alias("file_format"),
        F.coalesce(F.col("verdict") == "ALLOWED", F.lit(False)).alias("clean"),
        F.coalesce(F.exists("findings.severity", lambda s: s == "CRITICAL"), F.lit(False)).alias("critical"),
    )


def _first(reached: np.ndarray) -> int | None:
    """The first place that is reached, if any is."""
    at = int(reached.argmax()) if len(reached) else 0
    return at if len(reached) and reached[at] else None


def _in_order(rows: pd.DataFrame, before: tuple, milestones: dict[str, int]) -> tuple[dict[str, int], int]:
    """Places at which badges are earned among a user's ordered scans, and the clean run they end with."""
    scans, threats, formats, run, _ = before
    n = len(rows)
    found = {badge: max(0, count - scans - 1) for badge, count in milestones.items() if scans + n >= count}
    found["threat_hunter"] = _first(threats + rows["n_findings"].to_numpy().cumsum() >= rules.THREAT_HUNTER_TOTAL)
    found["eagle_eye"] = _first(rows["critical"].to_numpy(bool))
    new_format = ~rows["file_format"].duplicated().to_numpy() & ~rows["file_format"].isin(formats.split(",") if formats else []).to_numpy()
    new_format &= rows["file_format"].to_numpy() != ""
    known = len(formats.split(",")) if formats else 0
    found["format_explorer"] = _first(known + new_format.cumsum() >= rules.FORMAT_EXPLORER_DISTINCT)
    place = np.arange(1, n + 1)
    broken = np.maximum.accumulate(np.where(rows["clean"].to_numpy(bool), -run, place))
    runs = place - broken
    found["clean_slate"] = _first(runs >= rules.CLEAN_SLATE_RUN)
    return {badge: at for badge, at in found.items() if at is not None}, int(runs[-1])


def _counted(before: tuple, rows: pd.DataFrame) -> tuple:
    scans, threats, formats, run, held = before
    used = {f for f in [*formats.split(","), *rows["file_format"].unique()] if f}
    return scans + len(rows), threats + int(rows["n_findings"].sum()), ",".join(sorted(used)), run, held


def awards(records: DataFrame, milestones: dict[str, int] = rules.SCAN_MILESTONES) -> DataFrame:
    """user_id, badge_key and earned_at of the badges earned by arriving scans, each once per user."""
    every = {*milestones, "threat_hunter", "eagle_eye", "format_explorer", "clean_slate"}

    def award(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = tuple(state.get) if state.exists else _NEW
        held = set(before[4].split(",")) - {""}
        if every <= held:
            for rows in chunks:
                before = _counted(before, rows)
            state.update(before)
            return
        rows = pd.concat(list(chunks), ignore_index=True).sort_values(["micros", "id"], kind="stable", ignore_index=True)
        found, run = _in_order(rows, before, milestones)
        fresh = {badge: at for badge, at in found.items() if badge not in held}
        scans, threats, formats, _, _ = _counted(before, rows)
        state.update((scans, threats, formats, run, ",".join(sorted(held | set(fresh)))))
        if fresh:
            yield pd.DataFrame({
                "user_id": key[0], "badge_key": list(fresh), "earned_micros": [int(rows["micros"].iloc[at]) for at in fresh.values()]
            })

    earned = scans_of(records).groupBy("user_id").applyInPandasWithState(
        award, EARNED, STATE, "append", GroupStateTimeout.NoTimeout
    )
    return earned.select(
        "user_id", "badge_key", F.timestamp_micros("earned_micros").cast("timestamp_ntz").alias("earned_at")
    )
