"""Running counters, badges and the leaderboard.

A badge is earned at the scan that first meets its condition. No badge needs a user's
whole history in one place: milestones look at the first N scans and the threat total at
the first N scans with findings (Spark drops later rows before the shuffle), the others
are plain aggregates. Full running totals cut the history into time slices: totals of
earlier slices are a prefix sum over one row per slice, and only the inside of a slice is
ordered row by row (see ``running_counters``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwarden import rules
from glyphwarden.functions import text as text_functions

DEFAULT_SLICE = "hour"


def user_counters(records: DataFrame) -> DataFrame:
    """Scans, threats and the set of formats per user."""
    return records.groupBy("user_id").agg(
        F.count("*").alias("scan_count"), F.sum(F.size("findings")).alias("threat_count"),
        F.array_sort(F.collect_set(F.lower("file_format"))).alias("formats_used"),
    )


def _narrow(records: DataFrame, slice_unit: str) -> DataFrame:
    return records.select(
        "id", "user_id", "created_at", F.lower("file_format").alias("file_format"), F.size("findings").alias("n_findings"),
        (F.col("verdict") == "ALLOWED").alias("clean"),
        F.exists("findings.severity", lambda s: s == "CRITICAL").alias("critical"),
        F.date_trunc(slice_unit, F.col("created_at")).alias("slice"),
    )


def _inside_slice():
    return Window.partitionBy("user_id", "slice").orderBy("created_at", "id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def _earlier_slices():
    # One row per slice of a user: bounded by the time span, not by the number of scans.
    return Window.partitionBy("user_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)


def _moment() -> Column:
    """(created_at, id) as one sortable number; unlike a struct it aggregates without sorting."""
    return F.expr(
        "cast(cast(unix_micros(cast(created_at as timestamp)) as decimal(19,0)) * 10000000000000000000BD "
        "+ cast(id as decimal(19,0)) as decimal(38,0))"
    )


def first_formats(rows: DataFrame) -> DataFrame:
    """Per user the first scan of each format: at most one entry per format."""
    first = rows.groupBy("user_id", "file_format").agg(F.min(_moment()).alias("moment"))
    return first.groupBy("user_id").agg(F.collect_list(F.struct("moment", "file_format")).alias("format_firsts"))


def running_counters(records: DataFrame, slice_unit: str = DEFAULT_SLICE) -> DataFrame:
    """Each scan with scan_count, threat_count and format_count as they stood after it."""
    rows = _narrow(records, slice_unit)
    slices = rows.groupBy("user_id", "slice").agg(F.count("*").alias("n"), F.sum("n_findings").alias("t"))
    before = slices.select(
        "user_id", "slice",
        F.coalesce(F.sum("n").over(_earlier_slices()), F.lit(0)).alias("scans"),
        F.coalesce(F.sum("t").over(_earlier_slices()), F.lit(0)).alias("threats_so_far"),
    ).join(first_formats(rows), "user_id")
    inside = rows.select(
        "*",
        F.row_number().over(_inside_slice()).alias("rank"),
        F.sum("n_findings").over(_inside_slice()).alias("threats"),
    )
    return inside.withColumn("moment", _moment()).join(before, ["user_id", "slice"]).select(
        "id", "user_id", "created_at", "n_findings", "critical", "clean",
        (F.col("scans") + F.col("rank")).alias("scan_count"),
        (F.col("threats_so_far") + F.col("threats")).alias("threat_count"),
        F.size(F.filter("format_firsts", lambda f: f["moment"] <= F.col("moment"))).alias("format_count"),
    )


def _earned(rows: DataFrame, badge: Column | str) -> DataFrame:
    key = badge if isinstance(badge, Column) else F.lit(badge)
    return rows.select("user_id", key.alias("badge_key"), F.col("created_at").alias("earned_at"))


def _by_time():
    return Window.partitionBy("user_id").orderBy("created_at", "id")


def _reached(milestones: dict[str, int]) -> list[Column]:
    return [F.when(F.col("scan_count") == n, F.lit(badge)) for badge, n in milestones.items()]


def scan_milestones(records: DataFrame, milestones: dict[str, int] = rules.SCAN_MILESTONES) -> DataFrame:
    """Badges for the n-th scan; only a user's first max(n) scans are shuffled."""
    ranked = records.select("user_id", "created_at", "id").withColumn("scan_count", F.row_number().over(_by_time()))
    first = ranked.filter(F.col("scan_count") <= max(milestones.values()))
    return _earned(first.withColumn("badge", F.explode(F.array_compact(F.array(*_reached(milestones))))), F.col("badge"))


def _crosses_threats(total: int) -> Column:
    return (F.col("threat_count") >= total) & (F.col("threat_count") - F.col("n_findings") < total)


def threat_hunter(records: DataFrame, total: int = rules.THREAT_HUNTER_TOTAL) -> DataFrame:
    """Cumulative threats: the total is reached within the first ``total`` scans with findings."""
    rows = records.select("user_id", "created_at", "id", F.size("findings").alias("n_findings")).filter("n_findings > 0")
    first = rows.withColumn("rank", F.row_number().over(_by_time())).filter(F.col("rank") <= total)
    running = F.sum("n_findings").over(_by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _earned(first.withColumn("threat_count", running).filter(_crosses_threats(total)), "threat_hunter")


def format_explorer(records: DataFrame, distinct: int = rules.FORMAT_EXPLORER_DISTINCT) -> DataFrame:
    """The time the n-th distinct format was first used."""
    first = records.groupBy("user_id", F.lower("file_format").alias("file_format")).agg(
        F.min("created_at").alias("created_at")
    )
    order = Window.partitionBy("user_id").orderBy("created_at", "file_format")
    return _earned(
        first.withColumn("n", F.row_number().over(order)).filter((F.col("n") <= distinct) & (F.col("n") == distinct)),
        "format_explorer",
    )


def eagle_eye(records: DataFrame) -> DataFrame:
    critical = records.filter(F.exists("findings.severity", lambda s: s == "CRITICAL"))
    return _earned(critical.groupBy("user_id").agg(F.min("created_at").alias("created_at")), "eagle_eye")


def first_event(events: DataFrame, event_type: str, badge: str = "api_master") -> DataFrame:
    """Badge for the first event of a type (key generation in production)."""
    first = events.filter(F.col("event_type") == event_type).groupBy("user_id").agg(F.min("ts").alias("created_at"))
    return _earned(first, badge)


def clean_runs(records: DataFrame, slice_unit: str = DEFAULT_SLICE) -> DataFrame:
    """Each clean (allowed) scan with the length of the run of clean scans it ends."""
    rows = _narrow(records, slice_unit).select("id", "user_id", "created_at", "clean", "slice")
    ranked = rows.withColumn("rank", F.row_number().over(_inside_slice()))
    ranked = ranked.withColumn("broken_at", F.max(F.when(~F.col("clean"), F.col("rank"))).over(_inside_slice()))
    slices = ranked.groupBy("user_id", "slice").agg(F.count("*").alias("n"), F.max("broken_at").alias("broken"))
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(_earlier_slices()), F.lit(0)))
    slices = slices.select(
        "user_id", "slice", "before",
        F.max(F.col("before") + F.col("broken")).over(_earlier_slices()).alias("broken_before"),
    )
    joined = ranked.filter("clean").join(slices, ["user_id", "slice"])
    last_break = F.coalesce(F.col("before") + F.col("broken_at"), F.col("broken_before"), F.lit(0))
    return joined.select(
        "id", "user_id", "created_at", (F.col("before") + F.col("rank") - last_break).alias("run_length")
    )


def clean_slate(records: DataFrame, length: int = rules.CLEAN_SLATE_RUN) -> DataFrame:
    """First time a user has ``length`` clean scans in a row."""
    fifth = clean_runs(records).filter(F.col("run_length") == length)
    return _earned(fifth.groupBy("user_id").agg(F.min("created_at").alias("created_at")), "clean_slate")


def scan_badges(records: DataFrame, milestones: dict[str, int] = rules.SCAN_MILESTONES) -> DataFrame:
    """All badges checked after a scan."""
    found = [scan_milestones(records, milestones), threat_hunter(records), eagle_eye(records), format_explorer(records)]
    return reduce(DataFrame.unionByName, found)


_SUMMARY = "user_id", "slice"


def slice_summaries(
    records: DataFrame, milestones: dict[str, int] = rules.SCAN_MILESTONES, slice_unit: str = DEFAULT_SLICE
) -> DataFrame:
    """One row per user and time slice with all that badges ask of it, however many scans it holds.

    n, t: scans and threats. ``firsts``: the times of its first scans, as many as a milestone or a
    clean run can need. ``hits``: its first scans with findings, with the threats up to there,
    until they would be enough alone. ``critical``: first scan with a critical finding.
    ``formats``: first use of each format. ``broken``, ``lead``: rank of its last scan that is not clean,
    clean scans before its first one. ``run_at``: when a clean run within the slice got long enough.
    """
    rows = _narrow(records, slice_unit)
    here = _inside_slice()
    ranked = rows.select(
        "*", F.row_number().over(here).alias("rank"), F.sum("n_findings").over(here).alias("threats"),
    ).withColumn("broken_at", F.max(F.when(~F.col("clean"), F.col("rank"))).over(here))
    needed = max(*milestones.values(), rules.CLEAN_SLATE_RUN)
    run = F.col("rank") - F.coalesce("broken_at", F.lit(0))
    hit = (F.col("n_findings") > 0) & (F.col("threats") - F.col("n_findings") < rules.THREAT_HUNTER_TOTAL)
    formats = ranked.select("*", F.row_number().over(Window.partitionBy(*_SUMMARY, "file_format").orderBy("created_at", "id")).alias("use"))
    return formats.groupBy(*_SUMMARY).agg(
        F.count("*").alias("n"), F.sum("n_findings").alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= needed, F.col("created_at")))).alias("firsts"),
        F.array_sort(F.collect_list(F.when(hit, F.struct("threats", "created_at")))).alias("hits"),
        F.min(F.when(F.col("critical"), F.col("created_at"))).alias("critical"),
        F.collect_list(F.when(F.col("use") == 1, F.struct("file_format", "created_at"))).alias("formats"),
        F.max("broken_at").alias("broken"),
        F.coalesce(F.min(F.when(~F.col("clean"), F.col("rank"))) - 1, F.count("*")).alias("lead"),
        F.min(F.when(F.col("clean") & (run == rules.CLEAN_SLATE_RUN), F.col("created_at"))).alias("run_at"),
    )


def scan_badges_of_slices(summaries: DataFrame, milestones: dict[str, int] = rules.SCAN_MILESTONES) -> DataFrame:
    """All badges that scans earn, from the slices of each user in order.

    Prefix sums over the slices say in which one a condition is first met; the time is in its summary.
    """
    earlier = _earlier_slices()
    placed = summaries.select(
        "*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("scans_before"),
        F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("threats_before"),
    )
    carried = placed.withColumn(
        "carry", F.col("scans_before") - F.coalesce(F.max(F.col("scans_before") + F.col("broken")).over(earlier), F.lit(0))
    )

    def nth(n: Column) -> Column:
        return F.get("firsts", n - 1)

    reached = {
        badge: F.when((F.col("scans_before") < n) & (F.col("scans_before") + F.col("n") >= n), nth(F.lit(n) - F.col("scans_before")))
        for badge, n in milestones.items()
    }
    enough = F.filter("hits", lambda h: h["threats"] + F.col("threats_before") >= rules.THREAT_HUNTER_TOTAL)
    reached["threat_hunter"] = F.when(F.col("threats_before") < rules.THREAT_HUNTER_TOTAL, F.get(enough, F.lit(0))["created_at"])
    reached["eagle_eye"] = F.col("critical")
    long_enough = (F.col("lead") > 0) & (F.col("carry") + F.col("lead") >= rules.CLEAN_SLATE_RUN)
    missing = F.greatest(F.lit(rules.CLEAN_SLATE_RUN) - F.col("carry"), F.lit(1))
    reached["clean_slate"] = F.when(long_enough, nth(missing)).otherwise(F.col("run_at"))
    users = carried.groupBy("user_id").agg(
        *[F.min(time).alias(badge) for badge, time in reached.items()], F.flatten(F.collect_list("formats")).alias("formats")
    )
    # Slices give a user's formats in any order: the first use of each, then the time of the n-th.
    kinds = F.array_distinct(F.transform("formats", lambda f: f["file_format"]))
    first_uses = F.array_sort(F.transform(
        kinds, lambda k: F.array_min(F.transform(F.filter("formats", lambda f: f["file_format"] == k), lambda f: f["created_at"]))
    ))
    explorer = F.get(first_uses, F.lit(rules.FORMAT_EXPLORER_DISTINCT - 1)).alias("format_explorer")
    wide = users.select("user_id", *reached, explorer)
    pairs = F.array(*[F.struct(F.lit(b).alias("badge_key"), F.col(b).alias("earned_at")) for b in (*reached, "format_explorer")])
    return wide.select("user_id", F.explode(F.filter(pairs, lambda p: p["earned_at"].isNotNull())).alias("p")).select("user_id", "p.*")


def all_scan_badges(records: DataFrame, milestones: dict[str, int] = rules.SCAN_MILESTONES) -> DataFrame:
    """Every badge that scans earn, clean slate included, from one pass over the records."""
    return scan_badges_of_slices(slice_summaries(records, milestones), milestones)


def merged_badges(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Each badge of a user once: as held before, else at the earliest time; ``fresh`` tells which are new."""
    keys = ["user_id", "badge_key"]
    both = candidates.select(*keys, "earned_at", F.lit(True).alias("fresh")).unionByName(
        existing.select(*keys, "earned_at", F.lit(False).alias("fresh"))
    )
    return both.groupBy(*keys).agg(F.min(F.struct("fresh", "earned_at")).alias("first")).select(*keys, "first.earned_at", "first.fresh")


def newly_awarded(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates the user does not hold yet, each once, at the earliest time."""
    keys = ["user_id", "badge_key"]
    fresh = candidates.groupBy(*keys).agg(F.min("earned_at").alias("earned_at"))
    return fresh.join(existing.select(*keys), keys, "left_anti")


def _definitions() -> Column:
    return F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(i).alias("icon"), F.lit(d).alias("description"))
        for k, n, i, d in rules.BADGES
    ])


def badges_of_users(users: DataFrame, badges: DataFrame) -> DataFrame:
    """For every user the whole catalogue with an earned flag, plus earned badges outside it.

    Users and earned badges meet as narrow rows, one aggregation per user; the catalogue is laid
    out behind it, where it costs no memory. What is gathered per user is one entry per badge.
    """
    earned = badges.groupBy("user_id", "badge_key").agg(F.min("earned_at").cast("timestamp_ntz").alias("earned_at"))
    listed = users.select(F.col("id").alias("user_id"), F.lit(True).alias("listed"), F.lit(None).alias("held"))
    rows = listed.unionByName(earned.select("user_id", F.lit(False).alias("listed"), F.struct("badge_key", "earned_at").alias("held")))
    # Dealt out before it is aggregated: hardly any two rows of one task are of one user.
    of_user = rows.repartition("user_id").groupBy("user_id").agg(F.bool_or("listed").alias("listed"), F.collect_list("held").alias("held"))

    def time_of(key: Column) -> Column:
        return F.get(F.filter("held", lambda h: h["badge_key"] == key), F.lit(0))["earned_at"]

    def entry(key: Column, name: Column, icon: Column, description: Column, earned_at: Column) -> Column:
        return F.struct(key.alias("key"), name.alias("name"), icon.alias("icon"), description.alias("description"), earned_at.alias("earned_at"))

    of_catalogue = F.filter(_definitions(), lambda d: F.col("listed") | F.exists("held", lambda h: F.coalesce(h["badge_key"] == d["key"], F.lit(False))))
    others = F.filter("held", lambda h: ~F.coalesce(h["badge_key"].isin([k for k, *_ in rules.BADGES]), F.lit(False)))
    entries = F.concat(
        F.transform(of_catalogue, lambda d: entry(d["key"], d["name"], d["icon"], d["description"], time_of(d["key"]))),
        F.transform(others, lambda h: entry(h["badge_key"], h["badge_key"], F.lit(rules.BADGE_FALLBACK_ICON), F.lit(""), h["earned_at"])),
    )
    laid_out = of_user.select("user_id", F.explode(entries).alias("d")).select("user_id", "d.*")
    return laid_out.withColumn("earned", F.col("earned_at").isNotNull())


def badge_catalog(badges: DataFrame) -> DataFrame:
    """The catalogue with the number of users who hold each badge."""
    catalogue = badges.sparkSession.range(1).select(F.posexplode(_definitions()).alias("position", "d"))
    zeros = catalogue.select(F.col("d.key").alias("badge_key"), F.lit(0).alias("one"))
    counts = badges.select("badge_key", F.lit(1).alias("one")).unionByName(zeros).groupBy("badge_key").agg(
        F.sum("one").alias("holders")
    )
    # Eight rows after the aggregation, whatever the number of users.
    known = F.get(F.filter(_definitions(), lambda d: d["key"] == F.col("badge_key")), F.lit(0))
    return counts.select("holders", known.alias("d")).filter(F.col("d").isNotNull()).select("d.*", "holders")


def top_users(records: DataFrame, users: DataFrame, size: int = 10) -> DataFrame:
    """Users with most scans (ties by id): rank, user_id, email, scan_count, threat_count."""
    counters = records.groupBy("user_id").agg(
        F.count("*").alias("scan_count"), F.sum(F.size("findings")).alias("threat_count")
    )
    everyone = users.select(F.col("id").alias("user_id"), "email").join(counters, "user_id", "left").select(
        "user_id", "email", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scan_count", "threat_count")]
    )
    top = everyone.orderBy(F.desc("scan_count"), "user_id").limit(size)
    # At most ``size`` rows: ranking them in one partition is fine.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("scan_count"), "user_id")))


def stored_top(top: DataFrame) -> DataFrame:
    """The few rows of ``top_users`` as a table of their own, so that they are found once."""
    return top.sparkSession.createDataFrame(top.collect(), top.schema)


def leaderboard(top: DataFrame, badges: DataFrame) -> DataFrame:
    """Top users with masked address and badge count; ``badges`` need only hold those of the top users."""
    held = badges.groupBy("user_id").agg(F.count("*").alias("badge_count"))
    return top.join(held, "user_id", "left").select(
        "rank", "user_id", text_functions.mask_email(F.col("email")).alias("email_masked"), "scan_count", "threat_count",
        F.coalesce("badge_count", F.lit(0)).alias("badge_count"),
    )
