"""Per-user and global statistics of scan records.

Everything is a group aggregation with a map-side part, so a user with a large share of
all records costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwarden import rules
from glyphwarden.functions import text as text_functions

DEFAULT_TREND_DAYS = 14


def trend_days(days: int | None) -> int:
    return min(90, max(7, DEFAULT_TREND_DAYS if days is None else days))


def _blocked() -> Column:
    return F.count_if(F.col("verdict") == "BLOCKED")


def _allowed() -> Column:
    return F.count_if(F.col("verdict") == "ALLOWED")


def avg_risk(records: DataFrame) -> DataFrame:
    mean = F.coalesce(F.avg("risk_score"), F.lit(0.0))
    return records.groupBy("user_id").agg(F.bround(mean, 1).alias("avg_risk_score"))


def category_counts(records: DataFrame) -> DataFrame:
    """(user_id, category, n, first_id, first_pos): where the user met the category first.

    Findings are counted within their record before anything is shuffled.
    """
    categories = F.transform("findings", lambda f: F.coalesce(f["category"], F.lit("Unknown")))
    listed = records.select("user_id", "id", categories.alias("categories"))
    per_record = listed.select("user_id", "id", "categories", F.explode(F.array_distinct("categories")).alias("category"))
    counted = per_record.select(
        "user_id", "id", "category",
        F.size(F.filter("categories", lambda c: c == F.col("category"))).alias("n"),
        F.array_position("categories", F.col("category")).alias("pos"),
    )
    return counted.groupBy("user_id", "category").agg(
        F.sum("n").alias("n"), F.min("id").alias("first_id"), F.min_by("pos", "id").alias("first_pos")
    )


def top_category(records: DataFrame) -> DataFrame:
    """Most frequent category per user; ties go to the one met first."""
    best = F.min(F.struct((-F.col("n")).alias("rank"), "first_id", "first_pos", "category"))
    return category_counts(records).groupBy("user_id").agg(best.alias("best")).select(
        "user_id", F.col("best.category").alias("top_category"), (-F.col("best.rank")).alias("top_count")
    )


def category_breakdown(records: DataFrame) -> DataFrame:
    """Counts per user and category, numbered in the order the categories were first met."""
    order = Window.partitionBy("user_id").orderBy("first_id", "first_pos")  # at most one row per category
    return category_counts(records).select(
        "user_id", "category", "n", F.row_number().over(order).alias("label_position")
    )


def user_summary(records: DataFrame, users: DataFrame) -> DataFrame:
    """Totals, block rate, mean risk, number of threats and top category for every user."""
    totals = records.groupBy("user_id").agg(
        F.count("*").alias("total"), _blocked().alias("blocked"), F.avg("risk_score").alias("mean"),
        F.sum(F.size("findings")).alias("threats"),
    )
    tops = top_category(records).select("user_id", "top_category")
    everyone = (
        users.select(F.col("id").alias("user_id")).join(totals, "user_id", "left").join(tops, "user_id", "left")
    )
    total, blocked = F.coalesce("total", F.lit(0)), F.coalesce("blocked", F.lit(0))
    return everyone.select(
        "user_id", total.alias("total_scans"), blocked.alias("blocked"), (total - blocked).alias("allowed"),
        text_functions.percent_of(blocked, total).alias("blocked_pct"),
        F.bround(F.coalesce("mean", F.lit(0.0)), 1).alias("avg_risk_score"),
        F.coalesce("threats", F.lit(0)).alias("total_threats"),
        F.coalesce("top_category", F.lit("None")).alias("top_category"),
    )


def daily_trends(records: DataFrame, now: Column, days: int | None = None) -> DataFrame:
    """Counts per user and day since ``now`` minus the clamped number of days."""
    since = now - F.make_dt_interval(F.lit(trend_days(days)))
    recent = records.filter(F.col("created_at") >= since)
    return recent.groupBy("user_id", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("total"), _blocked().alias("blocked"), _allowed().alias("allowed")
    )


def trend_gapfill(records: DataFrame, users: DataFrame, now: Column, days: int | None = None) -> DataFrame:
    """Exactly N days per user ending today, days without scans as zeros.

    Zero rows are added before a second sum instead of joining calendars to counts.
    """
    n = trend_days(days)
    today = F.to_date(now)
    first = F.date_sub(today, n - 1)
    calendar = F.explode(F.sequence(first, today, F.expr("interval 1 day"))).alias("day")
    zeros = users.select(F.col("id").alias("user_id"), calendar).select(
        "user_id", "day", *[F.lit(0).cast("bigint").alias(c) for c in ("total", "blocked", "allowed")]
    )
    counted = daily_trends(records, now, days).filter(F.col("day").between(first, today))
    known = counted.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return zeros.unionByName(known).groupBy("user_id", "day").agg(
        *[F.sum(c).alias(c) for c in ("total", "blocked", "allowed")]
    )


def global_stats(records: DataFrame, users: DataFrame) -> DataFrame:
    """One row: scans, blocked scans, registered users, block rate."""
    scans = records.select(
        F.lit(1).alias("scan"), F.when(F.col("verdict") == "BLOCKED", 1).otherwise(0).alias("block"), F.lit(0).alias("user")
    )
    accounts = users.select(F.lit(0).alias("scan"), F.lit(0).alias("block"), F.lit(1).alias("user"))
    totals = scans.unionByName(accounts).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in
          (("scan", "total_scans"), ("block", "total_blocked"), ("user", "total_users"))]
    )
    return totals.withColumn(
        "blocked_pct", text_functions.percent_of(F.col("total_blocked"), F.col("total_scans"))
    )


def risk_histogram(records: DataFrame) -> DataFrame:
    """Scans per risk bucket; empty buckets stay."""
    bucket = F.greatest(F.least(F.floor(F.col("risk_score") / 20), F.lit(4)), F.lit(0)).cast("int")
    zeros = records.sparkSession.range(len(rules.RISK_BUCKETS)).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).alias("one")
    )
    counted = records.select(bucket.alias("bucket"), F.lit(1).alias("one")).unionByName(zeros)
    labels = F.array(*[F.lit(label) for label in rules.RISK_BUCKETS])
    return counted.groupBy("bucket").agg(F.sum("one").alias("scans")).select(
        "bucket", F.get(labels, F.col("bucket")).alias("label"), "scans"
    )
