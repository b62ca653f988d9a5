"""User rows: profiles, attribution of scans, cleaning of registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphwarden.functions import text as text_functions


def user_profile(users: DataFrame, counters: DataFrame) -> DataFrame:
    joined = users.join(counters.withColumnRenamed("user_id", "id"), "id", "left")
    return joined.select(
        "id", "email", "role", (F.length(F.coalesce("api_key", F.lit(""))) > 0).alias("has_api_key"),
        F.coalesce("scan_count", F.lit(0)).alias("scan_count"), F.coalesce("threat_count", F.lit(0)).alias("threat_count"),
        text_functions.iso_timestamp(F.col("created_at")).alias("created_at"),
    )


def _spread_missing(key: Column, row_id: Column) -> Column:
    """Join key whose missing values do not all meet in one partition (they match nothing)."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.concat(F.lit("-"), (row_id % 1009).cast("string")))


def identify_scans(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Add user_id: the claimed user (null if unknown); the owner of the API key only where no user is claimed.

    ``scans`` has id, claimed_user_id and api_key. Busy users are left to the adaptive
    skew-join handling; anonymous scans are spread before the joins.
    """
    by_id = users.select(_spread_missing(F.col("id"), F.lit(0)).alias("_by_id"), F.col("id").alias("_id_user"))
    keyed = users.filter(F.length("api_key") > 0)
    by_key = keyed.select(_spread_missing(F.col("api_key"), F.lit(0)).alias("_by_key"), F.col("id").alias("_key_user"))
    prepared = scans.withColumn("_by_id", _spread_missing(F.col("claimed_user_id"), F.col("id"))).withColumn(
        "_by_key", _spread_missing(F.nullif("api_key", F.lit("")), F.col("id"))
    )
    joined = prepared.join(by_id, "_by_id", "left").join(by_key, "_by_key", "left")
    return joined.withColumn(
        "user_id", F.when(F.col("claimed_user_id").isNotNull(), F.col("_id_user")).otherwise(F.col("_key_user"))
    ).drop(
        "_by_id", "_by_key", "_id_user", "_key_user"
    )


def clean_accounts(registrations: DataFrame) -> DataFrame:
    """Registrations (id, email) with normalised address and, where refused, the reason.

    Of several registrations of one address the lowest id wins. The winners come from a
    combining aggregation and are matched by id, so one popular address stays cheap.
    """
    email = F.lower(text_functions.strip(F.coalesce("email", F.lit(""))))
    reason = F.when(email == "", "Email is required").when(~email.contains("@"), "Invalid email address")
    checked = registrations.withColumn("email", email).withColumn("reason", reason)
    winners = checked.filter(F.col("reason").isNull()).groupBy("email").agg(F.min("id").alias("id"))
    judged = checked.join(winners.select("id", F.lit(True).alias("_first")), "id", "left")
    return judged.withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_first").isNull(), "Email already registered"))
    ).drop("_first")
