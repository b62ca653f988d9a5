"""Scan history: filters, pages, single records, export and erasure."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwarden.functions import text as text_functions
from glyphwarden.operators import score

DEFAULT_PAGE_SIZE = 15
MAX_PAGE_SIZE = 50


def page_number(page: int | None) -> int:
    return max(1, 1 if page is None else page)


def page_size(per_page: int | None) -> int:
    return min(MAX_PAGE_SIZE, max(1, DEFAULT_PAGE_SIZE if per_page is None else per_page))


def filtered(
    records: DataFrame, user_id: int | None = None, q: str = "", verdict: str = "", file_format: str = ""
) -> DataFrame:
    """Records by owner, part of the file name, verdict and format.

    The name part is a case-insensitive LIKE pattern, so '%' and '_' in it are wildcards; a backslash
    stands for itself.
    Unknown verdicts are ignored. ``user_id`` None keeps all owners.
    """
    if user_id is not None:
        records = records.filter(F.col("user_id") == user_id)
    if q.strip():
        part = q.strip().replace("\\", "\\\\")
        records = records.filter(F.col("filename").ilike(f"%{part}%"))
    if verdict.upper() in ("BLOCKED", "ALLOWED"):
        records = records.filter(F.col("verdict") == verdict.upper())
    if file_format:
        records = records.filter(F.col("file_format") == file_format.lower())
    return records


def page_of_user(records: DataFrame, user_id: int, page: int | None = None, per_page: int | None = None) -> DataFrame:
    """One page of one user's history, newest first (ties by id, descending)."""
    size = page_size(per_page)
    newest = filtered(records, user_id).orderBy(F.desc("created_at"), F.desc("id"))
    return newest.offset((page_number(page) - 1) * size).limit(size)


# Up to here Spark drops surplus rows of a rank before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
SHALLOW_ROWS = 1000
_MICROS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}


def page_of_all_users(records: DataFrame, page: int | None = None, per_page: int | None = None) -> DataFrame:
    """The same page for every user at once, with ``position`` (from 1); newest first, ties by id, descending.

    Near the front the upper bound on the rank lets Spark drop surplus rows before the shuffle, so
    a user with very many records sends at most page x size rows per task. Pages further back
    are found by ``deep_page_of_all_users``, with the same result.
    """
    number, size = page_number(page), page_size(per_page)
    if number * size > SHALLOW_ROWS:
        return deep_page_of_all_users(records, number, size)
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    ranked = records.withColumn("position", F.row_number().over(newest))
    return ranked.filter((F.col("position") <= number * size) & (F.col("position") > (number - 1) * size))


def deep_page_of_all_users(
    records: DataFrame, page: int | None = None, per_page: int | None = None, units: Sequence[str] = ("day", "minute")
) -> DataFrame:
    """The same by rank selection: time slices that cannot hold the page are never ranked.

    A directory counts the records of each user and slice (map-side, keys only); its running
    sums, newest slice first, tell which slices the page lies in. Within these the next finer unit
    is counted, and only the records of the last slices found are ranked.
    """
    number, size = page_number(page), page_size(per_page)
    left = records.withColumn("_newer", F.lit(0).cast("long"))
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    keys: list[str] = []
    for level, unit in enumerate(units):
        # Records without a time come last, as in a descending order.
        left = left.withColumn(f"_slice{level}", F.coalesce(F.floor(micros / F.lit(_MICROS[unit])), F.lit(-(1 << 62))))
        group = ["user_id", *keys]
        newest = Window.partitionBy(*group).orderBy(F.desc(f"_slice{level}")).rowsBetween(Window.unboundedPreceding, -1)
        directory = left.groupBy(*group, f"_slice{level}").agg(F.count("*").alias("_n"), F.first("_newer").alias("_from"))
        newer = directory.withColumn("_newer", F.col("_from") + F.coalesce(F.sum("_n").over(newest), F.lit(0)))
        wanted = newer.filter((F.col("_newer") < number * size) & (F.col("_newer") + F.col("_n") > (number - 1) * size)).drop("_n", "_from")
        keys.append(f"_slice{level}")
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("user_id", *keys)]
        joined = left.drop("_newer").alias("l").join(wanted.alias("w"), reduce(Column.__and__, same))
        left = joined.select("l.*", "w._newer")
    inside = Window.partitionBy("user_id", *keys).orderBy(F.desc("created_at"), F.desc("id"))
    placed = left.withColumn("position", (F.col("_newer") + F.row_number().over(inside)).cast("int"))
    page_rows = placed.filter((F.col("position") <= number * size) & (F.col("position") > (number - 1) * size))
    return page_rows.drop("_newer", *keys)


def envelope(records: DataFrame, page: int | None = None, per_page: int | None = None) -> DataFrame:
    """Per user: total, page, per_page, pages, has_next, has_prev."""
    number, size = page_number(page), page_size(per_page)
    totals = records.groupBy("user_id").agg(F.count("*").alias("total"))
    pages = F.ceil(F.col("total") / size).cast("int")
    return totals.select(
        "user_id", "total", F.lit(number).alias("page"), F.lit(size).alias("per_page"), pages.alias("pages"),
        (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"),
    )


def details(records: DataFrame, requests: DataFrame) -> DataFrame:
    """Records asked for by (id, user_id); records of other users are not found."""
    return records.join(requests.select("id", "user_id"), ["id", "user_id"], "left_semi")


def erased(records: DataFrame, requests: DataFrame) -> DataFrame:
    """What remains after users erase their own records by (id, user_id)."""
    return records.join(requests.select("id", "user_id"), ["id", "user_id"], "left_anti")


def record_view(records: DataFrame, include_findings: bool = True) -> DataFrame:
    """Display form of a record; the findings column is optional."""
    columns = [c for c in records.columns if c not in ("findings", "created_at", "user_id")]
    view = [
        *columns,
        score.threat_count(F.col("findings")).alias("threat_count"),
        text_functions.iso_timestamp(F.col("created_at")).alias("created_at"),
    ]
    return records.select(*view, *(["findings"] if include_findings else []))


def export_name(record_id: Column, filename: Column, prefix: str = "scan") -> Column:
    return F.concat(F.lit(f"{prefix}_"), record_id.cast("string"), F.lit("_"), filename, F.lit(".json"))


def exported(records: DataFrame) -> DataFrame:
    """(export_name, payload): each record as indented JSON with its file name."""
    view = record_view(records)
    payload = F.to_json(F.struct(*view.columns), {"pretty": "true", "ignoreNullFields": "false"})
    return view.select(export_name(F.col("id"), F.col("filename")).alias("export_name"), payload.alias("payload"))
