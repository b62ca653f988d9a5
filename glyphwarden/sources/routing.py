"""Routing uploads by suffix and quarantining bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphwarden import rules
from glyphwarden.functions import text as text_functions


def suffix(filename: Column) -> Column:
    """Lower-cased last suffix with its dot; empty for none, for a leading and for a trailing dot."""
    base = F.substring_index(filename, "/", -1)
    last = F.substring_index(base, ".", -1)
    # Something, a dot, and something without a dot: no regular expression, as listings are routed whole.
    named = (F.length(last) > 0) & (F.length(base) > F.length(last) + 1)
    return F.when(named, F.concat(F.lit("."), F.lower(last))).when(base.isNotNull(), "")


def format_table(df: DataFrame) -> DataFrame:
    """The supported formats, as a frame of the same session."""
    return df.sparkSession.createDataFrame(rules.FORMATS, "suffix string, kind string, scan_format string")


def route(df: DataFrame, filename: str = "filename") -> DataFrame:
    """Add suffix, kind, scan_format, stored_format (suffix without its dot) and error.

    ``kind`` is null and ``error`` set for unsupported suffixes.
    """
    # Ten rows: a map literal does the lookup in place, without even a broadcast join.
    def lookup(position: int) -> Column:
        pairs = [F.lit(value) for row in rules.FORMATS for value in (row[0], row[position])]
        return F.element_at(F.create_map(*pairs), F.col("suffix"))

    allowed = ", ".join(sorted(row[0] for row in rules.FORMATS))
    routed = df.withColumn("suffix", suffix(F.col(filename)))
    routed = routed.withColumn("kind", lookup(1)).withColumn("scan_format", lookup(2))
    return routed.withColumn("stored_format", F.ltrim("suffix", F.lit("."))).withColumn(
        "error",
        F.when(
            F.col("kind").isNull(),
            F.concat(F.lit("Unsupported format '"), F.col("suffix"), F.lit(f"'. Allowed: {allowed}")),
        ),
    )


def admit(df: DataFrame) -> DataFrame:
    """Uploads worth an answer: nameless ones are skipped, the rest routed."""
    return route(df.filter(F.length("filename") > 0))


def split_rejects(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the error column."""
    return routed.filter(F.col("error").isNull()), routed.filter(F.col("error").isNotNull())


def admit_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Raw texts: stripped; blank ones get an error instead of a scan."""
    stripped = df.withColumn(text, text_functions.strip(F.coalesce(F.col(text), F.lit(""))))
    return stripped.withColumn("error", F.when(F.length(text) == 0, "No text provided"))
