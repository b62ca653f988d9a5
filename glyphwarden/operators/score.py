"""Scores, verdicts and result projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from glyphwarden import rules

VIEW_DDL = "array<struct<category:string,description:string,severity:string,evidence:string,page:int,confidence:int>>"
SUMMARY_DDL = "struct<CRITICAL:int,HIGH:int,MEDIUM:int,LOW:int>"
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def risk_score(findings: Column) -> Column:
    """Sum of severity weight x confidence, capped at 100, fraction dropped.

    A left fold over doubles in finding order: the fraction decides at the threshold, so
    neither decimals nor a shuffled sum would do.
    """
    weights = F.array(*[F.lit(float(rules.SEVERITY_WEIGHT[s])) for s in ["LOW", "MEDIUM", "HIGH", "CRITICAL"]])
    total = F.aggregate(
        findings, F.lit(0.0), lambda acc, f: acc + F.element_at(weights, f["severity_level"]) * f["confidence"]
    )
    return F.floor(F.least(total, F.lit(100.0))).cast("int")


def verdict(score: Column, threshold: int = rules.BLOCK_THRESHOLD) -> Column:
    return F.when(score >= threshold, "BLOCKED").otherwise("ALLOWED")


def threat_summary(findings: Column) -> Column:
    """Findings per severity; all four keys always present."""
    def count_of(severity: str) -> Column:
        return F.size(F.filter(findings, lambda f: f["severity"] == severity)).alias(severity)

    return F.struct(*[count_of(severity) for severity in SEVERITIES])


def findings_view(findings: Column) -> Column:
    """Output form: severity by name, evidence cut to 200 characters, confidence in percent."""
    return F.transform(
        findings,
        lambda f: F.struct(
            f["category"].alias("category"),
            f["description"].alias("description"),
            f["severity"].alias("severity"),
            F.left(f["evidence"], F.lit(200)).alias("evidence"),
            f["page"].alias("page"),
            F.rint(f["confidence"] * 100).cast("int").alias("confidence"),
        ),
    )


def scored(df: DataFrame, threshold: int = rules.BLOCK_THRESHOLD) -> DataFrame:
    """Add risk_score, verdict and threat_summary to documents with ``findings``."""
    return (
        df.withColumn("risk_score", risk_score(F.col("findings")))
        .withColumn("verdict", verdict(F.col("risk_score"), threshold))
        .withColumn("threat_summary", threat_summary(F.col("findings")))
    )


def blocked(df: DataFrame) -> DataFrame:
    return df.filter(F.col("verdict") == "BLOCKED")


def summary_pivot(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """threat_summary from finding rows: one row per key, four severity counts."""
    counts = findings.groupBy(*keys).pivot("severity", SEVERITIES).count().na.fill(0, SEVERITIES)
    return counts.select(*keys, *[F.col(s).cast("int").alias(s) for s in SEVERITIES])


def scan_result(df: DataFrame) -> DataFrame:
    """The result row of a scanned document, findings in output form."""
    return df.select(
        "doc_id", "filename", "file_format", "verdict", "risk_score", "total_pages", "text_length",
        "metadata_scanned", findings_view(F.col("findings")).alias("findings"), "threat_summary",
    )


def threat_count(findings: Column) -> Column:
    return F.size(findings)


def encode_records(df: DataFrame) -> DataFrame:
    """Findings and summary as JSON text, the stored form."""
    return (
        df.withColumn("findings_json", F.to_json("findings", {"ignoreNullFields": "false"}))
        .withColumn("threat_summary_json", F.to_json("threat_summary"))
        .drop("findings", "threat_summary")
    )


def decode_records(df: DataFrame) -> DataFrame:
    """Stored JSON text back to native columns."""
    return (
        df.withColumn("findings", F.from_json("findings_json", VIEW_DDL))
        .withColumn("threat_summary", F.from_json("threat_summary_json", SUMMARY_DDL))
        .drop("findings_json", "threat_summary_json")
    )
