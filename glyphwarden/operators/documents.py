"""Whole-document scans, one function per kind of document.

Each takes the rows of its source and returns one row per document: identification,
``findings``, ``risk_score``, ``verdict``, ``threat_summary`` and the measures of the
result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphwarden import rules
from glyphwarden.operators import detect, large, score
from glyphwarden.sources import documents as sources


def _name(extension: str) -> Column:
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(f".{extension}"))


def _described(
    df: DataFrame, file_format: str | Column, total_pages: Column, metadata_scanned: bool, threshold: int,
    filename: Column | None = None,
) -> DataFrame:
    if filename is None and "filename" not in df.columns:
        filename = _name(file_format)
    if filename is not None:
        df = df.withColumn("filename", filename)
    described = df.withColumn(
        "file_format", file_format if isinstance(file_format, Column) else F.lit(file_format)
    ).withColumn("total_pages", total_pages.cast("int"))
    return score.scored(
        described.withColumn("metadata_scanned", F.lit(metadata_scanned)), threshold
    )


def _measured(df: DataFrame) -> DataFrame:
    return df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("text_length", F.char_length("text"))


def _of_own(values: DataFrame) -> DataFrame:
    """Values per document, for a join with its text. They grow with the documents and are small as stored: always merged,
    as the driver could not hold them."""
    return values.hint("merge")


def _of_listed(texts: DataFrame, listed: DataFrame | None) -> DataFrame:
    """The documents named by a listing (doc_id), if there is one; it meets assembled documents, not their rows."""
    return texts if listed is None else texts.join(listed, "doc_id", "left_semi")


def scan_text(df: DataFrame, threshold: int = rules.BLOCK_THRESHOLD) -> DataFrame:
    """Raw texts (doc_id, text): no file, no line anomalies."""
    found = detect.with_findings(_measured(df)).drop("text")
    return _described(found, "text", F.lit(1), False, threshold, F.lit("<playground>"))


def scan_plain(df: DataFrame, threshold: int = rules.BLOCK_THRESHOLD) -> DataFrame:
    """Plain-text files (doc_id, text[, filename, file_format])."""
    found = detect.with_findings(_measured(df), after_invisible=[detect.anomalies(F.col("text"), other="_screen.other")]).drop("text")
    file_format = F.col("file_format") if "file_format" in df.columns else "txt"
    return _described(found, file_format, F.lit(1), False, threshold)


def scan_pages(
    pages: DataFrame, metadata: DataFrame | None = None, threshold: int = rules.BLOCK_THRESHOLD, listed: DataFrame | None = None
) -> DataFrame:
    """Paged documents (doc_id, page, text), optionally with metadata fields per document."""
    texts = _measured(_of_listed(sources.paged_texts(pages), listed))
    if metadata is not None:
        texts = texts.join(_of_own(metadata.select("doc_id", *rules.METADATA_FIELDS)), "doc_id", "left")
    after = [detect.page_anomalies(F.col("pages"), "_screen.other")]
    if metadata is not None:
        after.insert(0, detect.metadata(rules.METADATA_FIELDS))
    found = detect.with_findings(texts, after_invisible=after, ends="ends")
    found = found.drop("text", "pages", "ends", *rules.METADATA_FIELDS)
    return _described(found, "pdf", F.col("total_pages"), True, threshold)


def scan_parts(
    parts: DataFrame, properties: DataFrame | None = None, threshold: int = rules.BLOCK_THRESHOLD, listed: DataFrame | None = None
) -> DataFrame:
    """Paragraph documents (doc_id, kind, ordinal, text), optionally with core properties."""
    texts = _measured(_of_listed(sources.part_texts(parts), listed))
    last = []
    if properties is not None:
        prefixed = [F.col(name).alias(f"_p_{name}") for name in rules.PROPERTY_FIELDS]
        texts = texts.join(_of_own(properties.select("doc_id", *prefixed)), "doc_id", "left")
        last = [detect.properties([f"_p_{name}" for name in rules.PROPERTY_FIELDS])]
    found = detect.with_findings(texts, after_invisible=[detect.anomalies(F.col("text"), other="_screen.other")], last=last)
    found = found.drop("text", *[f"_p_{name}" for name in rules.PROPERTY_FIELDS])
    return _described(found, "docx", F.lit(0), False, threshold)


def scan_cells(cells: DataFrame, threshold: int = rules.BLOCK_THRESHOLD, listed: DataFrame | None = None) -> DataFrame:
    """Workbooks (doc_id, sheet, row, col, value)."""
    texts = _measured(_of_listed(sources.cell_texts(cells), listed))
    found = detect.with_findings(texts, first=[detect.formulas(F.col("cell_values"))]).drop("text", "cell_values")
    return _described(found, "xlsx", F.col("total_pages"), False, threshold)


def scan_html(pages: DataFrame, threshold: int = rules.BLOCK_THRESHOLD) -> DataFrame:
    """Web pages (doc_id, html)."""
    texts = _measured(sources.html_texts(pages))
    found = detect.with_findings(
        texts,
        first=[
            detect.hidden_elements(F.col("hidden")),
            detect.scripts("scripts", "script_injection", "script_exfil"),
        ],
    ).drop("text", "hidden", "scripts", "script_injection", "script_exfil")
    return _described(found, "html", F.lit(1), False, threshold)


# ---------------------------------------------------------------- documents of any size

SUMMARY_COLUMNS = ["doc_id", "risk_score", "verdict", "threat_summary", "n_findings", "total_pages", "text_length"]


def _in_place(scanned: DataFrame) -> large.RowScan:
    """Documents that have their findings in the row."""
    rows = scanned.select(
        *[c for c in SUMMARY_COLUMNS if c not in ("n_findings", "text_length")], F.size("findings").alias("n_findings"),
        F.col("text_length").cast("long").alias("text_length"),
    )
    return large.RowScan(rows, lambda: detect.finding_rows(scanned, ["doc_id"]))


def _both(small: large.RowScan, big: large.RowScan) -> large.RowScan:
    documents = small.documents.unionByName(big.documents.select(*small.documents.columns))
    return large.RowScan(documents, lambda: small.findings.unionByName(big.findings))


def scan_page_rows(
    pages: DataFrame, metadata: DataFrame | None = None, threshold: int = rules.BLOCK_THRESHOLD,
    slice_rows: int = large.SLICE_ROWS, block_bytes: int = large.BLOCK_BYTES, listed: DataFrame | None = None,
) -> large.RowScan:
    """Paged documents (doc_id, page, text), however many pages one has: scored documents and finding rows."""
    small, big = large.divided(pages, "text", block_bytes, listed)
    own = None if metadata is None else large.of_larger(metadata, pages, "text", block_bytes)
    found = None if own is None else own.select("doc_id", detect.metadata(rules.METADATA_FIELDS).alias("findings"))
    scan = large.scan_rows(
        large.page_rows(big, slice_rows), paged=True, metadata=found, threshold=threshold, block_bytes=block_bytes
    )
    documents = scan.documents.withColumn("total_pages", F.col("n_rows").cast("int"))
    return _both(_in_place(scan_pages(small, metadata, threshold, listed)), large.RowScan(documents, lambda: scan.findings))


def scan_part_rows(
    parts: DataFrame, properties: DataFrame | None = None, threshold: int = rules.BLOCK_THRESHOLD,
    slice_rows: int = large.SLICE_ROWS, block_bytes: int = large.BLOCK_BYTES, listed: DataFrame | None = None,
) -> large.RowScan:
    """Paragraph documents (doc_id, kind, ordinal, text), however many paragraphs one has."""
    small, big = large.divided(parts, "text", block_bytes, listed)
    own = None if properties is None else large.of_larger(properties, parts, "text", block_bytes)
    found = None if own is None else own.select("doc_id", detect.properties(rules.PROPERTY_FIELDS).alias("findings"))
    scan = large.scan_rows(large.part_rows(big, slice_rows), properties=found, threshold=threshold, block_bytes=block_bytes)
    documents = scan.documents.withColumn("total_pages", F.lit(0))
    return _both(_in_place(scan_parts(small, properties, threshold, listed)), large.RowScan(documents, lambda: scan.findings))


def scan_cell_rows(
    cells: DataFrame, threshold: int = rules.BLOCK_THRESHOLD,
    slice_rows: int = large.SLICE_ROWS, block_bytes: int = large.BLOCK_BYTES, listed: DataFrame | None = None,
) -> large.RowScan:
    """Workbooks (doc_id, sheet, row, col, value[, sheet_no, cell_type]), however many cells one has."""
    small, big = large.divided(cells, "value", block_bytes, listed)
    scan = large.scan_rows(
        large.cell_rows(big, slice_rows), anomalies=False, formulas=True, threshold=threshold, block_bytes=block_bytes
    )
    # A workbook without any text counts too, and so do its sheets.
    totals = big.groupBy("doc_id").agg(F.count_distinct("sheet").cast("int").alias("total_pages"))
    nothing = F.struct(*[F.lit(0).alias(s) for s in score.SEVERITIES])
    documents = totals.join(scan.documents, "doc_id", "left").select(
        "doc_id", "total_pages", F.coalesce("risk_score", F.lit(0)).alias("risk_score"),
        F.coalesce("verdict", score.verdict(F.lit(0), threshold)).alias("verdict"),
        F.coalesce("threat_summary", nothing).alias("threat_summary"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.coalesce("text_length", F.lit(0)).alias("text_length"),
    )
    return _both(_in_place(scan_cells(small, threshold, listed)), large.RowScan(documents, lambda: scan.findings))


def summarize_pages(pages: DataFrame, metadata: DataFrame | None = None, **options) -> DataFrame:
    """Score, verdict and counts of paged documents."""
    return scan_page_rows(pages, metadata, **options).documents.select(*SUMMARY_COLUMNS)


def summarize_parts(parts: DataFrame, properties: DataFrame | None = None, **options) -> DataFrame:
    """Score, verdict and counts of paragraph documents."""
    return scan_part_rows(parts, properties, **options).documents.select(*SUMMARY_COLUMNS)


def summarize_cells(cells: DataFrame, **options) -> DataFrame:
    """Score, verdict and counts of workbooks."""
    return scan_cell_rows(cells, **options).documents.select(*SUMMARY_COLUMNS)
