"""One call over uploads of mixed kinds: flat texts in one pass, or each kind with its own content and scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from glyphwarden import rules
from glyphwarden.functions import html
from glyphwarden.operators import detect, documents as scans, large, score
from glyphwarden.sources import routing

RESULT_COLUMNS = [
    "doc_id", "filename", "stored_format", "file_format", "verdict", "risk_score", "total_pages", "text_length",
    "metadata_scanned", "findings", "threat_summary",
]


def scan_uploads(uploads: DataFrame, threshold: int = rules.BLOCK_THRESHOLD) -> DataFrame:
    """Scan uploads (doc_id, filename, text) by kind; unsupported ones become error rows.

    ``text`` is the extracted content: one page, one paragraph or cell per line, markup, or
    plain text. All kinds share one pass over the rows, without a shuffle: what differs
    between kinds is which text is scanned and which extra detectors apply.
    """
    accepted, rejected = routing.split_rejects(routing.admit(uploads))
    kind = F.col("kind")
    markup = accepted.withColumn("_html", html.parse(F.when(kind == "html", F.col("text"))))
    values = F.filter(F.split("text", "\n", -1), lambda v: ~v.isin("", "0", "False"))
    prepared = markup.withColumn("_cells", F.when(kind == "cells", values)).withColumn(
        "_body",
        F.when(kind == "paged", F.concat("text", F.lit("\n")))
        .when(kind == "cells", F.array_join("_cells", "\n"))
        .when(kind == "html", F.col("_html.text"))
        .otherwise(F.col("text")),
    )
    found = detect.with_findings(
        prepared.withColumn("text_length", F.char_length("_body")),
        "_body",
        first=[
            F.when(kind == "cells", detect.formulas(F.col("_cells"))).otherwise(detect.no_findings()),
            F.when(kind == "html", detect.hidden_elements(F.col("_html.hidden"))).otherwise(detect.no_findings()),
            detect.scripts("_html.scripts", "_html.script_injection", "_html.script_exfil"),
        ],
        after_invisible=[
            F.when(kind.isin("paged", "parts", "plain"), detect.anomalies(F.col("text"), other="_screen.other")).otherwise(detect.no_findings())
        ],
    )
    results = score.scored(
        found.withColumn("file_format", F.col("scan_format"))
        .withColumn("total_pages", F.when(kind == "parts", 0).otherwise(1))
        .withColumn("metadata_scanned", kind == "paged"),
        threshold,
    )
    errors = rejected.select("doc_id", "filename", "error")
    return results.select(*RESULT_COLUMNS).unionByName(errors, allowMissingColumns=True)


_RESULT = ["doc_id", "risk_score", "verdict", "threat_summary", "n_findings", "total_pages", "text_length"]


def scan_files(
    listing: DataFrame,
    *,
    pages: DataFrame | None = None,
    parts: DataFrame | None = None,
    cells: DataFrame | None = None,
    markup: DataFrame | None = None,
    texts: DataFrame | None = None,
    metadata: DataFrame | None = None,
    properties: DataFrame | None = None,
    threshold: int = rules.BLOCK_THRESHOLD,
) -> large.RowScan:
    """Scan the files of a listing (doc_id, filename), each kind by its own scan of its own content.

    Content comes by kind: ``pages`` (doc_id, page, text), ``parts`` (doc_id, kind, ordinal, text), ``cells``
    (doc_id, sheet, row, col, value, ...), ``markup`` (doc_id, html), ``texts`` (doc_id, text). Only
    content of listed files of that kind is scanned; a file without content is an empty document.
    ``documents`` has one row per named file (unsupported ones with ``error``), ``findings`` one per finding.
    """
    # The kind is bound, so that each name is routed once: filters by it would repeat that for every row the listing is made from.
    routed = detect.bound(routing.admit(listing).withColumnRenamed("kind", "_kind"), "kind", F.col("_kind"))
    accepted, rejected = routed.filter("kind IS NOT NULL"), routed.filter("kind IS NULL")

    def listed(kind: str) -> DataFrame:
        return accepted.filter(F.col("kind") == kind).select("doc_id")

    def of_kind(content: DataFrame, kind: str) -> DataFrame:
        return content.join(listed(kind), "doc_id", "left_semi")

    def whole(scanned: DataFrame) -> large.RowScan:
        rows = scanned.withColumn("n_findings", F.size("findings")).withColumn("text_length", F.col("text_length").cast("long"))
        return large.RowScan(rows, lambda: detect.finding_rows(scanned, ["doc_id"]))

    scanned = []
    if pages is not None:
        scanned.append(scans.scan_page_rows(pages, metadata, threshold, listed=listed("paged")))
    if parts is not None:
        scanned.append(scans.scan_part_rows(parts, properties, threshold, listed=listed("parts")))
    if cells is not None:
        scanned.append(scans.scan_cell_rows(cells, threshold, listed=listed("cells")))
    if markup is not None:
        scanned.append(whole(scans.scan_html(of_kind(markup, "html").select("doc_id", "html"), threshold)))
    if texts is not None:
        scanned.append(whole(scans.scan_plain(of_kind(texts, "plain").select("doc_id", "text"), threshold)))
    results = reduce(DataFrame.unionByName, [s.documents.select(*_RESULT) for s in scanned])
    nothing = F.struct(*[F.lit(0).alias(s) for s in score.SEVERITIES])
    known = accepted.select("doc_id", "filename", "stored_format", F.col("scan_format").alias("file_format"), "kind")
    documents = known.join(results, "doc_id", "left").select(
        "doc_id", "filename", "stored_format", "file_format", F.coalesce("verdict", score.verdict(F.lit(0), threshold)).alias("verdict"),
        F.coalesce("risk_score", F.lit(0)).alias("risk_score"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
        F.coalesce("total_pages", F.when(F.col("kind").isin("html", "plain"), 1).otherwise(0)).alias("total_pages"),
        F.coalesce("text_length", F.lit(0)).cast("long").alias("text_length"), (F.col("kind") == "paged").alias("metadata_scanned"),
        F.coalesce("threat_summary", nothing).alias("threat_summary"),
    )
    errors = rejected.select("doc_id", "filename", "error")
    return large.RowScan(
        documents.unionByName(errors, allowMissingColumns=True), lambda: reduce(DataFrame.unionByName, [s.findings for s in scanned])
    )
