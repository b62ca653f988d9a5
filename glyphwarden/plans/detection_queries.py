"""Registered queries of the sources, detectors and result projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphwarden import rules
from glyphwarden.functions import text as text_functions
from glyphwarden.operators import detect, documents as scans, score
from glyphwarden.plans import detection_sql as sql, fixtures as fx
from glyphwarden.sources import documents as sources, routing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


_ROW_COLUMNS = ["doc_id", "pos", "category", "description", "severity", "evidence", "page", "confidence"]


def _rows(df: DataFrame, findings="findings") -> DataFrame:
    return detect.finding_rows(df, ["doc_id"], findings).select(*_ROW_COLUMNS)


def _only(families: list[str], src: str = fx.DOCUMENTS_SQL, extra: dict[str, str] | None = None) -> str:
    ctes = {"src": src, **(extra or {})}
    ctes["found"] = "\nUNION ALL\n".join(f"SELECT {sql.FINDING_COLUMNS} FROM ({f})" for f in families)
    return sql.with_ctes(ctes, sql.finding_rows_sql())


# ---------------------------------------------------------------- sources

@query("src_plaintext", f"""
SELECT doc_id, concat('doc_', CAST(doc_id AS VARCHAR), '.txt') AS filename, text,
       CAST(length(text) AS INTEGER) AS text_length
FROM ({fx.DOCUMENTS_SQL})""")
def src_plaintext(spark, folder):
    return sources.plain_texts(fx.files(spark, folder)).select(
        "doc_id", "filename", "text", F.char_length("text").alias("text_length")
    )


@query("src_paged_text", f"""
SELECT doc_id, string_agg(concat(text, chr(10)), '' ORDER BY page, text) AS text, CAST(count(*) AS INTEGER) AS total_pages,
       CAST(sum(length(text) + 1) AS INTEGER) AS text_length
FROM ({fx.PAGES_SQL}) GROUP BY doc_id""")
def src_paged_text(spark, folder):
    return sources.paged_texts(fx.pages(spark, folder)).select(
        "doc_id", "text", "total_pages", F.char_length("text").alias("text_length")
    )


@query("src_paragraph_parts", f"""
SELECT doc_id, string_agg(text, chr(10) ORDER BY kind, ordinal, text) AS text FROM ({fx.PARTS_SQL}) GROUP BY doc_id""")
def src_paragraph_parts(spark, folder):
    return sources.part_texts(fx.parts(spark, folder))


_CELL_TEXTS_SQL = f"""
SELECT doc_id, CAST(count(DISTINCT sheet) AS INTEGER) AS total_pages,
  coalesce(string_agg(value, chr(10) ORDER BY sheet_no, sheet, row, col, value)
           FILTER (coalesce(value, '') <> '' AND NOT (cell_type = 'n' AND TRY_CAST(value AS DOUBLE) = 0)
             AND NOT (cell_type = 'b' AND value = 'False')), '') AS text
FROM ({fx.CELLS_SQL}) GROUP BY doc_id"""


@query("src_cells", _CELL_TEXTS_SQL)
def src_cells(spark, folder):
    return sources.cell_texts(fx.cells(spark, folder)).select("doc_id", "total_pages", "text")


def _html_text_sql() -> str:
    """Page text of the fixture's markup: tags, comments, scripts and styles cut it into runs."""
    bare = "regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)\\s*>', '<x>', 'gis')"
    blank = "CASE WHEN NOT regexp_full_match(r, '[ \\n\\t\\f\\r]*') THEN r WHEN contains(r, chr(10)) THEN chr(10) ELSE ' ' END"
    pieces = f"list_filter(string_split_regex({bare}, '<[^>]*>'), lambda r: r <> '')"
    runs = f"array_to_string(list_transform({pieces}, lambda r: {blank}), chr(10))"
    for entity, char in [("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", chr(160)), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]:
        runs = f"replace({runs}, '{entity}', {fx.sql_text(char)})"
    # Cut-off titles end in an entity without its semicolon.
    runs = f"regexp_replace({runs}, '&amp(\\n|$)', '&\\1', 'g')"
    return f"SELECT doc_id, url, {runs} AS text, html FROM ({fx.HTML_PAGES_SQL})"


@query("src_html_text", f"SELECT doc_id, url, text, CAST(length(text) AS INTEGER) AS text_length FROM ({_html_text_sql()})")
def src_html_text(spark, folder):
    return sources.html_texts(fx.html_pages(spark, folder)).select(
        "doc_id", "url", "text", F.char_length("text").alias("text_length")
    )




def _long_length():
    """Documents scanned in blocks may be longer than an int can count."""
    return F.col("text_length").cast("bigint").alias("text_length")


def _scored(df: DataFrame, *more: str) -> DataFrame:
    s = F.col("threat_summary")
    total = F.col("n_findings") if "n_findings" in df.columns else F.size("findings").alias("n_findings")
    return df.select(
        "doc_id", "risk_score", "verdict", s["LOW"].alias("n1"), s["MEDIUM"].alias("n2"), s["HIGH"].alias("n3"),
        s["CRITICAL"].alias("n4"), total, *more,
    )


_STRIPPED_SQL = f"SELECT doc_id, {sql.strip_sql('text')} AS text FROM ({fx.DOCUMENTS_SQL})"


@query("scan_text", sql.with_ctes(
    sql.scan_ctes(_STRIPPED_SQL, anomalies=False),
    f"SELECT r.*, CAST(length(text) AS INTEGER) AS text_length FROM results r JOIN src USING (doc_id)"))
def scan_text(spark, folder):
    accepted, _ = routing.split_rejects(routing.admit_texts(fx.documents(spark, folder)))
    return _scored(scans.scan_text(accepted), "text_length")


_ROUTE_SQL = f"""
SELECT doc_id, filename, suffix, kind,
  CASE WHEN kind IS NULL THEN concat('Unsupported format ''', suffix,
    '''. Allowed: {", ".join(sorted(row[0] for row in rules.FORMATS))}') END AS error
FROM (SELECT *, CASE {" ".join(f"WHEN suffix = '{s}' THEN '{k}'" for s, k, _ in rules.FORMATS)} END AS kind
      FROM (SELECT *, lower(regexp_extract(filename, '^.+(\\.[^.]+)$', 1)) AS suffix FROM ({fx.UPLOADS_SQL})
            WHERE filename <> ''))"""


@query("route_format", _ROUTE_SQL)
def route_format(spark, folder):
    return routing.admit(fx.uploads(spark, folder)).select("doc_id", "filename", "suffix", "kind", "error")


@query("reject_rows", f"""
SELECT doc_id, filename, error FROM ({_ROUTE_SQL}) WHERE error IS NOT NULL
UNION ALL
SELECT doc_id, '<playground>' AS filename, 'No text provided' AS error FROM ({fx.UPLOADS_SQL})
WHERE {sql.strip_sql('text')} = ''""")
def reject_rows(spark, folder):
    uploads = fx.uploads(spark, folder)
    _, files = routing.split_rejects(routing.admit(uploads))
    _, texts = routing.split_rejects(routing.admit_texts(uploads))
    return files.select("doc_id", "filename", "error").unionByName(
        texts.select("doc_id", F.lit("<playground>").alias("filename"), "error")
    )


# ---------------------------------------------------------------- detectors

@query("detect_injection", _only([sql.injection_sql("src")]))
def detect_injection(spark, folder):
    df = detect.screened(fx.documents(spark, folder))
    return _rows(df, detect.injection("text", "_screen.injection"))


@query("detect_exfil", _only([sql.exfil_sql("src")]))
def detect_exfil(spark, folder):
    df = detect.screened(fx.documents(spark, folder))
    return _rows(df, detect.exfiltration("text", "_screen.exfil"))


@query("detect_invisible", _only([sql.invisible_sql("src")]))
def detect_invisible(spark, folder):
    df = detect.screened(fx.documents(spark, folder))
    return _rows(df, detect.invisible("text", "_screen.other"))


def _metadata_sql() -> str:
    branches = []
    for number, field in enumerate(rules.METADATA_FIELDS):
        by_rule = " ".join(
            f"WHEN regexp_matches(value, {fx.sql_text(rules.re2_pattern(p))}, 'is') THEN {rules.SEVERITY_LEVEL[s]}"
            for p, _, s in rules.INJECTION_RULES
        )
        by_word = " ".join(f"WHEN contains(lower(value), '{w}') THEN '{w}'" for w in rules.METADATA_KEYWORDS)
        branches.append(
            f"SELECT doc_id, {sql.METADATA} AS fam, {number} AS sub, 0 AS rule, 1 AS k, "
            f"CASE WHEN hit IS NOT NULL THEN '{rules.CATEGORY_METADATA}' ELSE '{rules.CATEGORY_METADATA_KEYWORD}' END AS category, "
            f"CASE WHEN hit IS NOT NULL THEN 'Injection payload in PDF ''{field}'' field' "
            f"ELSE concat('Keyword ''', word, ''' in PDF ''{field}'' field') END AS description, "
            f"coalesce(hit, 1) AS level, concat('{field}: ', left(value, 150)) AS evidence, CAST(NULL AS INTEGER) AS page, "
            f"CASE WHEN hit IS NOT NULL THEN {sql.double(rules.CONFIDENCE_METADATA)} "
            f"ELSE {sql.double(rules.CONFIDENCE_METADATA_KEYWORD)} END AS confidence "
            f"FROM (SELECT doc_id, value, CASE {by_rule} END AS hit, CASE {by_word} END AS word "
            f"FROM (SELECT doc_id, {field} AS value FROM meta WHERE {field} <> '')) WHERE hit IS NOT NULL OR word IS NOT NULL"
        )
    return " UNION ALL ".join(branches)


@query("detect_metadata", _only([_metadata_sql()], extra={"meta": fx.DOCUMENT_METADATA_SQL}))
def detect_metadata(spark, folder):
    df = fx.document_metadata(spark, folder)
    return _rows(df, detect.metadata(rules.METADATA_FIELDS))


def _properties_sql(source: str) -> str:
    columns = ", ".join(f"nullif({name}, '')" for name in rules.PROPERTY_FIELDS)
    joined = f"(SELECT doc_id, concat_ws(' ', {columns}) AS joined FROM {source})"
    return sql._family(
        joined, "joined", rules.INJECTION_RULES, "is", rules.CATEGORY_METADATA, rules.CONFIDENCE_PROPERTY, sql.LAST,
        prefix=rules.DESCRIPTION_PROPERTY_PREFIX, evidence="left(joined, 150)", page="CAST(NULL AS INTEGER)",
    )


@query("detect_properties", _only([_properties_sql("props")], extra={"props": fx.PROPERTIES_SQL}))
def detect_properties(spark, folder):
    df = fx.properties(spark, folder)
    return _rows(df, detect.properties(rules.PROPERTY_FIELDS))


@query("detect_anomaly", _only([sql.anomaly_sql("src")]))
def detect_anomaly(spark, folder):
    df = detect.screened(fx.documents(spark, folder))
    return _rows(df, detect.anomalies(F.col("text"), other="_screen.other"))


@query("detect_base64", _only([sql.base64_sql()], extra=sql.base64_ctes("src")))
def detect_base64(spark, folder):
    df = detect.screened(fx.documents(spark, folder))
    return _rows(df, detect.base64_payloads("text", "_screen.other"))


@query("detect_l33t", _only([sql.leet_findings_sql()], extra=sql.reading_ctes("src")))
def detect_l33t(spark, folder):
    df = detect.screened(fx.documents(spark, folder))
    return _rows(df, detect.leet_payloads("_leet", "_screen.injection"))


@query("detect_unicode", _only([sql.unicode_findings_sql()], extra=sql.reading_ctes("src")))
def detect_unicode(spark, folder):
    df = detect.screened(fx.documents(spark, folder))
    return _rows(df, detect.unicode_payloads("_screen.nfkd", "_screen.nfkd_injection"))


_FORMULA_SQL = (
    f"SELECT doc_id, {sql.FIRST} AS fam, 0 AS sub, 0 AS rule, row_number() OVER (PARTITION BY doc_id ORDER BY sheet_no, sheet, row, col, value) "
    f"AS k, '{rules.CATEGORY_FORMULA}' AS category, {fx.sql_text(rules.DESCRIPTION_FORMULA)} AS description, 2 AS level, "
    f"left(value, 100) AS evidence, CAST(NULL AS INTEGER) AS page, {sql.double(rules.CONFIDENCE_FORMULA)} AS confidence "
    "FROM cells WHERE starts_with(value, '=') AND length(value) > 5"
)


@query("detect_formula", f"""
SELECT doc_id, sheet, row, col, '{rules.CATEGORY_FORMULA}' AS category, {fx.sql_text(rules.DESCRIPTION_FORMULA)} AS description,
  'MEDIUM' AS severity, left(value, 100) AS evidence, {sql.double(rules.CONFIDENCE_FORMULA)} AS confidence
FROM ({fx.CELLS_SQL}) WHERE starts_with(value, '=') AND length(value) > 5""")
def detect_formula(spark, folder):
    found = detect.formula_cells(fx.cells(spark, folder))
    return found.select("doc_id", "sheet", "row", "col", "category", "description", "severity", "evidence", "confidence")


_HIDDEN_SQL = f"""
SELECT doc_id, {sql.FIRST} AS fam, 0 AS sub, 0 AS rule, 1 AS k, '{rules.CATEGORY_HIDDEN_HTML}' AS category,
  {fx.sql_text(rules.DESCRIPTION_HIDDEN_HTML)} AS description, 3 AS level, left(hidden, 100) AS evidence,
  CAST(NULL AS INTEGER) AS page, {sql.double(rules.CONFIDENCE_HIDDEN_HTML)} AS confidence
FROM (SELECT doc_id, trim(regexp_extract(html,
        '(?is)<(?:div|span|p) style="(?:display\\s*:\\s*none|visibility\\s*:\\s*hidden|font-size\\s*:\\s*0)[^"]*">([^<]*)<', 1)) AS hidden
      FROM ({fx.HTML_PAGES_SQL})) WHERE hidden <> ''"""


@query("detect_hidden_html", _only([_HIDDEN_SQL]))
def detect_hidden_html(spark, folder):
    texts = sources.suspicious_markup(fx.html_pages(spark, folder), "hides")
    return _rows(texts, detect.hidden_elements(F.col("hidden")))


_SCRIPTS_SQL = f"""
SELECT doc_id, bodies[i] AS body, i AS sub FROM (
  SELECT doc_id, bodies, unnest(range(1, len(bodies) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(html, '<script[^>]*>(.*?)</script\\s*>', 1, 'is') AS bodies FROM ({fx.HTML_PAGES_SQL})))"""


@query("detect_script", _only(
    [sql.injection_sql("scripts", "body", sql.FIRST, sub="sub * 2"), sql.exfil_sql("scripts", "body", sql.FIRST, sub="sub * 2 + 1")],
    extra={"scripts": _SCRIPTS_SQL}))
def detect_script(spark, folder):
    texts = sources.suspicious_markup(fx.html_pages(spark, folder), "scripts")
    return _rows(
        texts, detect.scripts("scripts", "script_injection", "script_exfil")
    )


_PAGED_SRC_SQL = f"""
SELECT doc_id, string_agg(concat(text, chr(10)), '' ORDER BY page, text) AS text, CAST(count(*) AS INTEGER) AS total_pages,
  list({{'page': page, 'stop': stop}} ORDER BY page, text) AS ends
FROM (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page, text ROWS UNBOUNDED PRECEDING) AS stop FROM ({fx.PAGES_SQL}))
GROUP BY doc_id"""


@query("locate_page", _only(
    [sql.injection_sql("src", page=sql.PAGE_OF_START), sql.exfil_sql("src", page=sql.PAGE_OF_START)], _PAGED_SRC_SQL))
def locate_page(spark, folder):
    texts = detect.screened(sources.paged_texts(fx.pages(spark, folder)))
    return _rows(texts, F.concat(
        detect.injection("text", "_screen.injection", "ends"), detect.exfiltration("text", "_screen.exfil", "ends")
    ))


_PLAIN_CTES = sql.scan_ctes(fx.DOCUMENTS_SQL, anomalies=True)


@query("findings_union", sql.with_ctes(_PLAIN_CTES, sql.finding_rows_sql()))
def findings_union(spark, folder):
    return _rows(_plain(spark, folder))


def _page_anomaly_sql() -> str:
    return sql.anomaly_sql("page_rows", page="page", sub="page")


@query("scan_pages_doc", sql.with_ctes(
    {"page_rows": fx.PAGES_SQL, "meta": fx.DOCUMENT_METADATA_SQL,
     **sql.scan_ctes(_PAGED_SRC_SQL, anomalies=False, paged=True, extra=[
         _page_anomaly_sql(), f"SELECT m.* FROM ({_metadata_sql()}) m WHERE doc_id IN (SELECT doc_id FROM src)"])},
    "SELECT r.*, total_pages, CAST(length(text) AS BIGINT) AS text_length FROM results r JOIN src USING (doc_id)"))
def scan_pages_doc(spark, folder):
    scanned = scans.summarize_pages(fx.pages(spark, folder), fx.document_metadata(spark, folder))
    return _scored(scanned, "total_pages", _long_length())


@query("scan_parts_doc", sql.with_ctes(
    {"props": fx.PROPERTIES_SQL,
     **sql.scan_ctes(ORACLES["src_paragraph_parts"], anomalies=True, extra=[
         f"SELECT p.* FROM ({_properties_sql('props')}) p WHERE doc_id IN (SELECT doc_id FROM src)"])},
    "SELECT r.*, CAST(0 AS INTEGER) AS total_pages, CAST(length(text) AS BIGINT) AS text_length "
    "FROM results r JOIN src USING (doc_id)"))
def scan_parts_doc(spark, folder):
    scanned = scans.summarize_parts(fx.parts(spark, folder), fx.properties(spark, folder))
    return _scored(scanned, "total_pages", _long_length())


@query("scan_cells_doc", sql.with_ctes(
    {"cells": fx.CELLS_SQL, **sql.scan_ctes(_CELL_TEXTS_SQL, anomalies=False, extra=[_FORMULA_SQL])},
    "SELECT r.*, total_pages, CAST(length(text) AS BIGINT) AS text_length FROM results r JOIN src USING (doc_id)"))
def scan_cells_doc(spark, folder):
    return _scored(scans.summarize_cells(fx.cells(spark, folder)), "total_pages", _long_length())


@query("scan_pages_findings", sql.with_ctes(
    {"page_rows": fx.PAGES_SQL, "meta": fx.DOCUMENT_METADATA_SQL,
     **sql.scan_ctes(_PAGED_SRC_SQL, anomalies=False, paged=True, extra=[
         _page_anomaly_sql(), f"SELECT m.* FROM ({_metadata_sql()}) m WHERE doc_id IN (SELECT doc_id FROM src)"])},
    sql.finding_rows_sql()))
def scan_pages_findings(spark, folder):
    return _found(scans.scan_page_rows(fx.pages(spark, folder), fx.document_metadata(spark, folder)))


@query("scan_parts_findings", sql.with_ctes(
    {"props": fx.PROPERTIES_SQL,
     **sql.scan_ctes(ORACLES["src_paragraph_parts"], anomalies=True, extra=[
         f"SELECT p.* FROM ({_properties_sql('props')}) p WHERE doc_id IN (SELECT doc_id FROM src)"])},
    sql.finding_rows_sql()))
def scan_parts_findings(spark, folder):
    return _found(scans.scan_part_rows(fx.parts(spark, folder), fx.properties(spark, folder)))


@query("scan_cells_findings", sql.with_ctes(
    {"cells": fx.CELLS_SQL, **sql.scan_ctes(_CELL_TEXTS_SQL, anomalies=False, extra=[_FORMULA_SQL])}, sql.finding_rows_sql()))
def scan_cells_findings(spark, folder):
    return _found(scans.scan_cell_rows(fx.cells(spark, folder)))


def _found(scan) -> DataFrame:
    return scan.findings.select("doc_id", "pos", "category", "description", "severity", "evidence", "page", "confidence")


def _script_families() -> list[str]:
    return [
        sql.injection_sql("scripts", "body", sql.FIRST, sub="sub * 2"),
        sql.exfil_sql("scripts", "body", sql.FIRST, sub="sub * 2 + 1"),
    ]


@query("scan_html_doc", sql.with_ctes(
    {"scripts": _SCRIPTS_SQL,
     **sql.scan_ctes(_html_text_sql(), anomalies=False, extra=[_HIDDEN_SQL, *_script_families()])},
    "SELECT r.*, CAST(1 AS INTEGER) AS total_pages, CAST(length(text) AS INTEGER) AS text_length "
    "FROM results r JOIN src USING (doc_id)"))
def scan_html_doc(spark, folder):
    return _scored(scans.scan_html(fx.html_pages(spark, folder)), "total_pages", "text_length")


@query("scan_html_findings", sql.with_ctes(
    {"scripts": _SCRIPTS_SQL,
     **sql.scan_ctes(_html_text_sql(), anomalies=False, extra=[_HIDDEN_SQL, *_script_families()])}, sql.finding_rows_sql()))
def scan_html_findings(spark, folder):
    return _rows(scans.scan_html(fx.html_pages(spark, folder)))


def _plain(spark, folder) -> DataFrame:
    return scans.scan_plain(fx.documents(spark, folder))


@query("scan_plain_doc", sql.with_ctes(
    _PLAIN_CTES,
    "SELECT r.*, source, lang, CAST(length(text) AS INTEGER) AS text_length FROM results r JOIN src USING (doc_id)"))
def scan_plain_doc(spark, folder):
    return _scored(_plain(spark, folder), "source", "lang", "text_length")


# ---------------------------------------------------------------- scores and projections

@query("risk_score", sql.with_ctes(_PLAIN_CTES, "SELECT doc_id, risk_score FROM results"))
def risk_score(spark, folder):
    return _plain(spark, folder).select("doc_id", "risk_score")


_STRICT = 48


@query("verdict", sql.with_ctes(
    _PLAIN_CTES,
    f"SELECT doc_id, verdict, CASE WHEN risk_score >= {_STRICT} THEN 'BLOCKED' ELSE 'ALLOWED' END AS lenient_verdict "
    "FROM results"))
def verdict(spark, folder):
    return _plain(spark, folder).select(
        "doc_id", "verdict", score.verdict(F.col("risk_score"), _STRICT).alias("lenient_verdict")
    )


@query("threat_summary", sql.with_ctes(
    _PLAIN_CTES, 'SELECT doc_id, n4 AS "CRITICAL", n3 AS "HIGH", n2 AS "MEDIUM", n1 AS "LOW" FROM results'))
def threat_summary(spark, folder):
    return _plain(spark, folder).select("doc_id", "threat_summary.*")


@query("blocked_docs", sql.with_ctes(
    _PLAIN_CTES, "SELECT doc_id, risk_score, n_findings FROM results WHERE verdict = 'BLOCKED'"))
def blocked_docs(spark, folder):
    return score.blocked(_plain(spark, folder)).select("doc_id", "risk_score", F.size("findings").alias("n_findings"))


@query("findings_view", sql.with_ctes(_PLAIN_CTES, sql.finding_rows_sql(view=True)))
def findings_view(spark, folder):
    view = _plain(spark, folder).select("doc_id", score.findings_view(F.col("findings")).alias("findings"))
    return _rows(view)


@query("scan_result_view", sql.with_ctes(
    _PLAIN_CTES,
    "SELECT r.doc_id, concat('doc_', CAST(r.doc_id AS VARCHAR), '.txt') AS filename, 'txt' AS file_format, verdict, "
    "risk_score, CAST(1 AS INTEGER) AS total_pages, CAST(length(text) AS INTEGER) AS text_length, FALSE AS metadata_scanned, "
    "n_findings, n4 AS critical, n3 AS high, n2 AS medium, n1 AS low, "
    "coalesce(c.listing, '') AS listing FROM results r JOIN src USING (doc_id) LEFT JOIN (SELECT doc_id, "
    f"string_agg(concat_ws('|', category, {sql.LEVEL_NAME}, left(evidence, 200), "
    f"CAST(CAST(round_even(confidence * 100, 0) AS INTEGER) AS VARCHAR)), ';' ORDER BY {sql.ORDER}) AS listing "
    "FROM found GROUP BY doc_id) c ON c.doc_id = r.doc_id"))
def scan_result_view(spark, folder):
    result = score.scan_result(_plain(spark, folder))
    listing = F.array_join(F.transform(
        "findings",
        lambda f: F.concat_ws("|", f["category"], f["severity"], f["evidence"], f["confidence"].cast("string")),
    ), ";")
    return result.select(
        "doc_id", "filename", "file_format", "verdict", "risk_score", "total_pages", "text_length", "metadata_scanned",
        F.size("findings").alias("n_findings"), *[F.col(f"threat_summary.{s}").alias(s.lower()) for s in score.SEVERITIES],
        listing.alias("listing"),
    )


@query("verdict_counts", sql.with_ctes(
    _PLAIN_CTES,
    "SELECT source, verdict, count(*) AS documents, CAST(sum(n_findings) AS BIGINT) AS findings "
    "FROM results JOIN src USING (doc_id) GROUP BY source, verdict"))
def verdict_counts(spark, folder):
    return _plain(spark, folder).groupBy("source", "verdict").agg(
        F.count("*").alias("documents"), F.sum(F.size("findings")).alias("findings")
    )


def _escape_sql(text: str) -> str:
    return (
        f"replace(replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#39;'), '\"', '&quot;')"
    )


@query("escape_html", f"SELECT page_id, {_escape_sql('html')} AS escaped FROM pages")
def escape_html(spark, folder):
    from glyphwarden.sources.tables import read_table

    return read_table(spark, folder, "pages").select("page_id", text_functions.escape_html(F.col("html")).alias("escaped"))
