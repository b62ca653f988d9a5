"""The detectors in DuckDB SQL, generated from the same rule tables."""

from __future__ import annotations

from glyphwarden import rules
from glyphwarden.plans.fixtures import NFKD_PAIRS, sql_text

FINDING_COLUMNS = "doc_id, fam, sub, rule, k, category, description, level, evidence, page, confidence"
# Family numbers follow the reporting order.
FIRST, INJECTION, EXFIL, INVISIBLE, METADATA, ANOMALY, BASE64, LEET, UNICODE, LAST = range(10)


def double(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def nfkd_sql(text: str) -> str:
    for char, decomposed in NFKD_PAIRS:
        text = f"replace({text}, {sql_text(char)}, {sql_text(decomposed)})"
    return text


def leet_sql(text: str) -> str:
    return f"translate(lower({text}), '{rules.LEET_FROM}', '{rules.LEET_TO}')"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{rules.WHITESPACE}]+|[{rules.WHITESPACE}]+$', '', 'g')"


def _derived(confidence: float, derivation) -> tuple[str, float]:
    if derivation is None:
        return "", confidence
    prefix, off, floor = derivation
    return prefix, max(floor, confidence - off)


def _family(source: str, text: str, table, flags: str, category: str, confidence: float, fam: int, *, prefix="",
            demote=0, sub="0", evidence="m[i]", page="1", where="TRUE") -> str:
    """Findings of one rule family over ``source``.

    ``page`` may use ``start``, the zero-based offset of the match: the running length of
    the matches and of the text between them (``gaps``).
    """
    branches = []
    for number, (pattern, description, severity) in enumerate(table):
        level = max(1, rules.SEVERITY_LEVEL[severity] - demote)
        branches.append(
            f"SELECT *, {number} AS rule, {sql_text(prefix + description)} AS description, {level} AS level, "
            f"regexp_extract_all({text}, {sql_text(rules.re2_pattern(pattern))}, 0, '{flags}') AS m, "
            f"string_split_regex({text}, {sql_text(f'(?{flags})' + rules.re2_pattern(pattern))}) AS gaps "
            f"FROM {source} WHERE {where} AND regexp_matches({text}, {sql_text(rules.re2_pattern(pattern))}, '{flags}')"
        )
    return (
        f"SELECT doc_id, {fam} AS fam, {sub} AS sub, rule, i AS k, '{category}' AS category, description, level, "
        f"{evidence} AS evidence, {page} AS page, {double(confidence)} AS confidence FROM "
        f"(SELECT *, coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + "
        f"coalesce(list_sum(list_transform(m[1:i - 1], lambda g: length(g))), 0) AS start FROM "
        f"(SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({' UNION ALL '.join(branches)})))"
    )


PAGE_OF_START = "list_filter(ends, lambda e: e['stop'] > start)[1]['page']"


def injection_sql(source: str, text: str = "text", fam: int = INJECTION, derivation=None, **options) -> str:
    prefix, confidence = _derived(rules.CONFIDENCE_INJECTION, derivation)
    return _family(source, text, rules.INJECTION_RULES, "is", rules.CATEGORY_INJECTION, confidence, fam, prefix=prefix, **options)


def exfil_sql(source: str, text: str = "text", fam: int = EXFIL, derivation=None, **options) -> str:
    prefix, confidence = _derived(rules.CONFIDENCE_EXFIL, derivation)
    return _family(source, text, rules.EXFIL_RULES, "i", rules.CATEGORY_EXFIL, confidence, fam, prefix=prefix, **options)


def invisible_sql(source: str, text: str = "text") -> str:
    counts = ", ".join(f"length({text}) - length(replace({text}, chr({code}), ''))" for code, _ in rules.INVISIBLE_CHARS)
    labels = ", ".join(sql_text(f"{name} (U+{code:04X})") for code, name in rules.INVISIBLE_CHARS)
    return (
        f"SELECT doc_id, {INVISIBLE} AS fam, 0 AS sub, 0 AS rule, 1 AS k, '{rules.CATEGORY_INVISIBLE}' AS category, "
        "concat('Detected ', CAST(total AS VARCHAR), ' invisible Unicode character(s) — possible steganographic payload') "
        "AS description, CASE WHEN total > 50 THEN 4 WHEN total > 10 THEN 3 ELSE 2 END AS level, "
        "array_to_string(list_transform(list_filter(range(1, 16), lambda j: n[j] > 0), "
        "lambda j: concat(labels[j], ': ', CAST(n[j] AS VARCHAR))), '; ') AS evidence, "
        f"CAST(NULL AS INTEGER) AS page, {double(rules.CONFIDENCE_INVISIBLE)} AS confidence "
        f"FROM (SELECT *, [{counts}] AS n, CAST(list_sum([{counts}]) AS BIGINT) AS total, [{labels}] AS labels FROM {source}) "
        "WHERE total > 0"
    )


def anomaly_sql(source: str, text: str = "text", page: str = "1", sub: str = "0") -> str:
    """``source`` needs doc_id and text; with ``page`` one row per page."""
    return (
        f"SELECT doc_id, {ANOMALY} AS fam, {sub} AS sub, 0 AS rule, k, '{rules.CATEGORY_ANOMALY}' AS category, "
        f"{sql_text(rules.DESCRIPTION_ANOMALY)} AS description, 2 AS level, concat(left(line, 120), '...') AS evidence, "
        f"{page} AS page, {double(rules.CONFIDENCE_ANOMALY)} AS confidence FROM "
        f"(SELECT *, {strip_sql('raw_line')} AS line FROM (SELECT *, unnest(string_split({text}, chr(10))) AS raw_line, "
        f"unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS k FROM {source})) "
        "WHERE length(line) > 500 AND NOT regexp_matches(line, '[.!?,;:]')"
    )


def base64_ctes(source: str, text: str = "text") -> dict[str, str]:
    """CTEs up to ``decoded(doc_id, sub, payload)``: texts longer than 10 characters."""
    return {
        "runs": (
            f"SELECT doc_id, unnest(rs) AS run, unnest(range(1, len(rs) + 1)) AS sub FROM "
            f"(SELECT doc_id, regexp_extract_all({text}, '{rules.BASE64_RUN}') AS rs FROM {source})"
        ),
        "decoded": (
            "SELECT doc_id, sub, payload FROM (SELECT *, try(decode(from_base64(concat(body, repeat('=', CAST((4 - n % 4) % 4 AS BIGINT)))))) "
            "AS payload FROM (SELECT *, rtrim(run, '=') AS body, length(rtrim(run, '=')) AS n, "
            "length(run) - length(rtrim(run, '=')) AS p FROM runs) "
            "WHERE n % 4 = 0 OR (n % 4 = 2 AND p = 2) OR (n % 4 = 3 AND p >= 1)) WHERE length(payload) > 10"
        ),
    }


def base64_sql() -> str:
    a = injection_sql("decoded", "payload", BASE64, rules.DERIVED_BASE64, demote=1, sub="sub * 2")
    b = exfil_sql("decoded", "payload", BASE64, rules.DERIVED_BASE64, demote=1, sub="sub * 2 + 1")
    return f"{a} UNION ALL {b}"


def reading_ctes(source: str, text: str = "text") -> dict[str, str]:
    """CTEs with the substituted and the normalised reading where they differ."""
    return {
        "leet_src": f"SELECT * FROM (SELECT doc_id, {leet_sql(text)} AS leet, lower({text}) AS low FROM {source}) WHERE leet <> low",
        "nfkd_src": (
            f"SELECT * FROM (SELECT doc_id, {text} AS original, {nfkd_sql(text)} AS nfkd FROM {source} "
            f"WHERE strlen({text}) > length({text})) WHERE nfkd <> original"
        ),
    }


def leet_findings_sql() -> str:
    return injection_sql("leet_src", "leet", LEET, rules.DERIVED_LEET)


def unicode_findings_sql() -> str:
    return injection_sql("nfkd_src", "nfkd", UNICODE, rules.DERIVED_UNICODE)


def with_ctes(ctes: dict[str, str], body: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in ctes.items()) + "\n" + body


def scan_ctes(source_sql: str, *, anomalies: bool, extra: list[str] = (), paged: bool = False) -> dict[str, str]:
    """CTEs src -> found -> results for a whole scan of src(doc_id, text, ...)."""
    ctes = {"src": source_sql, **base64_ctes("src"), **reading_ctes("src")}
    page = PAGE_OF_START if paged else "1"
    families = [
        injection_sql("src", page=page), exfil_sql("src", page=page), invisible_sql("src"), *([anomaly_sql("src")] if anomalies else []), base64_sql(),
        leet_findings_sql(), unicode_findings_sql(), *extra,
    ]
    ctes["found"] = "\nUNION ALL\n".join(f"SELECT {FINDING_COLUMNS} FROM ({family})" for family in families)
    ctes["results"] = results_sql("src", "found")
    return ctes


LEVEL_NAME = "['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][level]"
ORDER = "fam, sub, rule, k"


def results_sql(source: str, found: str) -> str:
    """Score, verdict and severity counts per document, folding in finding order."""
    return (
        f"SELECT s.doc_id, coalesce(r.risk_score, 0) AS risk_score, "
        f"CASE WHEN coalesce(r.risk_score, 0) >= {rules.BLOCK_THRESHOLD} THEN 'BLOCKED' ELSE 'ALLOWED' END AS verdict, "
        + ", ".join(f"CAST(coalesce(r.n{l}, 0) AS INTEGER) AS n{l}" for l in range(1, 5))
        + f", CAST(coalesce(r.n, 0) AS INTEGER) AS n_findings FROM {source} s LEFT JOIN ("
        "SELECT doc_id, CAST(floor(least(list_reduce(list_prepend(CAST(0 AS DOUBLE), list("
        f"[5, 15, 30, 50][level] * confidence ORDER BY {ORDER})), lambda a, x: a + x), 100)) AS INTEGER) AS risk_score, "
        + ", ".join(f"count(*) FILTER (level = {l}) AS n{l}" for l in range(1, 5))
        + f", count(*) AS n FROM {found} GROUP BY doc_id) r ON s.doc_id = r.doc_id"
    )


def finding_rows_sql(found: str = "found", view: bool = False) -> str:
    evidence = "left(evidence, 200)" if view else "evidence"
    confidence = "CAST(round_even(confidence * 100, 0) AS INTEGER)" if view else "confidence"
    return (
        f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {ORDER}) AS INTEGER) AS pos, category, "
        f"description, {LEVEL_NAME} AS severity, {evidence} AS evidence, CAST(page AS INTEGER) AS page, "
        f"{confidence} AS confidence FROM {found}"
    )
