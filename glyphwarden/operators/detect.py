"""Threat detectors: text columns to arrays of findings.

Every detector is an expression that yields ``ARRAY<FINDING>`` inside the row, so that a
document scan is one narrow stage: no shuffle, and the order of findings, which the score
depends on, is the order of array concatenation. Exact matching runs only for the rules
the screening pass has flagged (functions/screening.py).

The rule families are written as SQL expressions with literal patterns: Spark compiles a
literal pattern once per task, and one expression text is far quicker to build than a few
hundred Column calls. Parameters named ``text``, ``bits`` and the like are therefore SQL
expressions, mostly column names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from glyphwarden import rules
from glyphwarden.functions import screening, text as text_functions

FINDING_DDL = (
    "struct<category:string,description:string,severity:string,severity_level:int,"
    "evidence:string,page:int,confidence:double>"
)
NO_FINDINGS = f"cast(array() as array<{FINDING_DDL}>)"
_LEVELS = sorted(rules.SEVERITY_LEVEL, key=rules.SEVERITY_LEVEL.get)
_LEVEL_ARRAY = "array(" + ", ".join(f"'{name}'" for name in _LEVELS) + ")"

Derivation = tuple[str, float, float]


def no_findings() -> Column:
    return F.expr(NO_FINDINGS)


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(values: Sequence[str]) -> str:
    return "array(" + ", ".join(_quoted(v) for v in values) + ")"


def _finding(category: str, description: str, level: str, evidence: str, page: str, confidence: float) -> str:
    """A FINDING; all but the confidence are SQL expressions."""
    return (
        f"named_struct('category', {category}, 'description', {description}, "
        f"'severity', element_at({_LEVEL_ARRAY}, {level}), 'severity_level', {level}, 'evidence', {evidence}, "
        f"'page', cast({page} as int), 'confidence', {confidence!r}D)"
    )


def finding(category: str, description: str, level: int, evidence: Column, page: Column, confidence: float) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(description).alias("description"),
        F.lit(_LEVELS[level - 1]).alias("severity"), F.lit(level).alias("severity_level"), evidence.alias("evidence"),
        page.cast("int").alias("page"), F.lit(confidence).alias("confidence"),
    )


def matches(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, r'{pattern}', 0)"


def match_offsets(text: str, pattern: str) -> str:
    """ARRAY<STRUCT<match, start>> of all matches, with zero-based character offsets.

    The text between matches comes from splitting on the same pattern; offsets are the
    running lengths of both.
    """
    found = matches(text, pattern)
    pairs = f"zip_with({found}, slice(split({text}, r'{pattern}', -1), 1, size({found})), (m, gap) -> struct(m, gap))"
    start = "a.pos + char_length(p.gap)"
    return (
        f"aggregate({pairs}, struct(0 as pos, cast(array() as array<struct<match:string,start:int>>) as found), "
        f"(a, p) -> struct({start} + char_length(p.m) as pos, "
        f"concat(a.found, array(struct(p.m as match, {start} as start))) as found), a -> a.found)"
    )


def page_of(ends: str, offset: str) -> str:
    """Page of an offset by binary search in ascending ARRAY<STRUCT<page, stop>>; null past the last page."""
    middle = "cast((a.lo + a.hi) div 2 as int)"
    step = (
        f"CASE WHEN a.lo >= a.hi THEN a WHEN get({ends}, {middle}).stop <= {offset} "
        f"THEN struct({middle} + 1 as lo, a.hi as hi) ELSE struct(a.lo as lo, {middle} as hi) END"
    )
    # As many steps as the number of pages has bits.
    steps = f"sequence(1, greatest(1, char_length(bin(size({ends})))))"
    return f"get({ends}, aggregate({steps}, struct(0 as lo, size({ends}) as hi), (a, i) -> {step}, a -> a.lo)).page"


def _family(
    text: str, patterns: Sequence[str], table: Sequence[tuple[str, str, str]], category: str, confidence: float,
    bits: str | None, derivation: Derivation | None, demote: int, ends: str | None,
    prefix: str = "", evidence: str = "hit", page: str = "1",
) -> str:
    """Findings of all rules of a family, in rule order, then match order.

    Rules whose bit is not set are not run; ``bits`` None runs all. With ``ends`` (the characters up
    to the end of each page) matches are attributed to the page they start on.
    """
    if derivation is not None:
        prefix, taken_off, floor = derivation
        confidence = max(floor, confidence - taken_off)
    if ends is not None:
        evidence, page = "hit.match", page_of(ends, "hit.start")
    find = matches if ends is None else match_offsets
    hits = [find(text, pattern) for pattern in patterns]
    if bits is not None:
        hits = [f"CASE WHEN {bits} & {1 << k} != 0 THEN {hit} END" for k, hit in enumerate(hits)]
    descriptions = _strings([prefix + description for _, description, _ in table])
    levels = [max(1, rules.SEVERITY_LEVEL[severity] - demote) for _, _, severity in table]
    level = f"get(array({', '.join(map(str, levels))}), k)"
    one = _finding(f"'{category}'", f"get({descriptions}, k)", level, evidence, page, confidence)
    family = (
        f"flatten(transform(array({', '.join(hits)}), "
        f"(found, k) -> coalesce(transform(found, hit -> {one}), {NO_FINDINGS})))"
    )
    return family if bits is None else f"CASE WHEN {bits} != 0 THEN {family} ELSE {NO_FINDINGS} END"


def injection_sql(
    text: str, bits: str | None = None, derivation: Derivation | None = None, demote: int = 0, ends: str | None = None
) -> str:
    return _family(
        text, rules.INJECTION_JAVA, rules.INJECTION_RULES, rules.CATEGORY_INJECTION, rules.CONFIDENCE_INJECTION,
        bits, derivation, demote, ends,
    )


def exfiltration_sql(
    text: str, bits: str | None = None, derivation: Derivation | None = None, demote: int = 0, ends: str | None = None
) -> str:
    return _family(
        text, rules.EXFIL_JAVA, rules.EXFIL_RULES, rules.CATEGORY_EXFIL, rules.CONFIDENCE_EXFIL,
        bits, derivation, demote, ends,
    )


def injection(text: str, bits: str | None = None, ends: str | None = None) -> Column:
    """Prompt-injection rules; every non-overlapping match is a finding."""
    return F.expr(injection_sql(text, bits, ends=ends))


def exfiltration(text: str, bits: str | None = None, ends: str | None = None) -> Column:
    """Data-exfiltration rules; every non-overlapping match is a finding."""
    return F.expr(exfiltration_sql(text, bits, ends=ends))


def invisible_counts(text: str) -> str:
    """ARRAY<STRUCT<label, n>> over all invisible characters, in table order."""
    return "array(" + ", ".join(
        f"struct('{name} (U+{code:04X})' as label, "
        f"char_length({text}) - char_length(replace({text}, '\\u{code:04X}', '')) as n)"
        for code, name in rules.INVISIBLE_CHARS
    ) + ")"


def invisible_of_counts(counts: str) -> str:
    total = "aggregate(chars, 0, (a, c) -> a + c.n)"
    described = _finding(
        f"'{rules.CATEGORY_INVISIBLE}'",
        f"concat('Detected ', cast({total} as string), ' invisible Unicode character(s) — possible steganographic payload')",
        f"CASE WHEN {total} > 50 THEN 4 WHEN {total} > 10 THEN 3 ELSE 2 END",
        "array_join(transform(chars, c -> concat(c.label, ': ', cast(c.n as string))), '; ')",
        "null", rules.CONFIDENCE_INVISIBLE,
    )
    return (
        f"transform(filter(array(filter({counts}, c -> c.n > 0)), chars -> size(chars) > 0), chars -> {described})"
    )


def invisible(text: str, other: str | None = None) -> Column:
    """At most one finding: counts of invisible characters, graver the more there are."""
    found = invisible_of_counts(invisible_counts(text))
    if other is None:
        return F.expr(found)
    return F.expr(f"CASE WHEN {other} & {screening.HAS_INVISIBLE} != 0 THEN {found} ELSE {NO_FINDINGS} END")


def anomalies(text: Column, page: Column | None = None, other: str | None = None) -> Column:
    """Lines of more than 500 characters (stripped) without any punctuation."""
    page = F.lit(1) if page is None else page
    stripped = F.transform(F.split(text, "\n", -1), text_functions.strip)
    long_lines = F.filter(
        stripped, lambda line: (F.char_length(line) > 500) & ~line.rlike(f"[{rules.PUNCTUATION}]")
    )
    found = F.transform(
        long_lines,
        lambda line: finding(
            rules.CATEGORY_ANOMALY, rules.DESCRIPTION_ANOMALY, 2,
            F.concat(F.left(line, F.lit(120)), F.lit("...")), page, rules.CONFIDENCE_ANOMALY,
        ),
    )
    return F.when(_long_line(text, other), found).otherwise(no_findings())


def _long_line(text: Column, other: str | None) -> Column:
    if other is None:
        return (F.char_length(text) > 500) & text.rlike(rules.LONG_STRETCH)
    return F.expr(f"{other} & {screening.HAS_LONG_LINE} != 0")


def page_anomalies(pages: Column, other: str) -> Column:
    """The same per page; ``other`` is the screening of the joined text."""
    found = F.flatten(F.transform(pages, lambda p: anomalies(p["text"], p["page"])))
    return F.when(_long_line(pages, other), found).otherwise(no_findings())


def base64_payloads(text: str, other: str | None = None) -> Column:
    """Decodes long Base64 runs and applies injection and exfiltration rules to each text."""
    runs = matches(text, rules.BASE64_RUN)
    payloads = f"filter(transform({runs}, run -> {text_functions.base64_text_sql('run')}), d -> char_length(d) > 10)"
    on_payload = ", ".join(
        family("payload", derivation=rules.DERIVED_BASE64, demote=1) for family in (injection_sql, exfiltration_sql)
    )
    found = f"flatten(transform({payloads}, payload -> concat({on_payload})))"
    if other is None:
        return F.expr(found)
    return F.expr(f"CASE WHEN {other} & {screening.HAS_BASE64} != 0 THEN {found} ELSE {NO_FINDINGS} END")


def leet_payloads(leet_text: str, bits: str) -> Column:
    """Injection rules on the text with substitutions undone (null where none applies)."""
    active = f"CASE WHEN {leet_text} IS NOT NULL THEN {bits} ELSE 0 END"
    return F.expr(injection_sql(leet_text, f"({active})", rules.DERIVED_LEET))


def unicode_payloads(nfkd_text: str, bits: str) -> Column:
    """Injection rules on the NFKD form (null where it changes nothing)."""
    return F.expr(injection_sql(nfkd_text, bits, rules.DERIVED_UNICODE))


def metadata(fields: Sequence[str]) -> Column:
    """Per field the first injection rule that hits, else the first keyword contained."""
    return F.expr("concat(" + ", ".join(_metadata_field(name) for name in fields) + ")")


def _metadata_field(name: str) -> str:
    evidence = f"concat('{name}: ', left({name}, 150))"
    level = "CASE " + " ".join(
        f"WHEN {name} RLIKE r'{pattern}' THEN {rules.SEVERITY_LEVEL[severity]}"
        for pattern, (_, _, severity) in zip(rules.INJECTION_JAVA, rules.INJECTION_RULES)
    ) + " END"
    keyword = "CASE " + " ".join(
        f"WHEN contains(lower({name}), '{word}') THEN '{word}'" for word in rules.METADATA_KEYWORDS
    ) + " END"
    by_rule = _finding(
        f"'{rules.CATEGORY_METADATA}'", _quoted(f"Injection payload in PDF '{name}' field"), "hit", evidence, "null",
        rules.CONFIDENCE_METADATA,
    )
    by_keyword = _finding(
        f"'{rules.CATEGORY_METADATA_KEYWORD}'",
        f"concat({_quoted('Keyword ')}, {_quoted(chr(39))}, word, {_quoted(f"' in PDF '{name}' field")})", "1",
        evidence, "null", rules.CONFIDENCE_METADATA_KEYWORD,
    )
    # The rule level is bound to ``hit`` so that it is evaluated once.
    return (
        f"CASE WHEN char_length({name}) > 0 THEN flatten(transform(array({level}), hit -> "
        f"CASE WHEN hit IS NOT NULL THEN array({by_rule}) "
        f"ELSE transform(array_compact(array({keyword})), word -> {by_keyword}) END)) ELSE {NO_FINDINGS} END"
    )


def properties(columns: Sequence[str]) -> Column:
    """Every injection match in the joined non-empty properties, at full confidence."""
    joined = "concat_ws(' ', " + ", ".join(f"nullif({c}, '')" for c in columns) + ")"
    return F.expr(_family(
        joined, rules.INJECTION_JAVA, rules.INJECTION_RULES, rules.CATEGORY_METADATA, rules.CONFIDENCE_PROPERTY,
        None, None, 0, None, prefix=rules.DESCRIPTION_PROPERTY_PREFIX, evidence=f"left({joined}, 150)", page="null",
    ))


def formulas(values: Column) -> Column:
    """Cells (ARRAY<STRING>, in sheet order) that look like formulas."""
    suspicious = F.filter(values, lambda v: F.startswith(v, F.lit("=")) & (F.char_length(v) > 5))
    return F.transform(
        suspicious,
        lambda v: finding(
            rules.CATEGORY_FORMULA, rules.DESCRIPTION_FORMULA, 2, F.left(v, F.lit(100)), F.lit(None),
            rules.CONFIDENCE_FORMULA,
        ),
    )


def formula_cells(cells: DataFrame) -> DataFrame:
    """The same on cell rows: a filter, without assembling workbooks."""
    value = F.col("value")
    suspicious = cells.filter(F.startswith(value, F.lit("=")) & (F.char_length(value) > 5))
    found = finding(
        rules.CATEGORY_FORMULA, rules.DESCRIPTION_FORMULA, 2, F.left(value, F.lit(100)), F.lit(None), rules.CONFIDENCE_FORMULA
    )
    return suspicious.select("doc_id", "sheet", "row", "col", found.alias("f")).select("doc_id", "sheet", "row", "col", "f.*")


def hidden_elements(hidden: Column) -> Column:
    """Texts of elements hidden by their inline style (ARRAY<STRING>, document order)."""
    return F.transform(
        hidden,
        lambda h: finding(
            rules.CATEGORY_HIDDEN_HTML, rules.DESCRIPTION_HIDDEN_HTML, 3, F.left(h, F.lit(100)), F.lit(None),
            rules.CONFIDENCE_HIDDEN_HTML,
        ),
    )


def scripts(bodies: str, injection_bits: str, exfil_bits: str) -> Column:
    """Injection and exfiltration rules over each script body in turn."""
    found = (
        f"flatten(transform({bodies}, body -> concat({injection_sql('body', injection_bits)}, "
        f"{exfiltration_sql('body', exfil_bits)})))"
    )
    return F.expr(f"CASE WHEN {injection_bits} | {exfil_bits} != 0 THEN {found} ELSE {NO_FINDINGS} END")


def screened(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the screening result and, where worth a look, the text with substitutions undone."""
    df = df.withColumn("_screen", screening.screen(F.col(text)))
    worth = (F.col("_screen.injection") != 0) & text_functions.has_leet(F.col(text))
    return df.withColumn("_leet", F.when(worth, text_functions.unleet(F.col(text))))


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Like ``withColumn``, but evaluated exactly once per row.

    A one-element generator keeps the optimizer from copying an expensive expression into
    the filters and projections above it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_findings(
    df: DataFrame,
    text: str = "text",
    *,
    first: Sequence[Column] = (),
    after_invisible: Sequence[Column] = (),
    last: Sequence[Column] = (),
    ends: str | None = None,
) -> DataFrame:
    """Add ``findings``: all text detectors in reporting order.

    Format-specific detectors go before the text detectors (``first``), between the
    invisible-character count and the disguised payloads (``after_invisible``), or to
    the end (``last``). ``ends`` names the page ends of a paged text.
    """
    families = [
        *first,
        injection(text, "_screen.injection", ends),
        exfiltration(text, "_screen.exfil", ends),
        invisible(text, "_screen.other"),
        *after_invisible,
        base64_payloads(text, "_screen.other"),
        leet_payloads("_leet", "_screen.injection"),
        unicode_payloads("_screen.nfkd", "_screen.nfkd_injection"),
        *last,
    ]
    return bound(screened(df, text), "findings", F.concat(*families)).drop("_screen", "_leet")


def finding_rows(df: DataFrame, keys: Sequence[str], findings: str | Column = "findings") -> DataFrame:
    """One row per finding, with its position (from 1) within the document."""
    array = F.col(findings) if isinstance(findings, str) else findings
    rows = df.select(*keys, F.posexplode(array).alias("_pos", "_f"))
    return rows.select(*keys, (F.col("_pos") + 1).alias("pos"), "_f.*")
