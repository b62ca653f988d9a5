"""Scans of documents that come as rows (pages, paragraphs, cells) and are too large for one row.

The result is exactly that of the joined text, but no document is joined as a whole: its rows
are dealt out in *slices* of so many rows, and a slice is cut into blocks of so many bytes, at
the first line end behind each multiple that no match can cross. What a line end needs to
know of the lines before it is a little state that is added up along the rows: the
characters since the last word that may open a loose run, and whether the line's own end may
be inside a match. Where a slice ends between two cuts, its open tail is put together with the
head of the next slice; a running look over the slices (not the rows) of a document tells
which pieces belong together.

Blocks are scanned on their own. What depends on the whole document is merged from small
parts: the flags that switch the disguised readings on, the counts of invisible characters,
the counts by severity, and the first few findings, which decide the score.

``divided`` tells these documents from those of one block, which are scanned in place. Nothing
runs while the plan is made, and both ways give the same result. A document whose every
line end could be inside a match (say, nothing but blank lines) stays one block; rows without a
document id count as one document of one block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphwarden import rules
from glyphwarden.functions import screening, text as text_functions
from glyphwarden.operators import detect, score
from glyphwarden.sources import documents as sources

#: Bytes of text behind which a block ends at the next safe line end, and rows of a slice.
BLOCK_BYTES = 4 << 20
SLICE_ROWS = 2_000

FIRST, INJECTION, EXFIL, INVISIBLE, METADATA, ANOMALY, BASE64, LEET, UNICODE, LAST = range(10)
# What a row costs besides its text.
_ROW_BYTES = 32
# Every finding adds at least 5 x 0.5 to the score: from the 40th on it is at its cap.
_SCORE_DEPTH = 40
# Partial merges per document, so that the blocks of one document do not meet at once.
_MERGE_GROUPS = 64


class RowScan:
    """``documents``: one scored row per document; ``findings``: one row per finding, in order (planned when asked for)."""

    def __init__(self, documents: DataFrame, findings: Callable[[], DataFrame]):
        self.documents, self._findings = documents, findings

    @cached_property
    def findings(self) -> DataFrame:
        return self._findings()


def larger_ids(rows: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id of the documents of more than one block."""
    size = F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + _ROW_BYTES)
    return rows.groupBy("doc_id").agg(size.alias("_bytes")).filter(F.col("_bytes") > block_bytes).select("doc_id")


def divided(
    rows: DataFrame, text: str, block_bytes: int = BLOCK_BYTES, listed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows of documents of one block, rows of larger ones); of the larger ones only those ``listed`` (doc_id), if given.

    Sizes are counted map-side, without the texts. There is at most one larger document per
    ``block_bytes`` of input, so their ids are broadcast: rows are told apart before any shuffle,
    and only those of larger documents go the long way.
    """
    larger = larger_ids(rows, text, block_bytes)
    wanted = larger if listed is None else larger.join(listed, "doc_id", "left_semi")
    return rows.join(F.broadcast(larger), "doc_id", "left_anti"), rows.join(F.broadcast(wanted), "doc_id", "left_semi")


def of_larger(values: DataFrame, rows: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The values (doc_id, ...) of the documents of more than one block."""
    return values.join(F.broadcast(larger_ids(rows, text, block_bytes)), "doc_id", "left_semi")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the right side's other columns are added."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in keys])


def _with_sizes(rows: DataFrame) -> DataFrame:
    """Add the document's bytes before the slice (``_before``)."""
    slices = rows.groupBy("doc_id", "slice").agg(F.sum(F.octet_length("text") + 1).alias("_bytes"))
    earlier = Window.partitionBy("doc_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = slices.select("doc_id", "slice", F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_before"))
    return _joined(rows, sizes, ["doc_id", "slice"])


def _cut(sized: DataFrame, block_bytes: int) -> DataFrame:
    """Add ``piece`` (number of the row's piece within its slice), ``_cuts`` so far, and ``stop``.

    ``stop`` counts the characters of the piece up to the end of the row.
    """
    here = Window.partitionBy("doc_id", "slice").orderBy("ord")
    so_far, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("text")

    def open_end(text: Column) -> Column:
        # A tail is enough: no rule word is longer.
        return F.right(text_functions.strip(text), F.lit(120)).rlike(rules.OPEN_END)

    marked = sized.withColumn("_normal", screening.nfkd(line)).select(
        *sized.columns,
        F.char_length(text_functions.strip(line)).alias("_length"),
        (line.rlike(rules.LOOSE_RUN_WORD) | F.col("_normal").rlike(rules.LOOSE_RUN_WORD)).alias("_loose"),
        (open_end(line) | open_end(F.col("_normal"))).alias("_open"),
    )
    # Characters since the last possible start of a loose run; what precedes the slice is not relied on.
    summed = marked.select(
        "*", F.sum("_length").over(so_far).alias("_sum"), F.sum(F.octet_length("text") + 1).over(so_far).alias("_end"),
        F.sum(F.char_length("text") + 1).over(so_far).alias("_chars"),
    )
    since = F.col("_sum") - F.coalesce(F.max(F.when(F.col("_loose"), F.col("_sum"))).over(so_far), F.lit(0))
    judged = summed.withColumn("_since", since).withColumn(
        "_safe", (F.col("_length") > 0) & ~F.col("_open") & (F.col("_since") > rules.LOOSE_RUN_LENGTH + 20)
    ).withColumn("_index", F.floor((F.col("_before") + F.col("_end")) / block_bytes))
    last_index = F.coalesce(F.max(F.when(F.col("_safe"), F.col("_index"))).over(before), F.floor(F.col("_before") / block_bytes))
    cut = judged.withColumn("_is_cut", F.coalesce(F.col("_safe") & (F.col("_index") > last_index), F.lit(False)))
    pieces = cut.select(
        *sized.columns, "_chars", F.coalesce(F.count_if("_is_cut").over(before), F.lit(0)).alias("piece"),
        F.count_if("_is_cut").over(so_far).alias("_cuts"),
        F.coalesce(F.max(F.when(F.col("_is_cut"), F.col("_chars"))).over(before), F.lit(0)).alias("_base"),
    )
    return pieces.withColumn("stop", F.col("_chars") - F.col("_base")).drop("_chars", "_base")


def _pieces(sized: DataFrame, block_bytes: int) -> DataFrame:
    """One row per piece: its entries (ord, page, text, stop) in order."""
    entries = F.sort_array(F.collect_list(F.struct("ord", "page", "text", "stop")))
    return _cut(sized, block_bytes).groupBy("doc_id", "slice", "piece").agg(entries.alias("entries"), F.max("stop").alias("length"))


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: doc_id, block (sortable, the open last one null), entries with stops within the block."""
    sized = _with_sizes(rows)
    cuts = _cut(sized, block_bytes).groupBy("doc_id", "slice").agg(F.max("_cuts").alias("_cuts"))
    later = Window.partitionBy("doc_id").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("_cuts") > 0, F.struct("slice", F.lit(0).cast("long").alias("piece"))), ignorenulls=True).over(later)
    placed = _joined(_pieces(sized, block_bytes), cuts.withColumn("_next", following), ["doc_id", "slice"])
    # A piece ends at the cut of its own number; the tail of a slice at the first cut of a later one.
    closed = placed.withColumn("block", F.when(F.col("piece") < F.col("_cuts"), F.struct("slice", "piece")).otherwise(F.col("_next")))
    parts = F.sort_array(F.collect_list(F.struct("slice", "piece", "entries", "length")))
    merged = closed.groupBy("doc_id", "block").agg(parts.alias("parts"))

    def shifted(part: Column, i: Column) -> Column:
        base = F.aggregate(F.slice(F.col("parts.length"), F.lit(1), i), F.lit(0).cast("long"), lambda a, n: a + n)
        return F.transform(part["entries"], lambda e: F.struct(e["ord"], e["page"], e["text"], (e["stop"] + base).alias("stop")))

    return merged.select("doc_id", "block", F.flatten(F.transform("parts", shifted)).alias("entries"))


def _tagged(family: int, findings: str, table=(), prefix: str = "") -> str:
    """Findings with their place in the order: family, rule, position within the block."""
    rule = "0"
    if table:
        names = ", ".join(detect._quoted(prefix + description) for _, description, _ in table)
        rule = f"cast(array_position(array({names}), f.description) as int)"
    return f"transform({findings}, (f, k) -> struct({family} as fam, {rule} as rule, k as k, f as f))"


def _scan_blocks(rows: DataFrame, paged: bool, anomalies: bool, formulas: bool, block_bytes: int) -> DataFrame:
    """One row per block: tagged findings, flags, counts."""
    blocks = _blocks(rows, block_bytes).select(
        "doc_id", "block", "entries",
        F.array_join(F.transform("entries", lambda e: F.concat(e["text"], F.lit("\n"))), "").alias("text"),
        F.transform("entries", lambda e: F.struct(e["page"], e["stop"])).alias("ends"),
    )
    normalised = screening.nfkd(F.col("text")) != F.col("text")
    blocks = blocks.select("*", screening.screen(F.col("text")).alias("_screen"), normalised.alias("_changes"))
    # One block that normalisation changes switches the normalised reading on for all.
    changes = F.col("_changes")
    blocks = blocks.select(
        "*", F.when(F.col("_screen.injection") != 0, text_functions.unleet(F.col("text"))).alias("_leet"),
        F.when(changes, F.col("_screen.nfkd")).otherwise(F.col("text")).alias("_nfkd"),
        F.when(changes, F.col("_screen.nfkd_injection")).otherwise(F.col("_screen.injection")).alias("_nfkd_bits"),
    )
    ends = "ends" if paged else None
    found = [
        detect.injection("text", "_screen.injection", ends).alias("_f_inj"), detect.exfiltration("text", "_screen.exfil", ends).alias("_f_exf"),
        detect.base64_payloads("text", "_screen.other").alias("_f_b64"), detect.leet_payloads("_leet", "_screen.injection").alias("_f_leet"),
        detect.unicode_payloads("_nfkd", "_nfkd_bits").alias("_f_nfkd"),
    ]
    tagged = [
        _tagged(INJECTION, "_f_inj", rules.INJECTION_RULES), _tagged(EXFIL, "_f_exf", rules.EXFIL_RULES),
        _tagged(BASE64, "_f_b64"), _tagged(LEET, "_f_leet", rules.INJECTION_RULES, rules.DERIVED_LEET[0]),
        _tagged(UNICODE, "_f_nfkd", rules.INJECTION_RULES, rules.DERIVED_UNICODE[0]),
    ]
    if anomalies:
        page = (lambda e: e["page"]) if paged else (lambda e: F.lit(1))
        lines = F.flatten(F.transform("entries", lambda e: detect.anomalies(e["text"], page(e))))
        long_line = F.expr(f"_screen.other & {screening.HAS_LONG_LINE} != 0")
        found.append(F.when(long_line, lines).otherwise(detect.no_findings()).alias("_f_lines"))
        tagged.append(_tagged(ANOMALY, "_f_lines"))
    if formulas:
        found.append(detect.formulas(F.transform("entries", lambda e: e["text"])).alias("_f_formulas"))
        tagged.append(_tagged(FIRST, "_f_formulas"))
    bound = detect.bound(blocks.select("*", *found), "tagged", F.expr(f"concat({', '.join(tagged)})"))
    return bound.select(
        "doc_id", "block", F.size("entries").alias("n_rows"),
        F.char_length("text").cast("bigint").alias("chars"),
        text_functions.has_leet(F.col("text")).alias("leet"),
        changes.alias("nfkd"),
        F.expr(f"CASE WHEN _screen.other & {screening.HAS_INVISIBLE} != 0 THEN {detect.invisible_counts('text')} END").alias("counts"),
        "tagged",
    )


def _placed_findings(tagged: Column) -> Column:
    """Tagged findings with their block, in an order that sorts as the document's: open last block behind the others."""
    return F.transform(tagged, lambda t: F.struct(
        t["fam"].alias("fam"), t["rule"].alias("rule"), F.col("block").isNull().alias("open"), F.col("block").alias("block"),
        t["k"].alias("k"), t["f"].alias("f"),
    ))


# What counts always, and what counts only if a reading differs from the text somewhere in the document.
_CLASSES = {"plain": lambda t: ~t["fam"].isin(LEET, UNICODE), "leet": lambda t: t["fam"] == LEET, "nfkd": lambda t: t["fam"] == UNICODE}


def _merged_documents(scanned: DataFrame) -> DataFrame:
    """One row per document from its blocks: sums, flags, its first block, and the first findings of each class."""
    of_class = scanned.select(
        "*", F.pmod(F.hash("block"), F.lit(_MERGE_GROUPS)).alias("_group"), _placed_findings(F.col("tagged")).alias("_placed"),
    ).select("*", *[F.filter("_placed", is_class).alias(f"{name}_all") for name, is_class in _CLASSES.items()])
    # Counts by class and severity, and of each invisible character, as arrays that are added up place by place.
    counts = ", ".join(f"size(filter({n}_all, t -> t.f.severity = '{s}'))" for n in _CLASSES for s in score.SEVERITIES)
    parts = of_class.select(
        "doc_id", "_group", F.struct(F.col("block").isNull().alias("open"), "block").alias("start"), "n_rows", "chars", "leet", "nfkd",
        F.expr(f"array({counts})").alias("n_found"),
        F.expr("transform(counts, c -> c.n)").alias("hidden"),
        *[F.expr(f"slice(array_sort({n}_all), 1, {_SCORE_DEPTH})").alias(f"{n}_first") for n in _CLASSES],
    )

    def added(column: str, n: int) -> Column:
        return F.expr("array(" + ", ".join(f"sum(coalesce(get({column}, {i}), 0))" for i in range(n)) + ")").alias(column)

    def merge(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.min("start").alias("start"), F.sum("n_rows").alias("n_rows"), F.sum("chars").alias("chars"), F.bool_or("leet").alias("leet"), F.bool_or("nfkd").alias("nfkd"),
            added("n_found", len(_CLASSES) * len(score.SEVERITIES)), added("hidden", len(rules.INVISIBLE_CHARS)),
            *[F.expr(f"slice(array_sort(flatten(collect_list({n}_first))), 1, {_SCORE_DEPTH})").alias(f"{n}_first") for n in _CLASSES],
        )

    return merge(merge(parts, ["doc_id", "_group"]), ["doc_id"])


def _level(findings: Column, family: int) -> Column:
    """Document-level findings in the form of placed ones."""
    return F.transform(findings, lambda f, k: F.struct(F.lit(family).alias("fam"), F.lit(0).alias("rule"), k.alias("k"), f.alias("f")))


def _hidden_findings() -> Column:
    """The finding of invisible characters from their summed counts."""
    labels = [f"{name} (U+{code:04X})" for code, name in rules.INVISIBLE_CHARS]
    counts = "array(" + ", ".join(
        f"named_struct('label', {detect._quoted(label)}, 'n', cast(get(hidden, {i}) as int))" for i, label in enumerate(labels)
    ) + ")"
    return F.expr(detect.invisible_of_counts(counts))


def _document_levels(documents: DataFrame, metadata: DataFrame | None, properties: DataFrame | None) -> DataFrame:
    """Add ``_levels``: findings of the document as a whole."""
    levels = [_level(_hidden_findings(), INVISIBLE)]
    for findings, family in ((metadata, METADATA), (properties, LAST)):
        if findings is not None:
            documents = _joined(documents, findings.select("doc_id", F.col("findings").alias(f"_own{family}")), ["doc_id"], "left")
            levels.append(_level(F.coalesce(F.col(f"_own{family}"), detect.no_findings()), family))
    return documents.withColumn("_levels", F.concat(*levels))


def scan_rows(
    rows: DataFrame,
    *,
    paged: bool = False,
    anomalies: bool = True,
    formulas: bool = False,
    metadata: DataFrame | None = None,
    properties: DataFrame | None = None,
    threshold: int = rules.BLOCK_THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> RowScan:
    """Scan documents given as rows (doc_id, ord, slice, page, text).

    ``ord`` orders the rows of a document, ``slice`` is a coarser key in the same order
    (bounded rows each). ``metadata`` and ``properties`` are (doc_id, findings) arrays, one row per document.
    """
    scanned = _scan_blocks(rows, paged, anomalies, formulas, block_bytes)
    merged = _document_levels(_merged_documents(scanned), metadata, properties)

    nothing = F.filter("plain_first", lambda t: F.lit(False))
    counted = [
        F.col("plain_first"), F.when(F.col("leet"), F.col("leet_first")).otherwise(nothing),
        F.when(F.col("nfkd"), F.col("nfkd_first")).otherwise(nothing),
    ]
    # A family is either of blocks or of the document: order within each, then by family.
    by_family = F.concat(*[
        F.transform(found, lambda t, i: F.struct(t["fam"].alias("fam"), i.alias("at"), t["f"].alias("f")))
        for found in (F.array_sort(F.concat(*counted)), F.col("_levels"))
    ])
    first = merged.withColumn("_first", F.transform(F.array_sort(by_family), lambda t: t["f"]))
    risk = score.risk_score(F.col("_first"))

    def total(severity: str) -> Column:
        own = F.size(F.filter("_levels", lambda t: t["f"]["severity"] == severity))
        place = score.SEVERITIES.index(severity)
        plain, leet, nfkd = (F.get("n_found", F.lit(i * len(score.SEVERITIES) + place)) for i in range(len(_CLASSES)))
        return (plain + F.when(F.col("leet"), leet).otherwise(0) + F.when(F.col("nfkd"), nfkd).otherwise(0) + own).cast("int")

    summary = F.struct(*[total(s).alias(s) for s in score.SEVERITIES])
    scored = first.select("doc_id", risk.alias("risk_score"), summary.alias("threat_summary"), "chars", "n_rows")
    documents = scored.select(
        "doc_id", "risk_score", score.verdict(F.col("risk_score"), threshold).alias("verdict"), "threat_summary",
        sum((F.col(f"threat_summary.{s}") for s in score.SEVERITIES), F.lit(0)).alias("n_findings"),
        (F.col("chars") if paged else F.col("chars") - 1).alias("text_length"), "n_rows",
    )

    return RowScan(documents, lambda: _finding_rows(scanned, merged))


def _finding_rows(scanned: DataFrame, merged: DataFrame) -> DataFrame:
    """Findings as rows: those of the blocks with the document's flags, and, beside its first block, those of the document."""
    flags = merged.select("doc_id", "leet", "nfkd", "_levels", F.col("start.block").alias("_start"))
    blocks = _joined(scanned.select("doc_id", "block", _placed_findings(F.col("tagged")).alias("_placed")), flags, ["doc_id"])
    counted = F.filter("_placed", lambda t: ~t["fam"].isin(LEET, UNICODE) | F.when(t["fam"] == LEET, F.col("leet")).otherwise(F.col("nfkd")))
    own = F.transform("_levels", lambda t: F.struct(
        t["fam"].alias("fam"), t["rule"].alias("rule"), F.lit(None).cast("boolean").alias("open"),
        F.lit(None).cast(scanned.schema["block"].dataType).alias("block"), t["k"].alias("k"), t["f"].alias("f"),
    ))
    of_document = F.filter(own, lambda t: F.col("block").eqNullSafe(F.col("_start")))
    found = blocks.select("doc_id", F.explode(F.concat(counted, of_document)).alias("t")).select("doc_id", "t.*")
    place = Window.partitionBy("doc_id").orderBy("fam", "rule", "open", F.asc_nulls_last("block"), "k")
    return found.withColumn("pos", F.row_number().over(place)).select("doc_id", "pos", "f.*")


# Rows without a position come first, as in the joined text.
_FIRST_SLICE = -(1 << 40)


def _placed(rows: DataFrame, *position: str) -> DataFrame:
    """Add ``tie``: the place, by text, among rows that share a position."""
    same = Window.partitionBy("doc_id", *position).orderBy("text")
    return rows.withColumn("tie", F.row_number().over(same))


def _slice(position: str, slice_rows: int) -> Column:
    return F.coalesce(F.floor(F.col(position) / slice_rows), F.lit(_FIRST_SLICE))


def page_rows(pages: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    texts = pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    return _placed(texts, "page").select(
        "doc_id", F.struct("page", "tie").alias("ord"), _slice("page", slice_rows).alias("slice"), "page", "text",
    )


def part_rows(parts: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    texts = parts.select("doc_id", "kind", "ordinal", F.coalesce("text", F.lit("")).alias("text"))
    return _placed(texts, "kind", "ordinal").select(
        "doc_id", F.struct("kind", "ordinal", "tie").alias("ord"),
        F.struct(F.coalesce("kind", F.lit(-1)).alias("kind"), _slice("ordinal", slice_rows).alias("part")).alias("slice"),
        F.lit(1).alias("page"), "text",
    )


def cell_rows(cells: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    sheet = sources.sheet_order(cells)
    kept = cells.filter(sources.kept_cells(cells)).withColumnRenamed("value", "text")
    known = [F.coalesce("sheet_no", F.lit(_FIRST_SLICE)).alias("sheet_no")] if "sheet_no" in sheet else []
    named = [F.col("sheet").isNotNull().alias("named"), F.coalesce("sheet", F.lit("")).alias("sheet")]
    return _placed(kept, *sheet, "row", "col").select(
        "doc_id", F.struct(*sheet, "row", "col", "tie").alias("ord"),
        F.struct(*known, *named, _slice("row", slice_rows).alias("part")).alias("slice"),
        F.lit(1).alias("page"), "text",
    )
