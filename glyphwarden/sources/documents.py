"""Sources: bringing each kind of document into one text per document.

Binary containers are not parsed; their pages, paragraphs and cells arrive as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from glyphwarden.functions import html, text as text_functions


def any_case(suffixes: list[str]) -> str:
    """A glob for file names with one of the suffixes, in any letter case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def read_files(spark: SparkSession, path: str, suffixes: list[str]) -> DataFrame:
    """File name, path, format (the lower-case suffix) and text of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", any_case(suffixes)).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return plain_texts(
        files.select(name.alias("filename"), "path", F.lower(F.element_at(F.split(name, r"\."), -1)).alias("file_format"), "content")
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text files, one row per file (CSV is text here, not a table)."""
    return read_files(spark, path, ["txt", "md", "csv"])


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Web pages, one row per file, with their source in ``html``."""
    return read_files(spark, path, ["html", "htm"]).withColumnRenamed("text", "html").withColumn("file_format", F.lit("html"))


def plain_texts(files: DataFrame) -> DataFrame:
    """File bytes (``content``) to ``text``."""
    return files.withColumn("text", text_functions.decode_file(F.col("content"))).drop("content")


def paged_texts(pages: DataFrame) -> DataFrame:
    """Rows (doc_id, page, text) to one text per document; every page ends in a newline.

    Keeps ``pages`` (sorted ARRAY<STRUCT<page, text>>), as matches may cross pages, and ``ends``
    (ARRAY<STRUCT<page, stop>>): how many characters there are up to the end of each page. These
    are running sums over the rows, which the rows' own sort by document provides.
    """
    texts = pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
    so_far = Window.partitionBy("doc_id").orderBy("page", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = texts.withColumn("stop", F.sum(F.char_length("text") + 1).over(so_far))
    assembled = placed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text", "stop"))).alias("rows"))
    full = F.array_join(F.transform("rows", lambda p: F.concat(p["text"], F.lit("\n"))), "")
    return assembled.select(
        "doc_id", F.transform("rows", lambda p: F.struct(p["page"], p["text"])).alias("pages"),
        F.transform("rows", lambda p: F.struct(p["page"], p["stop"])).alias("ends"),
        full.alias("text"), F.size("rows").alias("total_pages"),
    )


def part_texts(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, kind, ordinal, text): paragraphs (kind 0), then table cells (kind 1)."""
    part = F.struct("kind", "ordinal", F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(part))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def kept_cells(cells: DataFrame) -> Column:
    """Whether a cell counts as text: neither empty nor a zero or false value.

    With a ``cell_type`` ("n" number, "b" boolean, else text) the value is judged by its type, so that
    the text "0" counts. Without one, the texts of zero and false do not count.
    """
    value = F.coalesce(F.col("value"), F.lit(""))
    untyped = ~value.isin("", "0", "False")
    if "cell_type" not in cells.columns:
        return untyped
    number = F.coalesce(value.try_cast("double") != 0, value != "")
    kind = F.col("cell_type")
    return F.when(kind.isNull(), untyped).when(kind == "n", number).when(kind == "b", ~F.lower(value).isin("", "0", "false")).otherwise(value != "")


def sheet_order(cells: DataFrame) -> list[str]:
    """Columns that order sheets: their place in the workbook (``sheet_no``) if it is known, then their name."""
    return ["sheet_no", "sheet"] if "sheet_no" in cells.columns else ["sheet"]


def cell_texts(cells: DataFrame) -> DataFrame:
    """Rows (doc_id, sheet, row, col, value[, sheet_no, cell_type]): non-empty values in sheet order, one per line.

    Empty, zero and false values do not count as text, but their sheet counts.
    """
    entry = F.when(kept_cells(cells), F.struct(*sheet_order(cells), "row", "col", "value"))
    assembled = cells.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), F.array_size(F.collect_set("sheet")).alias("total_pages")
    )
    values = F.transform("entries", lambda e: e["value"])
    return assembled.select(
        "doc_id", values.alias("cell_values"), "total_pages", F.array_join(values, "\n").alias("text")
    )


def html_texts(pages: DataFrame) -> DataFrame:
    """Rows with ``html`` to visible text, hidden element texts and script bodies."""
    parsed = pages.withColumn("_html", html.parse(text_functions.fold_newlines(F.col("html"))))
    return parsed.select(*[c for c in pages.columns if c != "html"], "_html.*")


def suspicious_markup(pages: DataFrame, what: str) -> DataFrame:
    """``html_texts`` of the pages that may have hidden elements (``what`` = "hides") or scripts with a hit ("scripts").

    Pages are screened as raw markup first; the others never reach the parser and are left out.
    """
    folded = pages.withColumn("html", text_functions.fold_newlines(F.col("html")))
    screened = folded.withColumn("_markup", html.screen(F.col("html"))).filter(F.col(f"_markup.{what}")).drop("_markup")
    parsed = screened.withColumn("_html", html.parse(F.col("html")))
    return parsed.select(*[c for c in pages.columns if c != "html"], "_html.*")
