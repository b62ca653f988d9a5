"""History, analytics, badges and accounts, including very uneven users."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphwarden import rules
from glyphwarden.operators import accounts, analytics, badges, history

SCHEMA = (
    "id long, user_id long, filename string, file_format string, verdict string, risk_score int, created_at timestamp_ntz, "
    "findings array<struct<category:string,description:string,severity:string,evidence:string,page:int,confidence:int>>"
)
START = dt.datetime(2024, 1, 1)


def make_records(n, seed=1, hot_share=0.4, spread_hours=200):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < hot_share else rng.randint(1, 30)
        findings = [
            (rng.choice(["A", "B", "C", None]), "d", rng.choice(["LOW", "HIGH", "CRITICAL"]), "e", 1, 90)
            for _ in range(rng.choice([0, 0, 1, 3]))
        ]
        rows.append((
            i, user, f"f{i}.TXT", rng.choice(["txt", "PDF", "md", "pdf"]), rng.choice(["ALLOWED", "ALLOWED", "BLOCKED"]),
            rng.randint(0, 100), START + dt.timedelta(minutes=rng.randint(0, spread_hours * 60)), findings,
        ))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_records(3000)


@pytest.fixture(scope="module")
def records(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def by_user(rows):
    users = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        users[r[1]].append(r)
    return users


def test_running_counters(records, rows):
    expected = {}
    for user, scans in by_user(rows).items():
        threats, formats = 0, set()
        for n, r in enumerate(scans, 1):
            threats += len(r[7])
            formats.add(r[3].lower())
            expected[r[0]] = (user, n, threats, len(formats))
    for unit in ("hour", "day"):
        got = badges.running_counters(records, unit).collect()
        assert {r.id: (r.user_id, r.scan_count, r.threat_count, r.format_count) for r in got} == expected


def expected_badges(rows, milestones):
    earned = {}
    for user, scans in by_user(rows).items():
        threats, formats, run = 0, set(), 0
        for n, r in enumerate(scans, 1):
            threats += len(r[7])
            formats.add(r[3].lower())
            run = run + 1 if r[4] == "ALLOWED" else 0
            reached = [b for b, m in milestones.items() if n >= m]
            reached += ["threat_hunter"] * (threats >= 10) + ["format_explorer"] * (len(formats) >= 3)
            reached += ["eagle_eye"] * any(f[2] == "CRITICAL" for f in r[7]) + ["clean_slate"] * (run >= 5)
            for badge in reached:
                earned.setdefault((user, badge), r[6])
    return earned


def test_badges(records, rows):
    found = badges.scan_badges(records).unionByName(badges.clean_slate(records)).collect()
    got = {(r.user_id, r.badge_key): r.earned_at for r in found}
    assert len(got) == len(found)
    assert got == expected_badges(rows, rules.SCAN_MILESTONES)


@pytest.mark.parametrize("seed, hours, unit", [(1, 200, "hour"), (2, 3, "minute"), (3, 2, "day"), (4, 2000, "hour")])
def test_badges_in_one_pass(spark, seed, hours, unit):
    rows = make_records(1500, seed, spread_hours=hours)
    summaries = badges.slice_summaries(spark.createDataFrame(rows, SCHEMA), slice_unit=unit)
    found = badges.scan_badges_of_slices(summaries).collect()
    assert {(r.user_id, r.badge_key): r.earned_at for r in found} == expected_badges(rows, rules.SCAN_MILESTONES)
    assert len({(r.user_id, r.badge_key) for r in found}) == len(found)


def test_badges_need_one_scan_and_two_shuffles(spark, records):
    plan = badges.all_scan_badges(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Scan") == 1


def test_merged_badges_keep_what_is_held(spark, records):
    candidates = badges.all_scan_badges(records)
    before = START - dt.timedelta(days=9)
    held = spark.createDataFrame([(0, "first_scan", before), (0, "gone", before)], "user_id long, badge_key string, earned_at timestamp_ntz")
    merged = {(r.user_id, r.badge_key): (r.earned_at, r.fresh) for r in badges.merged_badges(candidates.unionByName(candidates), held).collect()}
    assert merged[0, "first_scan"] == (before, False) and merged[0, "gone"] == (before, False)
    assert len(merged) == candidates.count() + 1 and sum(f for _, f in merged.values()) == candidates.count() - 1


def test_awarded_once(spark, records):
    candidates = badges.scan_badges(records)
    held = spark.createDataFrame([(0, "first_scan")], "user_id long, badge_key string")
    fresh = badges.newly_awarded(candidates.unionByName(candidates), held)
    assert fresh.filter("user_id = 0 AND badge_key = 'first_scan'").count() == 0
    assert fresh.count() == candidates.count() - 1


def test_category_counts(records, rows):
    counts, first = defaultdict(Counter), {}
    for r in sorted(rows):
        for pos, f in enumerate(r[7]):
            name = f[0] or "Unknown"
            counts[r[1]][name] += 1
            first.setdefault((r[1], name), (r[0], pos))
    got = {r.user_id: (r.top_category, r.top_count) for r in analytics.top_category(records).collect()}
    assert got == {
        u: max(c.items(), key=lambda kv: (kv[1], tuple(-x for x in first[(u, kv[0])]))) for u, c in counts.items()}
    for r in analytics.category_breakdown(records).collect():
        order = sorted(counts[r.user_id], key=lambda c: first[(r.user_id, c)])
        assert (r.n, order[r.label_position - 1]) == (counts[r.user_id][r.category], r.category)


@pytest.mark.parametrize("days,labels", [(3, 7), (None, 14), (400, 90)])
def test_trend_range(spark, records, days, labels):
    users = spark.createDataFrame([(0,), (77,)], "id long")
    now = F.lit("2024-01-09 12:00:00").cast("timestamp_ntz")
    trend = analytics.trend_gapfill(records, users, now, days)
    assert [r["count"] for r in trend.groupBy("user_id").count().collect()] == [labels, labels]
    assert trend.agg(F.max("day")).first()[0] == dt.date(2024, 1, 9)
    assert trend.filter("total <> blocked + allowed").count() == 0
    assert trend.filter("user_id = 77 AND total > 0").count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0, 19, 20, 79, 80, 100)], "risk_score int")
    assert [(r.label, r.scans) for r in analytics.risk_histogram(df).orderBy("bucket").collect()] == [
        ("0-19", 2), ("20-39", 1), ("40-59", 0), ("60-79", 1), ("80-100", 2)]


def test_summary_of_user_without_scans(spark, records):
    users = spark.createDataFrame([(500,)], "id long")
    row = analytics.user_summary(records, users).first()
    assert (row.total_scans, row.blocked_pct, row.avg_risk_score, row.top_category) == (0, 0.0, 0.0, "None")


def test_history_pages(spark):
    rows = make_records(31, hot_share=1.0)
    records = spark.createDataFrame(rows, SCHEMA)
    newest = [r[0] for r in sorted(rows, key=lambda r: (r[6], r[0]), reverse=True)]
    assert [r.id for r in history.page_of_user(records, 0, 3).collect()] == newest[30:]
    assert history.page_of_user(records, 0, 4).count() == 0
    assert [r.id for r in history.page_of_user(records, 0, -5, 0).collect()] == newest[:1]
    assert sorted(r.id for r in history.page_of_all_users(records, 2).collect()) == sorted(newest[15:30])
    last, past = history.envelope(records, 3).first(), history.envelope(records, 4).first()
    assert (last.pages, last.has_next, last.has_prev) == (3, False, True)
    assert (past.pages, past.has_next, past.has_prev) == (3, False, True)


@pytest.mark.parametrize("seed, hours, units", [(1, 200, ("day", "minute")), (2, 1, ("hour", "second")), (3, 400, ("hour",))])
def test_deep_pages(spark, seed, hours, units):
    """Page 21 x 50, page 40 x 50 of one user and every page in between give what a full sort gives."""
    rows = make_records(2600, seed, hot_share=0.9, spread_hours=hours)
    rows += [(9000 + i, u, "f", "txt", "ALLOWED", 0, t, []) for i, (u, t) in enumerate([(None, START), (None, None), (0, None), (3, None)] * 20)]
    records = spark.createDataFrame(rows, SCHEMA).repartition(5)
    newest = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[6] is not None, r[6] or START, r[0]), reverse=True):
        newest[r[1]].append(r[0])
    for page, size in ((21, 50), (40, 50), (1, 50), (2, 7), (60, 50)):
        expected = {i: (u, k) for u, ids in newest.items() for k, i in enumerate(ids, 1) if (page - 1) * size < k <= page * size}
        got = history.deep_page_of_all_users(records, page, size, units)
        assert {r.id: (r.user_id, r.position) for r in got.collect()} == expected
        assert got.columns == [*records.columns, "position"]
    assert history.page_of_all_users(records, 21, 50).count() == 50
    plan = history.page_of_all_users(records, 21, 50)._jdf.queryExecution().executedPlan().toString()
    assert "_slice" in plan


def test_history_filters(records):
    assert history.filtered(records, 0, q=" .txt ").count() == history.filtered(records, 0).count()
    assert history.filtered(records, verdict="nonsense").count() == records.count()
    assert history.filtered(records, file_format="MD").filter("file_format <> 'md'").count() == 0


def test_page_limit_reaches_the_scan(records):
    plan = history.page_of_all_users(records, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    plan = badges.scan_milestones(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_identify_and_clean(spark):
    users = spark.createDataFrame([(1, "k1"), (2, None), (3, "")], "id long, api_key string")
    scans = spark.createDataFrame(
        [(1, 1, None), (2, 9, "k1"), (3, 2, "k1"), (4, None, "k1"), (5, None, None), (6, None, ""), (7, None, "zz")],
        "id long, claimed_user_id long, api_key string")
    got = {r.id: r.user_id for r in accounts.identify_scans(scans, users).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: 1, 5: None, 6: None, 7: None}
    raw = spark.createDataFrame(
        [(1, " A@x "), (2, "a@X"), (3, None), (4, "nope"), (5, "b@x"), (6, "a@x　")], "id long, email string")
    got = {r.id: (r.email, r.reason) for r in accounts.clean_accounts(raw).collect()}
    assert got == {
        1: ("a@x", None), 2: ("a@x", "Email already registered"), 3: ("", "Email is required"),
        4: ("nope", "Invalid email address"), 5: ("b@x", None), 6: ("a@x", "Email already registered")}


def test_badge_catalogue_and_fallback(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    held = spark.createDataFrame(
        [(1, "veteran", START), (1, "gone", START)], "user_id long, badge_key string, earned_at timestamp_ntz")
    rows = badges.badges_of_users(users, held).collect()
    assert len(rows) == 2 * len(rules.BADGES) + 1
    assert {(r.user_id, r.key) for r in rows if r.earned} == {(1, "veteran"), (1, "gone")}
    fallback = next(r for r in rows if r.key == "gone")
    assert (fallback.name, fallback.icon, fallback.description) == ("gone", rules.BADGE_FALLBACK_ICON, "")
    catalogue = {r.key: r.holders for r in badges.badge_catalog(held).collect()}
    assert catalogue["veteran"] == 1 and len(catalogue) == 8 and sum(catalogue.values()) == 1


def test_claimed_user_decides_alone(spark):
    users = spark.createDataFrame([(7, "key")], "id long, api_key string")
    scans = spark.createDataFrame(
        [(1, 7, None), (2, 99, "key"), (3, None, "key"), (4, None, "other"), (5, None, None)], "id long, claimed_user_id long, api_key string"
    )
    found = {r.id: r.user_id for r in accounts.identify_scans(scans, users).collect()}
    assert found == {1: 7, 2: None, 3: 7, 4: None, 5: None}


def test_backslash_in_name_part(spark):
    records = spark.createDataFrame([("a\\b.txt",), ("ab.txt",)], "filename string")
    assert [r.filename for r in history.filtered(records, q="A\\B").collect()] == ["a\\b.txt"]


def test_catalogue_is_laid_out_behind_the_aggregation(spark):
    day = dt.datetime(2024, 1, 2)
    users = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long")
    held = spark.createDataFrame(
        [(1, "first_scan", day), (1, "first_scan", day - dt.timedelta(days=1)), (1, "early_bird", day), (7, "veteran", day), (7, None, day), (2, "eagle_eye", None)],
        "user_id long, badge_key string, earned_at timestamp_ntz",
    )
    found = badges.badges_of_users(users, held)
    catalogue = {k: (n, i, d) for k, n, i, d in rules.BADGES}
    expected = {(user, k): (*row, None) for user in (1, 2, None) for k, row in catalogue.items()}
    expected[1, "first_scan"] = (*catalogue["first_scan"], day - dt.timedelta(days=1))
    expected[1, "early_bird"] = ("early_bird", rules.BADGE_FALLBACK_ICON, "", day)
    expected[7, "veteran"] = (*catalogue["veteran"], day)
    expected[7, None] = (None, rules.BADGE_FALLBACK_ICON, "", day)
    rows = found.collect()
    assert len(rows) == len(expected)
    assert {(r.user_id, r.key): (r.name, r.icon, r.description, r.earned_at) for r in rows} == expected
    assert all(r.earned == (r.earned_at is not None) for r in rows)
    # Tasks that read the users must not hold the catalogue of each of them.
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    places = {name: [i for i, line in enumerate(plan) if name in line] for name in ("Generate", "Aggregate", "Repartition")}
    assert max(places["Generate"]) < min(places["Aggregate"]) < min(places["Repartition"])
