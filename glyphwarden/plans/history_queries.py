"""Registered queries of history, analytics, badges, accounts, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glyphwarden import rules
from glyphwarden.operators import accounts, analytics, badges, detect, documents as scans, history, score
from glyphwarden.plans import detection_sql as sql, fixtures as fx
from glyphwarden.plans.detection_queries import ORACLES as DETECTION_ORACLES, _PLAIN_CTES, query, _scored
from glyphwarden.session import fresh_folder
from glyphwarden.sources import batch, sinks
from glyphwarden.sources.tables import read_table
from glyphwarden.streaming import jobs

RECORDS, FINDINGS, USERS = f"({fx.SCAN_RECORDS_SQL})", f"({fx.SCAN_FINDINGS_SQL})", f"({fx.USERS_SQL})"
MILESTONES = {"first_scan": 1, "security_analyst": 50, "veteran": 70}
NOW = f"TIMESTAMP '{fx.NOW}'"


def _now():
    return F.lit(fx.NOW).cast("timestamp_ntz")


_records, _users = fx.scan_records, fx.users
_RECORD_COLUMNS = ["id", "user_id", "filename", "file_format", "verdict", "risk_score", "created_at"]

# ---------------------------------------------------------------- records as rows and JSON


@query("threat_count", f"SELECT id, n_findings AS threat_count FROM {RECORDS}")
def threat_count(spark, folder):
    return _records(spark, folder).select("id", score.threat_count(F.col("findings")).alias("threat_count"))


_ISO = (
    "CASE WHEN microsecond(created_at) % 1000000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END"
)


@query("record_view", f"""
SELECT id, filename, file_format, verdict, risk_score, n_findings AS threat_count, {_ISO} AS created_at
FROM {RECORDS}""")
def record_view(spark, folder):
    return history.record_view(_records(spark, folder), include_findings=False)


@query("json_roundtrip", f"""
SELECT r.id, f.pos, f.category, f.severity, f.evidence, CAST(100 - f.pos AS INTEGER) AS confidence,
  r.n_critical, r.n_low
FROM (SELECT r.id, CAST(count(*) FILTER (f.severity = 'CRITICAL') AS INTEGER) AS n_critical,
             CAST(count(*) FILTER (f.severity = 'LOW') AS INTEGER) AS n_low
      FROM {RECORDS} r JOIN {FINDINGS} f USING (id) GROUP BY r.id) r JOIN {FINDINGS} f USING (id)""")
def json_roundtrip(spark, folder):
    summarised = _records(spark, folder).withColumn("threat_summary", score.threat_summary(F.col("findings")))
    back = score.decode_records(score.encode_records(summarised))
    rows = back.select("id", "threat_summary", F.posexplode("findings").alias("at", "f"))
    return rows.select(
        "id", (F.col("at") + 1).alias("pos"), "f.category", "f.severity", "f.evidence", "f.confidence",
        F.col("threat_summary.CRITICAL").alias("n_critical"), F.col("threat_summary.LOW").alias("n_low"),
    )


# ---------------------------------------------------------------- history

@query("history_filter", f"""
SELECT id, user_id, filename, file_format, verdict, risk_score, created_at FROM {RECORDS}
WHERE filename ILIKE '%SE_%' AND verdict = 'BLOCKED' AND file_format = 'html'""")
def history_filter(spark, folder):
    return history.filtered(_records(spark, folder), q=" SE_ ", verdict="blocked", file_format="HTML").select(
        *_RECORD_COLUMNS
    )


_PAGE_SQL = f"""
SELECT id, user_id, filename, created_at, CAST(position AS INTEGER) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS position FROM {RECORDS})
WHERE position BETWEEN 16 AND 30"""


@query("history_page", _PAGE_SQL)
def history_page(spark, folder):
    return history.page_of_all_users(_records(spark, folder), 2).select(
        "id", "user_id", "filename", "created_at", "position"
    )


@query("history_deep_page", _PAGE_SQL)
def history_deep_page(spark, folder):
    return history.deep_page_of_all_users(_records(spark, folder), 2).select(
        "id", "user_id", "filename", "created_at", "position"
    )


@query("history_envelope", f"""
SELECT user_id, total, CAST(2 AS INTEGER) AS page, CAST(50 AS INTEGER) AS per_page, CAST(ceil(total / 50) AS INTEGER) AS pages,
  2 < ceil(total / 50) AS has_next, TRUE AS has_prev
FROM (SELECT user_id, count(*) AS total FROM {RECORDS} GROUP BY user_id)""")
def history_envelope(spark, folder):
    return history.envelope(_records(spark, folder), 2, 400)


# Every error event asks for the record of the same number; the odd ones name another user.
_REQUESTS_SQL = "SELECT event_id AS id, user_id + event_id % 2 AS user_id FROM events WHERE event_type = 'error'"


def _requests(spark, folder) -> DataFrame:
    errors = read_table(spark, folder, "events").filter("event_type = 'error'")
    return errors.select(
        F.col("event_id").alias("id"), (F.col("user_id") + F.col("event_id") % 2).alias("user_id")
    )


@query("history_detail", f"""
SELECT r.id, r.user_id, filename, file_format, verdict, risk_score, created_at, n_findings AS threat_count
FROM {RECORDS} r JOIN ({_REQUESTS_SQL}) q ON r.id = q.id AND r.user_id = q.user_id""")
def history_detail(spark, folder):
    found = history.details(_records(spark, folder), _requests(spark, folder))
    return found.select(*_RECORD_COLUMNS, F.size("findings").alias("threat_count"))


_ERASED_SQL = f"""
SELECT r.id, r.user_id, filename, created_at FROM {RECORDS} r
LEFT JOIN ({_REQUESTS_SQL}) q ON r.id = q.id AND r.user_id = q.user_id WHERE q.id IS NULL"""


@query("erase_records", _ERASED_SQL)
def erase_records(spark, folder):
    return history.erased(_records(spark, folder), _requests(spark, folder)).select(
        "id", "user_id", "filename", "created_at"
    )


def _export_sql() -> str:
    """Indented JSON spelled out: two blanks per level, ' : ' after keys, '[ ]' around lists."""
    def member(key: str, value: str, indent: int, last: bool = False) -> str:
        return f"'{' ' * indent}\"{key}\" : ', {value}, '{'' if last else ','}', chr(10)"

    def text(value: str) -> str:
        return f"concat('\"', {value}, '\"')"

    item = "concat('{', chr(10), " + ", ".join([
        member("category", text("x.category"), 4), member("description", text("concat('rule ', x.pos)"), 4),
        member("severity", text("x.severity"), 4), member("evidence", text("x.evidence"), 4), member("page", "'1'", 4),
        member("confidence", "CAST(100 - x.pos AS VARCHAR)", 4, last=True)]) + ", '  }')"
    listing = f"coalesce(concat('[ ', array_to_string(list_transform(fs, lambda x: {item}), ', '), ' ]'), '[ ]')"
    body = "concat('{', chr(10), " + ", ".join([
        member("id", "CAST(id AS VARCHAR)", 2), member("filename", text("filename"), 2), member("file_format", text("file_format"), 2),
        member("verdict", text("verdict"), 2), member("risk_score", "CAST(risk_score AS VARCHAR)", 2),
        member("threat_count", "CAST(n_findings AS VARCHAR)", 2), member("created_at", text(_ISO), 2),
        member("findings", listing, 2, last=True)]) + ", '}')"
    return (
        f"SELECT concat('scan_', CAST(id AS VARCHAR), '_', filename, '.json') AS export_name, "
        f"CASE WHEN n_findings = 0 THEN replace({body}, '[  ]', '[ ]') ELSE {body} END AS payload "
        f"FROM {RECORDS} r LEFT JOIN (SELECT id AS fid, list({{'pos': pos, 'category': category, 'severity': severity, "
        f"'evidence': evidence}} ORDER BY pos) AS fs FROM {FINDINGS} GROUP BY id) f ON f.fid = r.id"
    )


@query("export_scan_json", _export_sql())
def export_scan_json(spark, folder):
    return history.exported(_records(spark, folder))


# ---------------------------------------------------------------- analytics

_TOP_SQL = f"""
SELECT user_id, category, n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_id, first_pos) AS rn FROM (
    SELECT user_id, category, count(*) AS n, min(id) AS first_id, arg_min(pos, (id, pos)) AS first_pos
    FROM {FINDINGS} GROUP BY user_id, category)) WHERE rn = 1"""


@query("user_summary", f"""
SELECT u.id AS user_id, coalesce(total, 0) AS total_scans, coalesce(blocked, 0) AS blocked,
  coalesce(total, 0) - coalesce(blocked, 0) AS allowed,
  CASE WHEN total > 0 THEN round_even(blocked / total * 100, 1) ELSE CAST(0 AS DOUBLE) END AS blocked_pct,
  round_even(coalesce(mean, 0), 1) AS avg_risk_score, CAST(coalesce(threats, 0) AS BIGINT) AS total_threats,
  coalesce(t.category, 'None') AS top_category
FROM {USERS} u LEFT JOIN (
  SELECT user_id, count(*) AS total, count(*) FILTER (verdict = 'BLOCKED') AS blocked, avg(risk_score) AS mean,
         sum(n_findings) AS threats FROM {RECORDS} GROUP BY user_id) s ON s.user_id = u.id
LEFT JOIN ({_TOP_SQL}) t ON t.user_id = u.id""")
def user_summary(spark, folder):
    return analytics.user_summary(_records(spark, folder), _users(spark, folder))


@query("avg_risk", f"""
SELECT user_id, round_even(avg(risk_score), 1) AS avg_risk_score FROM {RECORDS} GROUP BY user_id""")
def avg_risk(spark, folder):
    return analytics.avg_risk(_records(spark, folder))


@query("top_category", f"SELECT user_id, category AS top_category, n AS top_count FROM ({_TOP_SQL})")
def top_category(spark, folder):
    return analytics.top_category(_records(spark, folder))


_DAILY_SQL = f"""
SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (verdict = 'BLOCKED') AS blocked,
  count(*) FILTER (verdict = 'ALLOWED') AS allowed
FROM {RECORDS} WHERE created_at >= {NOW} - INTERVAL {{days}} DAY GROUP BY user_id, CAST(created_at AS DATE)"""


@query("daily_trends", _DAILY_SQL.format(days=14))
def daily_trends(spark, folder):
    return analytics.daily_trends(_records(spark, folder), _now())


@query("trend_gapfill", f"""
SELECT c.user_id, c.day, coalesce(total, 0) AS total, coalesce(blocked, 0) AS blocked, coalesce(allowed, 0) AS allowed
FROM (SELECT id AS user_id, CAST(unnest(generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day
      FROM {USERS}) c
LEFT JOIN ({_DAILY_SQL.format(days=7)}) d ON d.user_id = c.user_id AND d.day = c.day""")
def trend_gapfill(spark, folder):
    return analytics.trend_gapfill(_records(spark, folder), _users(spark, folder), _now(), 3)


@query("category_breakdown", f"""
SELECT user_id, category, n, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_id, first_pos) AS INTEGER) AS label_position
FROM (SELECT user_id, category, count(*) AS n, min(id) AS first_id, arg_min(pos, (id, pos)) AS first_pos
      FROM {FINDINGS} GROUP BY user_id, category)""")
def category_breakdown(spark, folder):
    return analytics.category_breakdown(_records(spark, folder))


@query("global_stats", f"""
SELECT total_scans, total_blocked, (SELECT count(*) FROM {USERS}) AS total_users,
  CASE WHEN total_scans > 0 THEN round_even(total_blocked / total_scans * 100, 1) ELSE CAST(0 AS DOUBLE) END AS blocked_pct
FROM (SELECT count(*) AS total_scans, count(*) FILTER (verdict = 'BLOCKED') AS total_blocked FROM {RECORDS})""")
def global_stats(spark, folder):
    return analytics.global_stats(_records(spark, folder), _users(spark, folder))


@query("risk_histogram", f"""
SELECT CAST(b AS INTEGER) AS bucket, {fx.sql_list(rules.RISK_BUCKETS)}[b + 1] AS label,
  (SELECT count(*) FROM {RECORDS} WHERE least(risk_score // 20, 4) = b) AS scans
FROM range(5) t(b)""")
def risk_histogram(spark, folder):
    return analytics.risk_histogram(_records(spark, folder))


# ---------------------------------------------------------------- counters and badges

_COUNTERS_SQL = f"""
SELECT user_id, count(*) AS scan_count, CAST(sum(n_findings) AS BIGINT) AS threat_count,
  string_agg(DISTINCT file_format, ',' ORDER BY file_format) AS formats_used
FROM {RECORDS} GROUP BY user_id"""


def _flat_formats(df: DataFrame) -> DataFrame:
    return df.withColumn("formats_used", F.array_join("formats_used", ","))


@query("user_counters", _COUNTERS_SQL)
def user_counters(spark, folder):
    return _flat_formats(badges.user_counters(_records(spark, folder)))


_RUNNING_SQL = f"""
SELECT id, user_id, created_at, n_findings, verdict, scan_count, threat_count, CAST(format_count AS INTEGER) AS format_count, new_format
FROM (SELECT *, row_number() OVER w AS scan_count, CAST(sum(n_findings) OVER w AS BIGINT) AS threat_count,
        sum(CASE WHEN new_format THEN 1 ELSE 0 END) OVER w AS format_count
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, file_format ORDER BY created_at, id) = 1 AS new_format
            FROM {RECORDS})
      WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING))"""


@query("user_counters_running", f"SELECT id, user_id, scan_count, threat_count, format_count FROM ({_RUNNING_SQL})")
def user_counters_running(spark, folder):
    return badges.running_counters(_records(spark, folder)).select(
        "id", "user_id", "scan_count", "threat_count", "format_count"
    )


_MILESTONE_SQL = " UNION ALL ".join(
    f"SELECT user_id, '{badge}' AS badge_key, created_at AS earned_at FROM ({_RUNNING_SQL}) WHERE scan_count = {n}"
    for badge, n in MILESTONES.items()
)
_HUNTER_SQL = (
    f"SELECT user_id, 'threat_hunter' AS badge_key, created_at AS earned_at FROM ({_RUNNING_SQL}) "
    "WHERE threat_count >= 10 AND threat_count - n_findings < 10"
)
_EAGLE_SQL = (
    f"SELECT user_id, 'eagle_eye' AS badge_key, min(created_at) AS earned_at FROM {FINDINGS} "
    "WHERE severity = 'CRITICAL' GROUP BY user_id"
)
_EXPLORER_SQL = (
    f"SELECT user_id, 'format_explorer' AS badge_key, created_at AS earned_at FROM ({_RUNNING_SQL}) "
    "WHERE format_count = 3 AND new_format"
)
_SCAN_BADGES_SQL = " UNION ALL ".join([_MILESTONE_SQL, _HUNTER_SQL, _EXPLORER_SQL, _EAGLE_SQL])


@query("badge_scan_milestones", _MILESTONE_SQL)
def badge_scan_milestones(spark, folder):
    return badges.scan_milestones(_records(spark, folder), MILESTONES)


@query("badge_threat_hunter", _HUNTER_SQL)
def badge_threat_hunter(spark, folder):
    return badges.threat_hunter(_records(spark, folder))


@query("badge_eagle_eye", _EAGLE_SQL)
def badge_eagle_eye(spark, folder):
    return badges.eagle_eye(_records(spark, folder))


@query("badge_format_explorer", _EXPLORER_SQL)
def badge_format_explorer(spark, folder):
    return badges.format_explorer(_records(spark, folder))


_API_SQL = "SELECT user_id, 'api_master' AS badge_key, min(ts) AS earned_at FROM events WHERE event_type = 'signup' GROUP BY user_id"


@query("badge_api_master", _API_SQL)
def badge_api_master(spark, folder):
    return badges.first_event(read_table(spark, folder, "events"), "signup")


_SLATE_SQL = f"""
SELECT user_id, 'clean_slate' AS badge_key, min(created_at) AS earned_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY created_at, id) AS run FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id)
            - row_number() OVER (PARTITION BY user_id, verdict ORDER BY created_at, id) AS island FROM {RECORDS})
  WHERE verdict = 'ALLOWED') WHERE run = 5 GROUP BY user_id"""


@query("badge_clean_slate", _SLATE_SQL)
def badge_clean_slate(spark, folder):
    return badges.clean_slate(_records(spark, folder))


_HELD_SQL = (
    f"SELECT id AS user_id, 'first_scan' AS badge_key, TIMESTAMP '2023-12-31 00:00:00' AS earned_at FROM {USERS} WHERE role <> 'analyst' "
    f"UNION ALL SELECT id, 'early_bird', TIMESTAMP '2023-12-30 00:00:00' FROM {USERS} WHERE role = 'admin'"
)


def _held(spark, folder) -> DataFrame:
    """Badges from before: one known, one no longer in the catalogue."""
    def badge(key: str, day: str, condition):
        return F.when(condition, F.struct(F.lit(key).alias("badge_key"), F.lit(day).cast("timestamp_ntz").alias("earned_at")))

    role = F.col("role")
    held = F.array_compact(F.array(badge("first_scan", "2023-12-31", role != "analyst"), badge("early_bird", "2023-12-30", role == "admin")))
    return _users(spark, folder).select(F.col("id").alias("user_id"), F.explode(held).alias("b")).select("user_id", "b.*")


def _candidates(spark, folder, only=lambda df: df) -> DataFrame:
    api = badges.first_event(only(read_table(spark, folder, "events")), "signup")
    return badges.all_scan_badges(only(_records(spark, folder)), MILESTONES).unionByName(api)


_CANDIDATES_SQL = " UNION ALL ".join(
    f"SELECT user_id, badge_key, earned_at FROM ({q})" for q in (_SCAN_BADGES_SQL, _SLATE_SQL, _API_SQL)
)
_NEW_SQL = f"SELECT c.* FROM ({_CANDIDATES_SQL}) c LEFT JOIN ({_HELD_SQL}) h USING (user_id, badge_key) WHERE h.earned_at IS NULL"


@query("badge_award_once", _NEW_SQL)
def badge_award_once(spark, folder):
    return badges.merged_badges(_candidates(spark, folder), _held(spark, folder)).filter("fresh").drop("fresh")


def _all_badges(spark, folder, only=lambda df: df) -> DataFrame:
    """Badges held before and new ones, of the users that ``only`` leaves in each table."""
    return badges.merged_badges(_candidates(spark, folder, only), only(_held(spark, folder))).drop("fresh")


_BADGES_SQL = f"{_HELD_SQL} UNION ALL {_NEW_SQL}"
_DEFS_SQL = "(VALUES " + ", ".join("(" + ", ".join(fx.sql_text(v) for v in row) + ")" for row in rules.BADGES) + ") d(key, name, icon, description)"


@query("badges_me", f"""
SELECT coalesce(c.user_id, b.user_id) AS user_id, coalesce(c.key, b.badge_key) AS key, coalesce(c.name, b.badge_key) AS name,
  coalesce(c.icon, '{rules.BADGE_FALLBACK_ICON}') AS icon, coalesce(c.description, '') AS description,
  b.earned_at IS NOT NULL AS earned, b.earned_at
FROM (SELECT u.id AS user_id, d.* FROM {USERS} u CROSS JOIN {_DEFS_SQL}) c
FULL JOIN ({_BADGES_SQL}) b ON b.user_id = c.user_id AND b.badge_key = c.key""")
def badges_me(spark, folder):
    return badges.badges_of_users(_users(spark, folder), _all_badges(spark, folder))


@query("badge_catalog", f"""
SELECT d.key, d.name, d.icon, d.description, count(b.user_id) AS holders
FROM {_DEFS_SQL} LEFT JOIN ({_BADGES_SQL}) b ON b.badge_key = d.key GROUP BY ALL""")
def badge_catalog(spark, folder):
    return badges.badge_catalog(_all_badges(spark, folder))


def _mask_sql(email: str) -> str:
    return f"concat(left(split_part({email}, '@', 1), 3), '***@', substr({email}, strpos({email}, '@') + 1))"


@query("leaderboard", f"""
SELECT CAST(row_number() OVER (ORDER BY scan_count DESC, user_id) AS INTEGER) AS rank, user_id, {_mask_sql('email')} AS email_masked,
  scan_count, threat_count, (SELECT count(*) FROM ({_BADGES_SQL}) b WHERE b.user_id = t.user_id) AS badge_count
FROM (SELECT u.id AS user_id, email, coalesce(scan_count, 0) AS scan_count, coalesce(threat_count, 0) AS threat_count
      FROM {USERS} u LEFT JOIN ({_COUNTERS_SQL}) c ON c.user_id = u.id ORDER BY scan_count DESC, u.id LIMIT 10) t""")
def leaderboard(spark, folder):
    top = badges.stored_top(badges.top_users(_records(spark, folder), _users(spark, folder)))
    ids = [row.user_id for row in top.collect()]
    return badges.leaderboard(top, _all_badges(spark, folder, lambda df: df.filter(F.col("user_id").isin(ids))))


@query("mask_email", f"SELECT id, {_mask_sql('email')} AS email_masked FROM {USERS}")
def mask_email(spark, folder):
    from glyphwarden.functions import text as text_functions

    return _users(spark, folder).select("id", text_functions.mask_email(F.col("email")).alias("email_masked"))


@query("user_profile", f"""
SELECT id, email, role, api_key IS NOT NULL AND api_key <> '' AS has_api_key, coalesce(scan_count, 0) AS scan_count,
  coalesce(threat_count, 0) AS threat_count, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at
FROM {USERS} u LEFT JOIN ({_COUNTERS_SQL}) c ON c.user_id = u.id""")
def user_profile(spark, folder):
    return accounts.user_profile(_users(spark, folder), badges.user_counters(_records(spark, folder)))


# Claims: most events name their user, some a user nobody knows, some only a key, some nothing.
_CLAIMS_SQL = """
SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN user_id + 100000000 ELSE user_id END AS claimed_user_id,
  CASE WHEN event_id % 5 < 2 THEN concat('key_', CAST(user_id AS VARCHAR)) WHEN event_id % 5 = 2 THEN '' END AS api_key
FROM events"""


def _claims(spark, folder) -> DataFrame:
    kind, user = F.col("event_id") % 5, F.col("user_id")
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.when(kind == 1, user + 100000000).when(kind > 1, user).alias("claimed_user_id"),
        F.when(kind < 2, F.concat(F.lit("key_"), user.cast("string"))).when(kind == 2, "").alias("api_key"),
    )


@query("identify_scans", f"""
SELECT s.id, CASE WHEN s.claimed_user_id IS NOT NULL THEN a.id ELSE b.id END AS user_id FROM ({_CLAIMS_SQL}) s
LEFT JOIN {USERS} a ON a.id = s.claimed_user_id LEFT JOIN {USERS} b ON b.api_key = s.api_key AND s.api_key <> ''""")
def identify_scans(spark, folder):
    return accounts.identify_scans(_claims(spark, folder), _users(spark, folder)).select("id", "user_id")


# Registrations: every third address appears again in other spelling, some are bad.
_REGISTRATIONS_SQL = """
SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'nobody.example.com'
  ELSE concat(chr(9), 'User', CAST(o_custkey AS VARCHAR), '@Example.com ') END AS email FROM orders"""


@query("clean_accounts", f"""
SELECT id, email, CASE WHEN email = '' THEN 'Email is required' WHEN NOT contains(email, '@') THEN 'Invalid email address'
  WHEN row_number() OVER (PARTITION BY email ORDER BY id) > 1 THEN 'Email already registered' END AS reason
FROM (SELECT id, lower({sql.strip_sql("coalesce(email, '')")}) AS email FROM ({_REGISTRATIONS_SQL}))""")
def clean_accounts(spark, folder):
    kind = F.col("o_orderkey") % 11
    registrations = read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(kind == 0, F.lit(None)).when(kind == 1, "  ").when(kind == 2, "nobody.example.com").otherwise(
            F.concat(F.lit("\tUser"), F.col("o_custkey").cast("string"), F.lit("@Example.com "))
        ).alias("email"),
    )
    return accounts.clean_accounts(registrations).select("id", "email", "reason")


# ---------------------------------------------------------------- batch calls and sinks

_ACCEPTED_SQL = f"SELECT u.*, r.kind, ltrim(r.suffix, '.') AS stored_format FROM ({fx.UPLOADS_SQL}) u JOIN ({DETECTION_ORACLES['route_format']}) r USING (doc_id) WHERE r.kind IS NOT NULL"
_BATCH_SRC_SQL = f"""
SELECT doc_id, filename, kind, stored_format,
  CASE kind WHEN 'paged' THEN concat(text, chr(10))
    WHEN 'cells' THEN array_to_string(list_filter(string_split(text, chr(10)), lambda x: x NOT IN ('', '0', 'False')), chr(10))
    WHEN 'html' THEN CASE WHEN NOT regexp_full_match(text, '[ \t\n\f\r]+') THEN text WHEN contains(text, chr(10)) THEN chr(10) ELSE ' ' END
    ELSE text END AS text
FROM ({_ACCEPTED_SQL})"""


def _batch_ctes() -> dict[str, str]:
    ctes = sql.scan_ctes(_BATCH_SRC_SQL, anomalies=False, extra=[
        sql.anomaly_sql("(SELECT * FROM src WHERE kind IN ('paged', 'parts', 'plain'))")])
    return ctes


_BATCH_SQL = sql.with_ctes(_batch_ctes(), f"""
SELECT doc_id, filename, stored_format, verdict, risk_score, n_findings, CAST(length(text) AS INTEGER) AS text_length,
  CAST(NULL AS VARCHAR) AS error FROM results JOIN src USING (doc_id)
UNION ALL
SELECT doc_id, filename, NULL, NULL, NULL, NULL, NULL, error FROM ({DETECTION_ORACLES['route_format']}) WHERE error IS NOT NULL""")


def _batch(spark, folder) -> DataFrame:
    # One page, cell or paragraph per line of text; markup is scanned as a page body.
    return batch.scan_uploads(fx.uploads(spark, folder))


@query("scan_batch", _BATCH_SQL)
def scan_batch(spark, folder):
    return _batch(spark, folder).select(
        "doc_id", "filename", "stored_format", "verdict", "risk_score",
        F.when(F.col("error").isNull(), F.size("findings")).alias("n_findings"), "text_length", "error",
    )


@query("scan_batch_count", sql.with_ctes(_batch_ctes(), f"""
SELECT count(*) AS count, count(*) FILTER (verdict = 'BLOCKED') AS blocked, count(*) FILTER (error IS NOT NULL) AS errors
FROM (SELECT doc_id, verdict, NULL AS error FROM results UNION ALL
      SELECT doc_id, NULL, error FROM ({DETECTION_ORACLES['route_format']}) WHERE error IS NOT NULL)"""))
def scan_batch_count(spark, folder):
    return _batch(spark, folder).agg(
        F.count("*").alias("count"), F.count_if(F.col("verdict") == "BLOCKED").alias("blocked"),
        F.count("error").alias("errors"),
    )


# One batch of all kinds: turns as PDF pages, documents as Word files and, eight of nine, as texts, orders as workbooks, web pages.
_KINDS = [("scan_pages_doc", "scan_pages_findings", 0, "call", "pdf"), ("scan_parts_doc", "scan_parts_findings", 1, "note", "docx"),
          ("scan_cells_doc", "scan_cells_findings", 2, "book", "XLSX"), ("scan_html_doc", "scan_html_findings", 3, "page", "html"),
          ("scan_plain_doc", "findings_union", 4, "text", "md")]
_LISTED = "(k <> 4 OR doc_id % 9 <> 0)"


def _of_kinds(columns: str, which: int) -> str:
    return " UNION ALL ".join(
        f"SELECT doc_id * 5 + {kind[2]} AS doc_id, concat('{kind[3]}_', CAST(doc_id AS VARCHAR), '.{kind[4]}') AS filename, "
        f"lower('{kind[4]}') AS stored_format, {columns} FROM (SELECT *, {kind[2]} AS k{', CAST(1 AS INTEGER) AS total_pages' * (kind[0] == 'scan_plain_doc' and which == 0)} "
        f"FROM ({DETECTION_ORACLES[kind[which]]})) WHERE {_LISTED}"
        for kind in _KINDS
    )


def _files(spark, folder):
    tables = {
        "pages": fx.pages(spark, folder), "parts": fx.parts(spark, folder), "cells": fx.cells(spark, folder),
        "markup": fx.html_pages(spark, folder), "texts": fx.documents(spark, folder),
    }
    ids = [("conversations", "conv_id"), ("documents", "doc_id"), ("lineitem", "l_orderkey"), ("pages", "page_id"), ("documents", "doc_id")]
    listing = None
    for (table, id_), (_, _, k, stem, suffix) in zip(ids, _KINDS):
        name = F.concat(F.lit(f"{stem}_"), F.col("id").cast("string"), F.lit("."), F.when((F.lit(k) == 4) & (F.col("id") % 9 == 0), "exe").otherwise(suffix))
        own = read_table(spark, folder, table).select(F.col(id_).alias("id")).distinct().select((F.col("id") * 5 + k).alias("doc_id"), name.alias("filename"))
        listing = own if listing is None else listing.unionByName(own)
    numbered = {name: df.withColumn("doc_id", F.col("doc_id") * 5 + k) for k, (name, df) in enumerate(tables.items())}
    return batch.scan_files(
        listing, **numbered, metadata=fx.document_metadata(spark, folder).withColumn("doc_id", F.col("doc_id") * 5),
        properties=fx.properties(spark, folder).withColumn("doc_id", F.col("doc_id") * 5 + 1),
    )


_REFUSED_SQL = f"""
SELECT doc_id * 5 + 4 AS doc_id, concat('text_', CAST(doc_id AS VARCHAR), '.exe') AS filename, NULL AS stored_format, NULL AS verdict,
  NULL AS risk_score, NULL AS n_findings, NULL AS total_pages, NULL AS text_length,
  'Unsupported format ''.exe''. Allowed: {", ".join(sorted(row[0] for row in rules.FORMATS))}' AS error
FROM documents WHERE doc_id % 9 = 0"""


@query("scan_files", "SELECT * FROM (" + _of_kinds(
    "verdict, risk_score, n_findings, total_pages, CAST(text_length AS BIGINT) AS text_length, CAST(NULL AS VARCHAR) AS error", 0
) + f") UNION ALL {_REFUSED_SQL}")
def scan_files(spark, folder):
    return _files(spark, folder).documents.select(
        "doc_id", "filename", "stored_format", "verdict", "risk_score", "n_findings", "total_pages", "text_length", "error"
    )


@query("scan_files_findings", f"SELECT doc_id, pos, category, description, severity, evidence, page, confidence FROM ("
       + _of_kinds("pos, category, description, severity, evidence, page, confidence", 1) + ")")
def scan_files_findings(spark, folder):
    return _files(spark, folder).findings.select("doc_id", "pos", "category", "description", "severity", "evidence", "page", "confidence")


@query("sink_scan_records", sql.with_ctes(
    {**_PLAIN_CTES, "stored": f"""
       SELECT r.*, CAST(doc_id % 97 AS BIGINT) AS user_id, DATE '2024-01-01' + CAST(doc_id % 28 AS INTEGER) AS scan_date,
         length(text) AS text_length
       FROM results r JOIN src USING (doc_id) WHERE doc_id % 4 <> 0"""},
    f"""SELECT s.doc_id AS id, user_id, verdict, risk_score, CAST(text_length AS INTEGER) AS text_length, scan_date, n4 AS critical, n_findings,
      coalesce(f.listing, '') AS listing
    FROM stored s LEFT JOIN (SELECT doc_id, string_agg(concat(category, '/', {sql.LEVEL_NAME}), ';' ORDER BY {sql.ORDER}) AS listing
      FROM found GROUP BY doc_id) f ON f.doc_id = s.doc_id"""))
def sink_scan_records(spark, folder):
    scanned = scans.scan_plain(fx.documents(spark, folder))
    # Every fourth document is scanned anonymously and must not be stored.
    owned = scanned.withColumn("user_id", F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 97)).withColumn(
        "created_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")).cast("timestamp_ntz")
    ).withColumn("stored_format", F.lit("txt"))
    path = fresh_folder(spark, "scan-records")
    for _ in range(2):  # the same batch once more, as after a failure
        sinks.append_records(sinks.stored_form(owned), path, "first")
    listing = F.array_join(F.transform("findings", lambda f: F.concat_ws("/", f["category"], f["severity"])), ";")
    return sinks.read_records(spark, path).select(
        "id", "user_id", "verdict", "risk_score", "text_length", "scan_date",
        F.col("threat_summary.CRITICAL").alias("critical"), F.size("findings").alias("n_findings"), listing.alias("listing"),
    )


@query("sink_erase_records", _ERASED_SQL)
def sink_erase_records(spark, folder):
    records = _records(spark, folder)
    path = fresh_folder(spark, "scan-records")
    for half in range(2):
        sinks.append_records(records.filter(F.col("id") % 2 == half), path, str(half))
    sinks.erase_records(spark, path, _requests(spark, folder), "requests")
    return spark.read.parquet(path).select("id", "user_id", "filename", "created_at")


# ---------------------------------------------------------------- streams

def _stream_of(spark, folder, table: str) -> DataFrame:
    return jobs.read_stream(spark, folder, f"{table}.parquet")


@query("stream_scan", sql.with_ctes(_PLAIN_CTES, "SELECT * FROM results"))
def stream_scan(spark, folder):
    read_table(spark, folder, "documents")
    documents = _stream_of(spark, folder, "documents").select("doc_id", fx.planted("text", "doc_id").alias("text"))
    target, checkpoint = jobs._folders(spark, "stream-scan")
    jobs.scan_stream(documents, target, checkpoint)
    return _scored(spark.read.parquet(target))


@query("stream_user_counters", _COUNTERS_SQL)
def stream_user_counters(spark, folder):
    read_table(spark, folder, "events")
    target, checkpoint = jobs._folders(spark, "stream-counters")
    jobs.counter_stream(fx.history_of(_stream_of(spark, folder, "events")), target, checkpoint)
    return _flat_formats(jobs.latest_counters(spark, target))


@query("stream_daily_trend", f"""
SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (verdict = 'BLOCKED') AS blocked,
  count(*) FILTER (verdict = 'ALLOWED') AS allowed FROM {RECORDS} GROUP BY user_id, CAST(created_at AS DATE)""")
def stream_daily_trend(spark, folder):
    read_table(spark, folder, "events")
    target, checkpoint = jobs._folders(spark, "stream-trend")
    jobs.daily_trend_stream(fx.history_of(_stream_of(spark, folder, "events")), target, checkpoint)
    return jobs.latest_trend(spark, target)


@query("stream_badges", f"{_SCAN_BADGES_SQL} UNION ALL {_SLATE_SQL}")
def stream_badges(spark, folder):
    read_table(spark, folder, "events")
    target, checkpoint = jobs._folders(spark, "stream-badges")
    jobs.badge_stream(fx.history_of(_stream_of(spark, folder, "events")), target, checkpoint, MILESTONES)
    return spark.read.parquet(target).drop("batch")
