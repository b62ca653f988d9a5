"""Streams give what the batch operators give, over several micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from glyphwarden import rules
from glyphwarden.operators import badges
from glyphwarden.session import fresh_folder
from glyphwarden.streaming import jobs
from glyphwarden.streaming.keyed_log import KeyedLog
from test_history import SCHEMA, expected_badges, make_records


def _files(spark, rows, n, name):
    """The rows as n parquet files, in time order."""
    path = fresh_folder(spark, name)
    rows = sorted(rows, key=lambda r: (r[6], r[0]))
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def _add_files(spark, path, rows, n):
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("name", ["records.parquet", "*.parquet"])
def test_a_table_of_several_files_is_streamed(spark, name):
    rows = make_records(120, seed=3, hot_share=0.4)
    folder = fresh_folder(spark, "tables")
    for i in range(3):  # a folder named like a file, as Spark writes tables
        spark.createDataFrame(rows[i * 40:(i + 1) * 40], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/records.parquet")
    target, checkpoint = fresh_folder(spark, "out"), fresh_folder(spark, "cp")
    jobs.counter_stream(jobs.read_stream(spark, folder, name, max_files=1), target, checkpoint)
    got = {r.user_id: r.scan_count for r in jobs.latest_counters(spark, target).collect()}
    expected = {}
    for row in rows:
        expected[row[1]] = expected.get(row[1], 0) + 1
    assert got == expected


@pytest.mark.parametrize("seed, hot_share", [(5, 0.4), (8, 0.9)])
def test_badges_over_micro_batches_and_a_restart(spark, seed, hot_share):
    rows = sorted(make_records(900, seed=seed, hot_share=hot_share), key=lambda r: (r[6], r[0]))
    path = fresh_folder(spark, "stream-in")
    target, checkpoint = fresh_folder(spark, "out"), fresh_folder(spark, "cp")
    for part in (rows[:400], rows[400:]):  # the second run goes on from the checkpoint
        _add_files(spark, path, part, 3)
        stream = jobs.read_stream(spark, path, "*.parquet", max_files=1)
        jobs.badge_stream(stream, target, checkpoint)
    assert spark.read.parquet(target).select("batch").distinct().count() >= 5
    got = spark.read.parquet(target).collect()
    expected = expected_badges(rows, rules.SCAN_MILESTONES)
    assert {b for _, b in expected} >= {"clean_slate", "threat_hunter", "eagle_eye", "format_explorer", "first_scan"}
    assert {(r.user_id, r.badge_key): r.earned_at for r in got} == expected
    assert len(got) == len(expected)


def test_scans_without_user_or_fields_earn_nothing(spark):
    path = fresh_folder(spark, "stream-in")
    moment = dt.datetime(2024, 1, 1)
    rows = [(1, None, "f", "txt", "ALLOWED", 0, moment, []), (2, 5, "f", None, None, None, moment, None), (3, 5, "f", "", "ALLOWED", 0, moment, [])]
    _add_files(spark, path, rows, 1)
    target, checkpoint = fresh_folder(spark, "out"), fresh_folder(spark, "cp")
    jobs.badge_stream(jobs.read_stream(spark, path, "*.parquet"), target, checkpoint)
    assert {(r.user_id, r.badge_key) for r in spark.read.parquet(target).collect()} == {(5, "first_scan")}


def test_counters_over_micro_batches(spark):
    rows = make_records(500, seed=6)
    path = _files(spark, rows, 3, "stream-in")
    target, checkpoint = fresh_folder(spark, "out"), fresh_folder(spark, "cp")
    jobs.counter_stream(jobs.read_stream(spark, path, "*.parquet", max_files=1), target, checkpoint)
    batch = badges.user_counters(spark.read.parquet(path)).collect()
    assert sorted(jobs.latest_counters(spark, target).select(*batch[0].asDict()).collect()) == sorted(batch)


def test_counters_read_a_bounded_number_of_folders(spark):
    rows = make_records(260, seed=9)
    path = _files(spark, rows, 26, "stream-in")
    target, checkpoint = fresh_folder(spark, "out"), fresh_folder(spark, "cp")
    jobs.counter_stream(jobs.read_stream(spark, path, "*.parquet", max_files=1), target, checkpoint, compact_every=4)
    log = jobs.counter_log(spark, target, 4)
    assert [order for order, _ in log.parts()] == [23, 24, 25]
    batch = badges.user_counters(spark.read.parquet(path)).collect()
    assert sorted(jobs.latest_counters(spark, target).select(*batch[0].asDict()).collect()) == sorted(batch)


def test_keyed_log_can_be_repeated(spark):
    log = KeyedLog(spark, fresh_folder(spark, "log"), ["k"], compact_every=2)
    assert log.latest() is None

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "k long, v string")

    def now():
        return {r.k: r.v for r in log.latest().collect()}

    log.write(rows((1, "a"), (2, "a")), 0)
    log.write(rows((2, "b")), 1)
    assert now() == {1: "a", 2: "b"} and len(log.parts()) == 1
    log.write(rows((2, "b")), 1)  # the batch is run again after its snapshot
    assert now() == {1: "a", 2: "b"} and len(log.parts()) == 1
    log.write(rows((3, "c")), 2)
    log.write(rows((3, "d")), 2)  # and another before it
    assert now() == {1: "a", 2: "b", 3: "d"}
    rows((1, "half")).write.parquet(f"{log.path}/snapshot=3")
    log._delete("snapshot=3/_SUCCESS")  # a writer that did not end
    assert now() == {1: "a", 2: "b", 3: "d"}
    log.write(rows((1, "e")), 3)
    assert now() == {1: "e", 2: "b", 3: "d"} and [o for o, _ in log.parts()] == [3]


def test_daily_trend_has_open_days(spark):
    rows = make_records(500, seed=7)
    path = _files(spark, rows, 4, "stream-in")
    target, checkpoint = fresh_folder(spark, "out"), fresh_folder(spark, "cp")
    jobs.daily_trend_stream(jobs.read_stream(spark, path, "*.parquet", max_files=1), target, checkpoint, compact_every=3)
    expected = spark.createDataFrame(rows, SCHEMA).groupBy("user_id", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict") == "BLOCKED").alias("blocked"),
        F.count_if(F.col("verdict") == "ALLOWED").alias("allowed"))
    got = jobs.latest_trend(spark, target).select(*expected.columns)
    assert sorted(got.collect()) == sorted(expected.collect())
    assert got.agg(F.max("day")).first()[0] == max(r[6] for r in rows).date()
