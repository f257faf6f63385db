"""Footers, segments by time, first pages, the cube of counts, and calendar sets."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweft.operators import intervals, segments, upkeep, views
from logweft.operators.filters import LogFilter
from logweft.schema import COLUMNS, logs_of_events

DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Events as segments of half a day, and a segment that was emptied."""
    rows = logs_of_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    hours = (F.hour("timestamp_utc") / 12).cast("int")
    rows = rows.withColumn("segment_id", F.concat(F.date_format("timestamp_utc", "yyyyMMdd"), F.lit("-"), hours)).select(*COLUMNS).cache()
    path = str(tmp_path_factory.mktemp("log") / "segments")
    extra = rows.limit(3).withColumn("segment_id", F.lit("gone"))
    upkeep.write_segments(rows.unionByName(extra), path)
    upkeep.write_segments(rows.limit(0), path, spark.sql("select 'gone' as segment_id"))
    return rows, path


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_footers_hold_counts_and_ends(spark, stored):
    rows, path = stored
    want = rows.groupBy("segment_id").agg(F.min("timestamp_utc"), F.max("timestamp_utc"), F.count("*"))
    assert plain(segments.footers(spark, path)) == plain(want)
    plan = segments.footer_plan(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(timestamp_us), MAX(timestamp_us)]" in plan and "PushedGroupBy: [segment_id]" in plan


def test_windows_read_the_segments_that_they_overlap(spark, stored):
    rows, path = stored
    zones, logs = segments.footers(spark, path), segments.read_segments(spark, path)
    lowest = zones.agg(F.min("min_ts_utc")).first()[0]
    for a, b in ((0, 1), (5, 30), (-100, -90), (11, 12), (0, 10_000)):
        start, end = lowest + timedelta(hours=a), lowest + timedelta(hours=b)
        got = segments.in_window(logs, zones, start, end)
        assert plain(got) == plain(rows.where(LogFilter(start, end).column()))
        near = {r.segment_id for r in zones.collect() if r.max_ts_utc >= start and r.min_ts_utc < end}
        assert {f.split("segment_id=")[1].split("/")[0] for f in read_files(got)} == near


def read_files(df) -> set[str]:
    """The files that the plan's scan lists after partitions are left out."""
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_many_segments_are_joined(spark, stored, monkeypatch):
    rows, path = stored
    monkeypatch.setattr(segments, "INLINE_SEGMENTS", 1)
    zones = segments.footers(spark, path)
    start = zones.agg(F.min("min_ts_utc")).first()[0] + timedelta(hours=20)
    assert plain(segments.in_window(segments.read_segments(spark, path), zones, start)) == plain(rows.where(LogFilter(start).column()))


def test_first_pages_stop_at_few_segments(spark, stored):
    rows, path = stored
    zones, logs = segments.footers(spark, path), segments.read_segments(spark, path)
    lowest = zones.agg(F.min("min_ts_utc")).first()[0]
    for size, start in ((5, None), (40, None), (40, lowest + timedelta(hours=7)), (10**6, None)):
        got = segments.first_page(logs, zones, size, start)
        assert got.collect() == views.page(rows, LogFilter(start), size=size).collect()
    assert zones.count() > 20


def test_cube_and_edges(spark, stored):
    rows, _ = stored
    counts = segments.cube(rows)
    lowest = rows.agg(F.min("timestamp_utc")).first()[0].replace(minute=0, second=0, microsecond=0)
    dice = random.Random(4)
    for _ in range(6):
        a, b = sorted(lowest + timedelta(minutes=dice.randrange(60 * 24 * 20)) for _ in range(2))
        for by in (("level",), ("logical_source_id", "hour_utc")):
            want = segments.cube(rows.where(LogFilter(a, b).column())).groupBy(*by).agg(F.sum("row_count").alias("row_count"))
            assert plain(segments.window_counts(counts, rows, a, b, *by)) == plain(want)
    for minutes in ((10, 20), (0, 60), (10, 60), (60, 60), (10, 80), (59, 121)):
        a, b = (lowest + timedelta(minutes=m) for m in minutes)
        want = rows.where(LogFilter(a, b).column()).groupBy("level").agg(F.count("*").alias("row_count"))
        assert plain(segments.window_counts(counts, rows, a, b, "level")) == plain(want)


def test_cube_after_segments_were_read_again(spark, stored):
    rows, _ = stored
    some = sorted(r[0] for r in rows.select("segment_id").distinct().collect())[:2]
    keys = spark.createDataFrame([(s,) for s in some], "segment_id string")
    again = rows.where(F.col("segment_id") == some[0]).limit(3)
    now = rows.where(~F.col("segment_id").isin(some)).unionByName(again)
    assert plain(segments.cube_after(segments.cube(rows), again, keys)) == plain(segments.cube(now))


SETS = "set_id int, years array<int>, months array<int>, days array<int>, times array<string>, zones array<string>, seconds long"


def test_calendar_sets(spark):
    sets = [
        (1, [2024], [1], [5, 10, 11, 12], None, None, None),
        (2, [2023, 2024], [2, 4], [29, 31, 31], [], ["UTC"], None),
        (3, [2026], [3], [5], ["09:00", "10:30:15"], ["Europe/Rome", None], 1800),
        (4, [2024], [3, 13], [31, 0], None, ["Europe/Berlin"], None),
        (5, [], [1], [1], None, None, None),
        (6, [2024], [10], [27], ["02:30"], ["Europe/Berlin"], 0),
    ]
    got = {}
    for r in intervals.occurrences(spark.createDataFrame(sets, SETS)).orderBy("start_utc", "end_utc").collect():
        got.setdefault(r.set_id, []).append((str(r.start_utc), str(r.end_utc)))
    day = lambda a, b: (f"{a} 00:00:00", f"{b} 00:00:00")
    assert got == {
        1: [day("2024-01-05", "2024-01-06"), day("2024-01-10", "2024-01-11"), day("2024-01-11", "2024-01-12"), day("2024-01-12", "2024-01-13")],
        2: [day("2023-04-29", "2023-04-30"), day("2024-02-29", "2024-03-01"), day("2024-04-29", "2024-04-30")],
        3: [("2026-03-05 08:00:00", "2026-03-05 08:30:00"), ("2026-03-05 09:00:00", "2026-03-05 09:30:00"), ("2026-03-05 09:30:15", "2026-03-05 10:00:15"), ("2026-03-05 10:30:15", "2026-03-05 11:00:15")],
        4: [("2024-03-30 23:00:00", "2024-03-31 22:00:00")],
        6: [("2024-10-27 01:30:00", "2024-10-27 01:30:00")],
    }


def test_spans_from_the_data(spark, stored):
    rows, _ = stored
    low, high = rows.agg(F.min("timestamp_utc"), F.max("timestamp_utc")).first()
    (got,) = intervals.span(rows, "first", "latest").collect()
    assert (got.start_utc, got.end_utc) == (low, high + timedelta(microseconds=1))
    assert intervals.within(rows, intervals.span(rows, "first", "latest"), "timestamp_utc").count() == rows.count()
    (got,) = intervals.span(rows, DAY, "latest").collect()
    assert got.start_utc == DAY
    assert intervals.span(rows.limit(0), "first", "latest").collect() == []
