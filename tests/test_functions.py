from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweft.functions import text as tx
from logweft.functions import times
from logweft.operators import filters


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "level"), [("wrn", "WARN"), ("Information", "INFO"), ("cri", "FATAL"), ("SRV", "SRV"), ("  ", None), ("vrb", "TRACE")])
def test_levels(spark, raw, level):
    assert one(spark, tx.normal_level(F.col("v")), v=raw) == level


@pytest.mark.parametrize(("path", "source"), [("/l/app-2024-01-02.log", "app"), ("/l/app_20240102101112.log", "app"), ("/l/20240102.log", "20240102.log"), ("a.zip!/in/web.txt", "web"), ("plain", "plain")])
def test_logical_source(spark, path, source):
    assert one(spark, tx.logical_source(F.col("v")), v=path) == source


@pytest.mark.parametrize(
    ("stamp", "zone", "utc", "basis", "offset"),
    [
        ("2024-03-15T10:00:00Z", "UTC", datetime(2024, 3, 15, 10), "Utc", 0),
        ("2024-03-15 10:00:00,250", "UTC", datetime(2024, 3, 15, 10, 0, 0, 250000), "Utc", 0),
        ("2024-03-15 10:00:00.1234567+02:00", "UTC", datetime(2024, 3, 15, 8, 0, 0, 123456), "FixedOffset", 120),
        ("2024-07-15 10:00:00", "Europe/Rome", datetime(2024, 7, 15, 8), "Zone", 120),
        ("2024-11-03 01:30:00", "America/New_York", datetime(2024, 11, 3, 6, 30), "Zone", -300),
        ("2024-03-10 02:30:00", "America/New_York", datetime(2024, 3, 10, 7, 30), "Zone", -300),
        ("15/Mar/2024:10:00:00 -0130", "UTC", datetime(2024, 3, 15, 11, 30), "FixedOffset", -90),
        ("Mar  5 10:00:00", "UTC", datetime(2024, 3, 5, 10), "Utc", 0),
        ("1700000000", "Europe/Rome", datetime(2023, 11, 14, 22, 13, 20), "Utc", 0),
        ("1700000000123", "UTC", datetime(2023, 11, 14, 22, 13, 20, 123000), "Utc", 0),
        ("49-03-15 10:00:00", "UTC", datetime(2049, 3, 15, 10), "Utc", 0),
        ("50/03/15 10:00:00", "UTC", datetime(1950, 3, 15, 10), "Utc", 0),
        ("13/02/2024 10:00:00", "UTC", datetime(2024, 2, 13, 10), "Utc", 0),
        ("no time", "UTC", None, "Utc", None),
        (None, "UTC", None, "Utc", None),
    ],
)
def test_timestamps(spark, stamp, zone, utc, basis, offset):
    row = times.with_utc(spark.createDataFrame([(stamp,)], "s string"), "s", zone).first()
    assert (row.utc, row.offset_minutes) == (utc, offset) and (utc is None or row.basis == basis)


@pytest.mark.parametrize(("span", "coarse", "fine"), [(60, 10, 1), (600, 10, 5), (3600, 60, 30), (86400, 1800, 300), (7 * 86400, 3600, 3600), (40 * 86400, 86400, 86400)])
def test_bin_widths(span, coarse, fine):
    assert times.bin_seconds(timedelta(seconds=span)) == coarse and times.bin_seconds(timedelta(seconds=span), fine=True) == fine


def test_durations():
    assert times.duration("1h30m") == timedelta(minutes=90) and times.duration("2M1d") == timedelta(days=61) and times.duration("5ms") == timedelta(milliseconds=5)
    for bad in ("", "5", "h", "1H", "1h 2m"):
        with pytest.raises(ValueError):
            times.duration(bad)


def test_bucket_width(spark):
    with pytest.raises(ValueError):
        times.bucket(F.col("x"), 0)


def test_zoom():
    a, b = datetime(2024, 1, 1), datetime(2024, 1, 2)
    assert times.zoomed(datetime(2024, 1, 3), datetime(2023, 1, 1), a, b) == (a, b)
    assert times.zoomed(a, a, a, b) == (a, a + timedelta(seconds=2))


@pytest.mark.parametrize(("cell", "out"), [("a", "a"), ("a,b", '"a,b"'), ('a"b', '"a""b"'), ("a\nb", '"a\nb"'), (None, "")])
def test_csv_cell(spark, cell, out):
    assert spark.createDataFrame([(cell,)], "v string").select(tx.csv_cell(F.col("v")).alias("x")).first().x == out


@pytest.mark.parametrize(("text", "hit"), [("50%_ERR", True), ("50xyerr", False)])
def test_escaped_search(spark, text, hit):
    assert one(spark, tx.contains_text(F.col("v"), "50%_err"), v=text) is hit


def test_facet_cycle():
    flt = filters.LogFilter(levels=("A",), not_levels=("B",))
    flt = filters.cycled(flt, "levels", "C")
    assert flt.levels == ("A", "C") and flt.not_levels == ()
    flt = filters.cycled(flt, "levels", "C")
    assert flt.levels == () and flt.not_levels == ("C",)
    assert filters.cycled(flt, "levels", "C").not_levels == ()


def test_folder_name(spark):
    assert one(spark, tx.folder_name(F.col("t"), F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05"))), t=' a/b: c*"d" ') == "20240102_030405_a_b_c_d_"
