"""What can be told of a written log without its rows: footers, segments by time, and a cube of counts by hour.

A table that ``write_segments`` made has a folder for each segment. Counts and the first and last moment of segments come from the
Parquet footers alone (``footers``); they choose the segments that a time window or a page reads (``in_window``, ``first_page``).
``cube`` counts rows by segment, hour, source and level. It is kept by segment like the log itself, and answers counts for any
window: whole hours from the cube, the two hours at its edges from the rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweft.functions.times import moment
from logweft.operators.filters import LogFilter
from logweft.operators.upkeep import GONE, MICROS, replaced
from logweft.operators.views import PAGE, page
from logweft.schema import COLUMNS
from logweft.sources.shared import written

#: Segments that become part of a condition on the partition; more are joined, which Spark turns into a filter of partitions at run time.
INLINE_SEGMENTS = 1000
CUBE = ["segment_id", "hour_utc", "logical_source_id", "level"]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The log rows of a written table."""
    return spark.read.parquet(path).where("timestamp_utc is not null").select(*COLUMNS)


def footer_plan(spark: SparkSession, path: str) -> DataFrame:
    """The aggregate that the Parquet reader answers from footers, in a session of its own with the reader that can."""
    side = spark.newSession()
    side.conf.set("spark.sql.sources.useV1SourceList", "")
    side.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    micros = [F.min(MICROS).alias("min_us"), F.max(MICROS).alias("max_us")]
    return side.read.parquet(path).groupBy("segment_id").agg(F.count("*").alias("row_count"), *micros)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, min_ts_utc, max_ts_utc and row_count of a written table: a row for each segment, no rows read."""
    found = footer_plan(spark, path)
    folder = written(found, "footers")  # made by the other session, read by this one
    rows = spark.read.schema(found.schema).parquet(*folder.inputFiles()) if folder.inputFiles() else spark.createDataFrame([], found.schema)
    at = lambda c: (F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(secs=(F.col(c).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))).cast("timestamp_ntz")
    return rows.where(F.col("min_us") != GONE).select("segment_id", at("min_us").alias("min_ts_utc"), at("max_us").alias("max_ts_utc"), "row_count")


def only(logs: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of some segments; the folders of others aren't read."""
    few = [r.segment_id for r in segments.select("segment_id").limit(INLINE_SEGMENTS + 1).collect()]
    if len(few) <= INLINE_SEGMENTS:
        return logs.where(F.col("segment_id").isin(few)) if few else logs.where("false")
    return logs.join(F.broadcast(segments.select("segment_id")), "segment_id", "left_semi").select(*logs.columns)


def in_window(logs: DataFrame, zones: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The rows of [start, end), of segments that have a moment in it. ``zones``: ``footers``, or a segment table."""
    some, flt = zones, LogFilter(start, end)
    if start is not None:
        some = some.where(F.col("max_ts_utc") >= moment(start))
    if end is not None:
        some = some.where(F.col("min_ts_utc") < moment(end))
    return only(logs, some).where(flt.column())


def first_page(logs: DataFrame, zones: DataFrame, size: int = PAGE, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The first page of a window in key order, from as few segments as can hold it. Segments that lie wholly within the window
    and end by a moment hold their rows by then for certain; once these are ``size`` rows, segments that begin after it have none
    of the page's."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("min_ts_utc") >= moment(start))
    if end is not None:
        inside = inside & (F.col("max_ts_utc") < moment(end))
    sure = F.sum(F.when(inside, F.col("row_count")).otherwise(0)).over(Window.orderBy("max_ts_utc").rangeBetween(Window.unboundedPreceding, 0))  # a row a segment
    reach = zones.select("max_ts_utc", sure.alias("held")).where(F.col("held") >= size).agg(F.min("max_ts_utc")).first()[0]
    some = zones if reach is None else zones.where(F.col("min_ts_utc") <= moment(reach))
    return page(in_window(logs, some, start, end), size=size)


def cube(logs: DataFrame) -> DataFrame:
    """Rows by segment, hour, source and level."""
    hour = F.date_trunc("hour", "timestamp_utc").cast("timestamp_ntz")
    return logs.groupBy("segment_id", hour.alias("hour_utc"), "logical_source_id", "level").agg(F.count("*").alias("row_count"))


def cube_after(cube_now: DataFrame, again: DataFrame, segments: DataFrame) -> DataFrame:
    """The cube after some segments (``segment_id``) were read again and gave the rows ``again``."""
    return replaced(cube_now, cube(again), "segment_id", keys=segments)


def window_counts(cube_now: DataFrame, logs: DataFrame, start: datetime, end: datetime, *by: str) -> DataFrame:
    """Counts of [start, end) by columns of the cube (segment_id, hour_utc, logical_source_id, level): whole hours from the cube, the rest
    from the rows of at most two hours."""
    hour = lambda t: t.replace(minute=0, second=0, microsecond=0)
    first = hour(start) if start == hour(start) else hour(start) + timedelta(hours=1)
    last = max(first, hour(end))
    whole = cube_now.where((F.col("hour_utc") >= moment(first)) & (F.col("hour_utc") < moment(last)))
    edges = [(start, min(first, end)), (last, end)] if first <= hour(end) else [(start, end)]
    rows = [cube(logs.where(LogFilter(a, b).column())) for a, b in edges if a < b]
    parts = whole.select(*CUBE, "row_count")
    for more in rows:
        parts = parts.unionByName(more)
    return parts.groupBy(*by).agg(F.sum("row_count").alias("row_count"))
