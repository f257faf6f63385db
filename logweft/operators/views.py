"""What a browser of logs asks: pages, timelines, facets, ranges, the audit of skips, and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.functions.text import contains_pattern
from logweft.functions.times import bucket, zoned
from logweft.operators.filters import NONE, LogFilter, beyond
from logweft.schema import COLUMNS, KEY

PAGE = 2000


def page(logs: DataFrame, flt: LogFilter = LogFilter(), cursor: Sequence | None = None, forward: bool = True, size: int = PAGE) -> DataFrame:
    """A page in key order: the first rows after a cursor (timestamp, segment, record), or the last before it. A top-k, not a sort."""
    rows = logs.where(flt.column())
    if cursor is not None:
        rows = rows.where(beyond(*cursor, forward=forward))
    order = [F.col(c).asc() if forward else F.col(c).desc() for c in KEY]
    got = rows.select(*COLUMNS).orderBy(*order).limit(size)
    return got if forward else got.orderBy(*KEY)


def timeline(logs: DataFrame, seconds: int, flt: LogFilter = LogFilter()) -> DataFrame:
    """Counts by time bucket, with the level that occurs most (of equals the first by name); empty buckets are left out.
    Levels are counted before they meet, so a bucket's rows are one a level."""
    rows = logs.where(flt.column()).groupBy(bucket(F.col("timestamp_utc"), seconds).alias("bin_start"), "level").count()
    best = F.min(F.when(F.col("level").isNotNull(), F.struct((-F.col("count")).alias("n"), "level")))["level"]
    return rows.groupBy("bin_start").agg(F.sum("count").alias("row_count"), best.alias("dominant_level")).select("bin_start", (F.col("bin_start") + F.make_dt_interval(secs=F.lit(seconds))).alias("bin_end"), "row_count", "dominant_level").orderBy("bin_start")


def facet(logs: DataFrame, column: str, flt: LogFilter = LogFilter()) -> DataFrame:
    """Values and their counts, most first; a missing value shows as ``(none)``."""
    return logs.where(flt.column()).groupBy(F.coalesce(column, F.lit(NONE)).alias("value")).agg(F.count("*").alias("row_count")).orderBy(F.desc("row_count"), "value")


def time_range(logs: DataFrame, flt: LogFilter = LogFilter()) -> DataFrame:
    return logs.where(flt.column()).agg(F.min("timestamp_utc").alias("first_utc"), F.max("timestamp_utc").alias("last_utc"))


def count(logs: DataFrame, flt: LogFilter = LogFilter()) -> DataFrame:
    return logs.where(flt.column()).agg(F.count("*").alias("row_count"))


def displayed(logs: DataFrame, zone: str, *columns: str) -> DataFrame:
    """Rows with their time as text in a zone."""
    return logs.select(*columns, zoned(F.col("timestamp_utc"), zone).alias("shown_time"))


def skip_audit(skips: DataFrame, reason: str | None = None, source: str | None = None) -> DataFrame:
    """Skipped regions by source, reason and segment, with the sample of the first."""
    rows = skips if reason is None else skips.where(F.col("reason_code") == reason)
    rows = rows if source is None else rows.where(F.col("logical_source_id") == source)
    return rows.groupBy("logical_source_id", "reason_code", "segment_id").agg(
        F.min("start_offset").alias("first_offset"), F.max("end_offset").alias("last_offset"), F.count("*").alias("skip_count"), F.min_by(F.col("sample_prefix").cast("string"), "segment_seq").alias("sample")
    ).orderBy("logical_source_id", "reason_code", "segment_id")


def skip_totals(skips: DataFrame) -> DataFrame:
    """Skips of each source, its reasons and segments as one list (a row for each is counted before)."""
    by = skip_audit(skips)
    return by.groupBy("logical_source_id").agg(F.sum("skip_count").alias("skip_count"), F.count_distinct("reason_code").alias("reason_count"), F.count("*").alias("group_count"))


def skip_count(skips: DataFrame) -> DataFrame:
    """Skips of all sources in one row."""
    return skips.agg(F.count("*").alias("skip_count"))


def distinct_values(logs: DataFrame, column: str, flt: LogFilter = LogFilter()) -> DataFrame:
    """The values of a column, missing ones left out, in order."""
    return logs.where(flt.column() & F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def segment_statistics(logs: DataFrame) -> DataFrame:
    return logs.groupBy("segment_id").agg(F.min("timestamp_utc").alias("min_ts_utc"), F.max("timestamp_utc").alias("max_ts_utc"), F.count("*").alias("row_count"))


def recent(history: DataFrame, when: str = "executed_utc", size: int = 50, search: str | None = None, *more: Column) -> DataFrame:
    """The latest entries, those whose text holds the searched words if some are."""
    rows = history if not search else history.where(contains_pattern(F.col("query_text"), search))
    return rows.orderBy(F.desc(when), *more).limit(size)
