"""Half-open time intervals as tables: built from calendars, merged, and joined with rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweft.functions.times import DAY, moment, zone_to_utc
from logweft.sources.shared import written

#: Intervals up to so many become one condition that the Parquet reader sees; their number is counted first.
INLINE = 64
#: Merged intervals that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000


def daily(spark: SparkSession, first: str, last: str, time: str = "00:00:00", length: timedelta = timedelta(days=1), zone: str = "UTC", weekdays: tuple[int, ...] = ()) -> DataFrame:
    """(start_utc, end_utc): every day from first to last, from a local time on, for a length; ``weekdays`` (1 Monday to 7
    Sunday) picks some. Whole days end at the zone's next midnight, also where clocks change."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    if weekdays:
        days = days.where(((F.weekday("day") + 1)).isin(*weekdays))
    local = F.to_timestamp_ntz(F.concat(F.col("day").cast("string"), F.lit(f" {time}")))
    seconds = length.total_seconds()
    start = zone_to_utc(local, zone)
    whole = seconds % DAY == 0
    end = zone_to_utc(local + F.make_dt_interval(days=F.lit(int(seconds // DAY))), zone) if whole else start + F.make_dt_interval(secs=F.lit(seconds))
    return days.select(start.alias("start_utc"), end.alias("end_utc"))


def occurrences(sets: DataFrame) -> DataFrame:
    """(set_id, start_utc, end_utc) of calendar sets, a row a set: arrays ``years``, ``months``, ``days`` and ``zones``, ``times`` (local, null or empty for
    whole days) and ``seconds``. Each combination is an interval of ``seconds`` from its local time on, or to the zone's next midnight
    for whole days. Days that a month doesn't have are left out; missing zones are UTC. Equal intervals of a set come once."""
    first = F.make_date("year", "month", F.lit(1))
    each = sets.select("set_id", "times", "zones", "seconds", F.explode(F.array_distinct("years")).alias("year"), "months", "days")
    each = each.select("*", F.explode(F.array_distinct("months")).alias("month")).where("month between 1 and 12")
    each = each.select("*", F.explode(F.array_distinct("days")).alias("d")).where((F.col("d") >= 1) & (F.col("d") <= F.day(F.last_day(first))))
    each = each.withColumns({"time": F.explode_outer("times")}).withColumns({"zone": F.explode_outer("zones")})
    day = F.date_add(F.make_date("year", "month", F.lit(1)), F.col("d") - 1)
    local = lambda d, time: F.to_timestamp_ntz(F.concat(d.cast("string"), F.lit(" "), time))
    zone, midnight = F.coalesce("zone", F.lit("UTC")), F.lit("00:00:00")
    full = F.when(F.length("time") == 5, F.concat("time", F.lit(":00"))).otherwise(F.col("time"))
    start = zone_to_utc(local(day, F.coalesce(full, midnight)), zone)
    end = F.when(F.col("time").isNull(), zone_to_utc(local(F.date_add(day, 1), midnight), zone)).otherwise(start + F.make_dt_interval(secs=F.coalesce("seconds", F.lit(0))))
    return each.select("set_id", start.alias("start_utc"), end.alias("end_utc")).distinct()


def span(rows: DataFrame, start: datetime | str, end: datetime | str, ts: str = "timestamp_utc") -> DataFrame:
    """(start_utc, end_utc) from a moment, or the ``first`` row's, to a moment, or the ``latest`` row's, which is inside; no row without rows."""
    low = F.min(ts) if start == "first" else F.max(ts) if start == "latest" else moment(start)
    high = F.min(ts) if end == "first" else F.max(ts) if end == "latest" else moment(end)
    if end in ("first", "latest"):
        high = high + F.expr("interval 1 microsecond")
    return rows.agg(F.max(ts).alias("_any"), low.alias("start_utc"), high.alias("end_utc")).where("_any is not null").drop("_any")


def merged(intervals: DataFrame) -> DataFrame:
    """Intervals that overlap or touch as one; those without a moment are left out. Ends and counts are carried within
    hours, and from hour to hour by a table of one row an hour, so no task holds all intervals."""
    some = intervals.where("start_utc < end_utc").select("start_utc", "end_utc", F.date_trunc("hour", "start_utc").alias("day"))
    order = Window.partitionBy("day").orderBy("start_utc", "end_utc")
    days_before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    ends = some.groupBy("day").agg(F.max("end_utc").alias("e")).select("day", F.max("e").over(days_before).alias("carried"))
    reach = F.greatest("carried", F.max("end_utc").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = some.join(ends, "day").withColumn("reach", reach).withColumn("new", F.when(F.col("start_utc") <= F.col("reach"), 0).otherwise(1))
    bases = marked.groupBy("day").agg(F.sum("new").alias("n")).select("day", F.coalesce(F.sum("n").over(days_before), F.lit(0)).alias("base"))
    island = F.col("base") + F.sum("new").over(order)
    return marked.join(bases, "day").withColumn("island", island).groupBy("island").agg(F.min("start_utc").alias("start_utc"), F.max("end_utc").alias("end_utc")).drop("island")


def within(rows: DataFrame, intervals: DataFrame, ts: str) -> DataFrame:
    """Rows whose time lies in any interval. A few intervals become a condition; many are merged, counted, and joined by the
    hours that they touch (long ones by days), as a broadcast if they are few enough. The first and last moment reach the
    reader."""
    few = intervals.where("start_utc < end_utc").limit(INLINE + 1).collect()
    if not few:
        return rows.where(F.lit(False))
    if len(few) <= INLINE:
        low, high = min(r.start_utc for r in few), max(r.end_utc for r in few)
        any_of = F.lit(False)
        for r in few:
            any_of = any_of | ((F.col(ts) >= moment(r.start_utc)) & (F.col(ts) < moment(r.end_utc)))
        return rows.where((F.col(ts) >= moment(low)) & (F.col(ts) < moment(high)) & any_of)
    whole = written(merged(intervals), "intervals")
    told = whole.agg(F.count("*").alias("n"), F.min("start_utc").alias("low"), F.max("end_utc").alias("high")).first()
    last = F.col("end_utc") - F.expr("interval 1 microsecond")
    hour = lambda t: F.date_trunc("hour", t).cast("timestamp_ntz")
    # an interval is a row for each hour that it touches, or for each day if it is long
    slices = F.when(F.timestamp_diff("HOUR", F.col("start_utc"), last) < 48, F.transform(F.sequence(hour("start_utc"), hour(last), F.expr("interval 1 hour")), lambda x: F.struct(F.lit("h").alias("kind"), x.alias("at"))))
    slices = slices.otherwise(F.transform(F.sequence(F.date_trunc("day", "start_utc").cast("timestamp_ntz"), F.date_trunc("day", last).cast("timestamp_ntz"), F.expr("interval 1 day")), lambda x: F.struct(F.lit("d").alias("kind"), x.alias("at"))))
    cut = whole.select("start_utc", "end_utc", F.explode(slices).alias("s")).select("start_utc", "end_utc", F.col("s.kind").alias("slice_kind"), F.col("s.at").alias("slice_at"))
    cut = F.broadcast(cut) if told.n <= BROADCAST and told.high - told.low < timedelta(days=366 * 100) else cut
    t = F.col(ts)
    near = rows.where((t >= moment(told.low)) & (t < moment(told.high)))
    inside = (t >= F.col("start_utc")) & (t < F.col("end_utc"))
    keyed = cut.where("slice_kind = 'h'"), cut.where("slice_kind = 'd'")
    # merged intervals don't overlap, so a row lies in one at most, and in one slice of it
    by_hour = near.join(keyed[0].drop("slice_kind"), (hour(t) == F.col("slice_at")) & inside, "left_semi")
    if not keyed[1].limit(1).count():
        return by_hour
    return by_hour.unionByName(near.join(keyed[1].drop("slice_kind"), (F.date_trunc("day", t).cast("timestamp_ntz") == F.col("slice_at")) & inside, "left_semi"))
