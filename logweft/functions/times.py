"""Time functions: bin widths, buckets, zones, durations, and timestamps in logs."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Widest range of a session or window, in seconds, and the width of its bins.
COARSE = ((600, 10), (3600, 60), (6 * 3600, 300), (86400, 1800), (7 * 86400, 3600), (30 * 86400, 6 * 3600))
FINE = ((120, 1), (600, 5), (3600, 30), (6 * 3600, 60), (86400, 300))
DAY = 86400
#: Buckets begin at this Monday, so that those of several days agree with SQL engines that count from it.
ORIGIN = 946857600


def moment(at: datetime) -> Column:
    """A time without zone as a constant that the Parquet reader can use."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def bin_seconds(span: timedelta, fine: bool = False) -> int:
    """The width of timeline bins for a span of time."""
    for most, width in FINE if fine else COARSE:
        if span.total_seconds() <= most:
            return width
    return bin_seconds(span) if fine else DAY


def bucket(ts: Column, seconds: int) -> Column:
    """The start of the bucket of so many seconds that a timestamp without zone falls in."""
    if seconds < 1:
        raise ValueError("a bucket has at least one second")
    return F.window(ts, f"{seconds} seconds", startTime=f"{ORIGIN % seconds} seconds")["start"]


def zoned(ts: Column, zone: str) -> Column:
    """A UTC timestamp as text in a zone, with milliseconds and the zone's offset at that time."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    minutes = F.timestamp_diff("MINUTE", ts, local)
    sign = F.when(minutes < 0, "-").otherwise("+")
    hours = F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0")
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), sign, hours, F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))


def zone_to_utc(local: Column, zone: Column | str) -> Column:
    """Local time in a zone as UTC. A time that comes twice counts as its second one, with the smaller offset, however large
    the change; a time that is left out is shifted by the change."""
    zone = F.lit(zone) if isinstance(zone, str) else zone
    there = lambda t: F.convert_timezone(F.lit("UTC"), zone, t)
    first = F.convert_timezone(zone, F.lit("UTC"), local)
    soon = first + F.expr("interval 3 hours")  # no change of clocks takes longer
    later = local - (there(soon) - soon)
    return F.when((later > first) & (there(later) == local), later).otherwise(first)


# Field names that hold a record's time, first ones first.
TIME_FIELDS = ("@timestamp", "timestamp", "@t", "time", "datetime", "date", "ts", "Timestamp", "Time", "DateTime", "Date", "TIMESTAMP", "TIME", "DATETIME", "DATE", "event_time", "EventTime", "log_time", "LogTime", "created_at", "CreatedAt")

# The shapes of timestamps that open a record, in order of preference.
SHAPES = {
    "ISO-8601": r"^(?<ts>\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[\.,]?\d{0,7}(?:Z|[+-]\d{2}:?\d{2})?)",
    "YMD-Fractional": r"^(?<ts>\d{4}[-/]\d{2}[-/]\d{2}\s+\d{2}:\d{2}:\d{2}[\.,]\d{1,7})",
    "Syslog": r"^(?<ts>[A-Z][a-z]{2}\s{1,2}\d{1,2}\s+\d{2}:\d{2}:\d{2})",
    "Apache-CLF": r"^\[(?<ts>\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s[+-]\d{4})\]",
    "Epoch-Seconds": r"^(?<ts>\d{10})(?:\s|,|;)",
    "Epoch-Millis": r"^(?<ts>\d{13})(?:\s|,|;)",
}
# Fixed value: a second timestamp within a line.
ALTERNATE = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[\.,]\d{1,7})?(?:Z|[+-]\d{2}:?\d{2})?"


def by_shape(shape: Column | None, of: Callable[[str], Column]) -> Column:
    """``of`` the pattern that ``shape`` names; without a shape, of the first whose result isn't null."""
    if shape is None:
        return F.coalesce(*[of(p) for p in SHAPES.values()])
    return reduce(lambda c, kv: c.when(shape == kv[0], of(kv[1])), SHAPES.items(), F.when(F.lit(False), F.lit(None).cast("string")))


def starts_record(line: Column) -> Column:
    """Whether a line begins with a timestamp of a known shape."""
    return line.rlike("|".join(f"(?:{shape.replace('?<ts>', '?:')})" for shape in SHAPES.values()))


def stamp_text(line: Column, shape: Column | None = None) -> Column:
    """The text of the timestamp that a line begins with; null without one."""
    return by_shape(shape, lambda p: F.nullif(F.regexp_extract(line, p, 1), F.lit("")))


def after_stamp_text(line: Column, shape: Column | None = None) -> Column:
    """What follows the timestamp (and the mark that its shape takes with it)."""
    return by_shape(shape, lambda p: F.when(line.rlike(p), F.regexp_replace(line, p, "")))


def alternate_text(line: Column, stamp: Column) -> Column:
    """The first other timestamp in the line that can be read; null without one."""
    others = F.filter(F.regexp_extract_all(line, F.lit(ALTERNATE), F.lit(0)), lambda x: (x != F.trim(stamp)) & F.replace(F.substring(x, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz").isNotNull())
    return F.try_element_at(others, F.lit(1))


def is_explicit(stamp: Column) -> Column:
    """Whether a timestamp's text names an offset or counts from 1970."""
    return F.trim(stamp).rlike(r":\d{2}(?:[.,]\d*)?\s*(?:Z|[+-]\d{2}:?\d{2})$|^\d{10}(?:\.\d+)?$|^\d{13}$")


def preferred(stamp: Column, other: Column) -> tuple[Column, Column]:
    """Of two timestamps of a record the one that counts, and the text that is kept beside it: one with an offset before a
    bare one, of two with an offset the more precise, else the first."""
    digits = lambda t: F.length(F.regexp_extract(t, r"[\.,](\d+)", 1)) + F.when(t.rlike(r"[Zz]|[+-]\d{2}:?\d{2}$"), 100).otherwise(0)
    second = other.isNotNull() & is_explicit(other) & (~is_explicit(stamp) | (digits(other) > digits(stamp)))
    return F.when(second, other).otherwise(stamp), F.when(second, stamp).otherwise(F.coalesce(other, stamp))


# Formats of timestamps besides ISO 8601, after slashes became hyphens; those with years of two digits are
# yy-MM-dd, and with slashes also MM/dd/yy and dd/MM/yy.
FORMATS = ("MM-dd-yyyy HH:mm:ss[.SSS]", "dd-MM-yyyy HH:mm:ss[.SSS]", "yyyy-MM-dd", "MM-dd-yyyy", "dd-MM-yyyy")


def basis_of(zone: str) -> str:
    """What a bare time's zone is: UTC, the session's own (``local``), a fixed offset (``+02:00``), or a named zone."""
    return "Utc" if zone == "UTC" else "Local" if zone == "local" else "FixedOffset" if re.fullmatch(r"[+-]\d{2}:\d{2}", zone) else "Zone"


def with_utc(rows: DataFrame, stamp: str, zone: str = "UTC", year: int = 2024) -> DataFrame:
    """Adds ``utc``, ``basis`` and ``offset_minutes`` for a timestamp's text. A text that names an offset, or counts from 1970,
    is explicit; else the time is local in ``zone`` (see ``basis_of``). Years of two digits: 00 to 49 are after 2000. Syslog
    lines get ``year``. Text that can't be read gives null. Steps are columns of their own, so that none is computed twice."""
    kind_of_zone = basis_of(zone)
    zone = rows.sparkSession.conf.get("spark.sql.session.timeZone") if zone == "local" else zone
    number = lambda c: F.col(c).try_cast("int")
    one = rows.withColumn("_t", F.trim(F.col(stamp)))
    one = one.withColumn("_raw", F.when(F.col("_t").rlike(r"[\t\n\x0B\f\r]|  "), F.regexp_replace("_t", r"\s+", " ")).otherwise(F.col("_t")))
    # patterns are tried only where they may fit, as they take most of the time
    dots = F.when(F.contains("_raw", F.lit(",")), F.regexp_replace("_raw", r"(?<=:\d\d),(?=\d)", ".")).otherwise(F.col("_raw"))
    one = one.withColumn("_s", F.replace(dots, F.lit("/"), F.lit("-"))).withColumn("_iso", F.col("_s").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:"))
    is_iso = F.col("_iso")
    one = one.withColumn("_two", F.when(~is_iso, F.regexp_extract("_s", r"^(\d{2}-\d{2}-\d{2}) \d{2}:\d{2}:\d{2}(?:\.\d{3})?$", 1) != "").otherwise(False))
    is_two = F.col("_two")
    full = lambda n: F.concat(F.when(F.substring("_s", n, 2).try_cast("int") < 50, "20").otherwise("19"), F.substring("_s", n, 2))
    a_b_c = lambda y, m, d: F.concat(full(y), F.lit("-"), F.substring("_s", m, 2), F.lit("-"), F.substring("_s", d, 2)).try_cast("date").cast("string")
    slashed = F.substring("_raw", 3, 1) == "/"
    kind = F.when(is_iso, "iso").when(F.col("_s").rlike(r"^\d{10}(?:\.\d+)?$|^\d{13}$"), "epoch").when(is_two, "two").when(F.col("_raw").rlike(r"^\d{2}/[A-Z][a-z]{2}/\d{4}:"), "clf").when(F.col("_raw").rlike(r"^[A-Z][a-z]{2} \d{1,2} "), "syslog").otherwise("other")
    day = F.when(is_iso, F.substring("_s", 1, 10)).when(is_two, F.coalesce(a_b_c(1, 4, 7), F.when(slashed, a_b_c(7, 1, 4)), F.when(slashed, a_b_c(7, 4, 1))))
    time = F.when(is_iso | is_two, F.regexp_extract("_s", r"[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)", 1))
    may_name_offset = F.endswith("_raw", F.lit("Z")) | F.substring("_raw", -6, 1).isin("+", "-") | F.substring("_raw", -5, 1).isin("+", "-")
    offset = F.when(F.col("_raw").isNotNull(), F.when(may_name_offset, F.regexp_extract("_raw", r":\d{2}(?:[.,]\d*)?\s*(Z|[+-]\d{2}:?\d{2})$", 1)).otherwise(""))
    two_steps = one.withColumns({"_kind": kind, "_day": day, "_time": time, "_off": offset})
    parts = two_steps.withColumns({"_sign": F.when(F.startswith("_off", F.lit("-")), -1).otherwise(1), "_h": F.substring("_off", 2, 2), "_m": F.substring("_off", -2, 2)})
    away = F.when(F.col("_kind") == "epoch", 0).when(F.col("_off") == "Z", 0).when(F.col("_off") != "", F.col("_sign") * (number("_h") * 60 + number("_m")))
    with_format = lambda c, f: F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz")
    seconds = F.when(F.length("_s") == 13, F.col("_s").try_cast("decimal(30,6)") / 1000).otherwise(F.col("_s").try_cast("decimal(30,6)"))
    local = (
        F.when(F.col("_kind") == "epoch", F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds))
        .when(F.col("_kind").isin("iso", "two"), F.concat("_day", F.lit(" "), "_time").try_cast("timestamp_ntz"))
        .when(F.col("_kind") == "clf", with_format(F.substring("_raw", 1, 20), "dd/MMM/yyyy:HH:mm:ss"))
        .when(F.col("_kind") == "syslog", with_format(F.concat(F.lit(f"{year} "), F.col("_raw")), "yyyy MMM d HH:mm:ss"))
        .otherwise(F.coalesce(*[with_format(F.col("_s"), f) for f in FORMATS]))
    )
    found = parts.withColumns({"_away": away, "_local": local})
    bare = F.col("_local") if kind_of_zone == "Utc" else zone_to_utc(F.col("_local"), zone)
    utc = F.when(F.col("_away").isNotNull(), F.col("_local") - F.make_dt_interval(mins=F.coalesce("_away", F.lit(0)))).otherwise(bare)
    done = found.withColumns({"utc": utc, "basis": F.when(F.col("_away") != 0, "FixedOffset").when(F.col("_away").isNotNull(), "Utc").otherwise(kind_of_zone)})
    done = done.withColumn("offset_minutes", F.coalesce("_away", F.timestamp_diff("MINUTE", F.col("utc"), F.col("_local")).cast("int")))
    return done.drop("_raw", "_s", "_kind", "_day", "_time", "_off", "_sign", "_h", "_m", "_away", "_local", "_t", "_iso", "_two")


# Units of durations; y is 365 days and M is 30.
UNITS = {"y": 365 * DAY, "M": 30 * DAY, "w": 7 * DAY, "d": DAY, "h": 3600, "m": 60, "s": 1, "T": 1e-3, "ms": 1e-3, "u": 1e-6, "us": 1e-6}


def duration(text: str) -> timedelta:
    """A duration like ``1h30m``, in units y, M, w, d, h, m, s, T or ms, u or us."""
    parts = re.findall(r"(\d+)(ms|us|[yMwdhmsTu])", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(microseconds=sum(round(int(n) * UNITS[u] * 1e6) for n, u in parts))


def zoomed(start: datetime, end: datetime, first: datetime, last: datetime, least: timedelta = timedelta(seconds=2)) -> tuple[datetime, datetime]:
    """A window within a session: in order, of at least two seconds, inside its ends."""
    start, end = min(start, end), max(start, end)
    if end - start < least:
        end = start + least
    return max(start, first), min(end, last)


def panned(start: datetime, end: datetime, share: float, first: datetime, last: datetime) -> tuple[datetime, datetime]:
    """A window moved by a share of its length, inside a session's ends; its length stays."""
    step = (end - start) * share
    step = max(first - start, min(last - end, step))
    return start + step, end + step
