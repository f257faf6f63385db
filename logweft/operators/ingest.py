"""Numbered lines to rows of ``logs``, skipped regions and segments, in one pass over the lines of a format.

Each line is told for itself (does it open a record, is it bad, what are its time, level, message and fields), then the
lines go to stretches of their file once, where running counts number records and data lines and find damage. Nothing but
counts crosses stretches, so a large file is many tasks; only the lines of text records meet once more.

``ingest`` takes lines of any files, tells their formats, and gives logs, skips and segments; ``read_text``, ``read_csv``
and ``read_ndjson`` take lines of one format.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweft.functions.json_text import json_fields
from logweft.functions.text import SEPARATORS, cells, file_id, logical_source, normal_level, segment_id, string_fields
from logweft.functions.times import TIME_FIELDS, after_stamp_text, alternate_text, preferred, stamp_text, with_utc
from logweft.operators.running import PART, along, by_stretch, running, stretched
from logweft.operators.views import segment_statistics
from logweft.schema import COLUMNS, SKIPS
from logweft.sources.lines import DATE_NAMES, DETECTED, TIME_NAMES, detected
from logweft.sources.shared import written

#: Continuation lines that a text record may have.
LOOKAHEAD = 4096
#: Good lines in a row that end a skipped region, by format; bad lines in a row that end a file.
RESYNC = {"csv": 5, "ndjson": 3}
ABANDON = 10_000
#: Characters of a skipped region's sample.
SAMPLE = 256
#: Files whose formats and identities are broadcast; more are joined.
BROADCAST_FILES = 20_000

# The shapes of a text record after its timestamp; groups are level, subsource, task_id and message, as far as they go.
HEAD_TASK = r"^\s*(\w+)\s+\[([^\]]+)\]\s*\[([^\]]+)\]\s*(.+)$"
HEAD_SOURCE = r"^\s*(\w+)\s+\[([^\]]+)\]\s*(.+)$"
HEAD_LEVEL = r"^\s*(\w+)\s+(.+)$"

SKIP_COLUMNS = SKIPS.fieldNames()


class Read:
    """Logs, and skips, which are made when they are asked for. ``times``: (segment_id, timestamp_utc) of the logs, by a way that makes no more of them."""

    def __init__(self, logs: DataFrame, skips: DataFrame | Callable[[], DataFrame], times: Callable[[], DataFrame] | None = None):
        self.logs, self._skips = logs, skips
        self.times = times or (lambda: logs.select("segment_id", "timestamp_utc"))

    @property
    def skips(self) -> DataFrame:
        if not isinstance(self._skips, DataFrame):
            self._skips = self._skips()
        return self._skips


class Ingested(Read):
    """What was read, and its segments, which are made when they are asked for, too."""

    def __init__(self, logs: DataFrame, skips: DataFrame | Callable[[], DataFrame], segments: DataFrame | Callable[[], DataFrame]):
        super().__init__(logs, skips)
        self._segments = segments

    @property
    def segments(self) -> DataFrame:
        if not isinstance(self._segments, DataFrame):
            self._segments = self._segments()
        return self._segments


def stretch() -> Column:
    """Lines that a window takes together."""
    return F.floor(F.col("line_no") / 50_000)


def identified(files: DataFrame) -> DataFrame:
    """Files (path, and size and modified if they are known) with physical_file_id, segment_id and logical_source_id."""
    known = {"size", "modified"} <= set(files.columns)
    physical = file_id(F.col("path"), F.col("size"), F.col("modified")) if known else F.substring(F.sha2("path", 256), 1, 16)
    return files.withColumn("physical_file_id", physical).withColumns({"segment_id": segment_id(F.col("physical_file_id")), "logical_source_id": logical_source(F.col("path"))})


def after_stamp(text: Column, pattern: str | None = None) -> tuple[Column, Column, Column]:
    """Level, message and fields of the text after a timestamp, by the first shape that fits, or by a pattern of one's own
    with the groups of ``HEAD_TASK`` or fewer."""
    group = lambda shape, n: F.nullif(F.trim(F.regexp_extract(text, shape, n)), F.lit(""))
    trimmed = F.trim(text)
    if pattern is not None:
        names = ["level", *["subsource", "task_id"][: max(0, pattern.replace("\\(", "").replace("(?:", "").count("(") - 2)], "message"]
        fields = [x for k, n in enumerate(names, 1) if n not in ("level", "message") for x in (F.lit(n), group(pattern, k))]
        kept = F.map_filter(F.create_map(*fields), lambda _, v: v.isNotNull()) if fields else F.lit(None).cast("map<string,string>")
        return normal_level(group(pattern, 1)), F.coalesce(group(pattern, len(names)), trimmed), kept
    task, source, level = text.rlike(HEAD_TASK), text.rlike(HEAD_SOURCE), text.rlike(HEAD_LEVEL)
    word = F.when(task, group(HEAD_TASK, 1)).when(source, group(HEAD_SOURCE, 1)).when(level, group(HEAD_LEVEL, 1))
    message = F.coalesce(F.when(task, group(HEAD_TASK, 4)).when(source, group(HEAD_SOURCE, 3)).when(level, group(HEAD_LEVEL, 2)), trimmed)
    fields = F.when(task, F.create_map(F.lit("subsource"), group(HEAD_TASK, 2), F.lit("task_id"), group(HEAD_TASK, 3))).when(source, F.create_map(F.lit("subsource"), group(HEAD_SOURCE, 2)))
    return normal_level(word), message, F.map_filter(fields, lambda _, v: v.isNotNull())


def time_of(fields: Column, time_fields: Column | None) -> Column:
    """The text of a record's time: its time fields joined, if they are known; else a day's and a time of day's field
    joined, else the first field that is known to hold a time."""
    at = lambda n: F.nullif(F.trim(F.try_element_at(fields, n)), F.lit(""))
    single = F.coalesce(*[at(F.lit(n)) for n in TIME_FIELDS])
    keys = F.map_keys(fields)
    one_of = lambda names: F.get(F.filter(keys, lambda k: F.lower(k).isin(*names)), F.lit(0))
    day, hour = at(one_of(DATE_NAMES)), at(one_of(TIME_NAMES))
    pair = F.when(day.isNotNull() & hour.isNotNull() & hour.rlike(r"^\d{1,2}:\d{2}"), F.concat_ws(" ", day, hour))
    found = F.coalesce(pair, single)
    if time_fields is None:
        return found
    return F.coalesce(F.nullif(F.concat_ws(" ", F.transform(time_fields, lambda n: at(n))), F.lit("")), found)


def structured(rows: DataFrame, zone: str) -> DataFrame:
    """Rows with ``fields`` (a map, null for bad lines) with what a log row has of them."""
    named = lambda *names: F.coalesce(*[F.try_element_at("fields", F.lit(n)) for n in names])
    good = F.col("fields").isNotNull()
    more = F.map_filter("fields", lambda k, _: ~k.isin("level", "severity", "message", "msg"))
    told = rows.withColumn("stamp", F.when(good, time_of(F.col("fields"), F.col("time_fields") if "time_fields" in rows.columns else None)))
    told = told.withColumns({"original": F.col("stamp"), "level": normal_level(named("level", "severity")), "message": F.coalesce(named("message", "msg"), F.col("line")), "more": string_fields(more)})
    return with_utc(told, "stamp", zone).withColumnRenamed("more", "fields_json")


def prepared(lines: DataFrame, files: DataFrame | None) -> DataFrame:
    """Lines with their file's identity, and what ``files`` has besides."""
    if files is None:
        return identified(lines)
    return lines.join(files, "path")


IDENTITY = ["logical_source_id", "physical_file_id", "segment_id"]
#: Columns of lines that were read by ranges.
RANGED = ["start", "is_end", "problem"]
TOLD = ["path", "line_no", "byte_end", *IDENTITY, "utc", "basis", "offset_minutes", "original", "level", "message"]


def ranged(rows: DataFrame) -> list[str]:
    return [c for c in RANGED if c in rows.columns]


def filled(rows: DataFrame, more: Column | None = None) -> DataFrame:
    """Lines that aren't blank, and the rows that close ranges, which have no line."""
    full = F.trim("line") != ""
    return rows.where(F.col("line").isNull() | (full if more is None else full & more))


def told_text(lines: DataFrame, zone: str, shape: Column | None = None, pattern: str | None = None) -> DataFrame:
    """Each line: does it open a record, and if so its time (of two in the line the better one), level, message and fields."""
    first = stamp_text(F.col("line"), shape)
    rows = lines.withColumn("first", first).withColumn("other", F.when(F.col("first").isNotNull(), alternate_text(F.col("line"), F.col("first"))))
    stamp, original = preferred(F.col("first"), F.col("other"))
    rows = rows.withColumns({"stamp": stamp, "original": original, "rest": after_stamp_text(F.col("line"), shape)})
    level, message, fields = after_stamp(F.col("rest"), pattern)
    rows = rows.withColumns({"level": level, "message": message, "fields_json": string_fields(fields), "opens": F.col("first").isNotNull()})
    return with_utc(rows, "stamp", zone).select(*TOLD, *ranged(rows), "fields_json", "opens", "line")


def told_csv(lines: DataFrame, zone: str, separator: str | None = ",") -> DataFrame:
    """Each line: its fields, or why it is bad. Lines have ``names`` and ``header_line`` (null without a header); without a
    separator also ``delimiter``. Of columns with one name the last counts."""
    line = F.col("line")
    cut = cells(line, separator) if separator else reduce(lambda c, kv: c.when(F.col("delimiter") == kv[0], cells(line, kv[1])), SEPARATORS.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    rows = filled(lines, F.col("header_line").isNull() | (F.col("line_no") > F.col("header_line"))).withColumn("cells", cut)
    good = F.size("cells") == F.size("names")
    once = F.array_distinct("names")
    last = F.transform(once, lambda n: F.element_at("cells", F.size("names") - F.array_position(F.reverse("names"), n).cast("int") + 1))
    rows = rows.withColumns({"fields": F.when(good, F.map_from_arrays(once, last)), "bad": F.when(~good, "CsvColumnMismatch"), "detail": F.when(~good, F.format_string("expected %d columns, found %d", F.size("names"), F.size("cells")))})
    return structured(rows, zone).select(*TOLD, *ranged(rows), "fields_json", "bad", "detail", F.when(F.col("bad").isNotNull(), F.substring("line", 1, SAMPLE)).alias("sample"), F.when(F.col("utc").isNull(), F.substring("line", 1, SAMPLE)).alias("head"))


def told_ndjson(lines: DataFrame, zone: str) -> DataFrame:
    """Each line: its fields (every value in the line's own text; null as empty; of one name the last), or why it is bad."""
    rows = filled(lines)
    rows = rows.withColumn("fields", json_fields("line"))
    is_bad = F.col("fields").isNull()
    rows = rows.withColumns({"bad": F.when(is_bad, "JsonMalformed"), "detail": F.when(is_bad, "not a JSON object")})
    return structured(rows, zone).select(*TOLD, *ranged(rows), "fields_json", "bad", "detail", F.when(F.col("bad").isNotNull(), F.substring("line", 1, SAMPLE)).alias("sample"), F.when(F.col("utc").isNull(), F.substring("line", 1, SAMPLE)).alias("head"))


def as_logs(rows: DataFrame, run: str) -> DataFrame:
    return rows.select(
        F.col("utc").alias("timestamp_utc"), F.col("basis").alias("timestamp_basis"), F.col("offset_minutes").alias("timestamp_effective_offset_minutes"), F.col("original").alias("timestamp_original"), "logical_source_id",
        F.col("path").alias("source_path"), "physical_file_id", "segment_id", F.lit(run).alias("ingest_run_id"), (F.col("k") - 1).alias("record_index"), "level", "message", F.col("fields_json").alias("fields"),
    ).select(*COLUMNS)


def skip_rows(rows: DataFrame) -> DataFrame:
    """(path, ids, start and end, reason, detail, sample) numbered within each file, from 1, by where they start."""
    ordered = running(rows.withColumn("line_no", F.col("start_line")).withColumn("at", F.struct("start_line", "rank")), "path", stretch(), "at", sums={"segment_seq": F.lit(1)})
    return ordered.select(*SKIP_COLUMNS)


def skip_columns(rank: int, code: Column | str, detail: Column, start: Column, end: Column, offsets: tuple[Column, Column] | None = None, sample: Column | None = None) -> list[Column]:
    """What a skip has besides its file; of skips that start at one line the smaller rank comes first."""
    none = F.lit(None).cast("long")
    first, last = offsets or (none, none)
    code = F.lit(code) if isinstance(code, str) else code
    sample = F.lit(None).cast("string") if sample is None else sample
    named = {"rank": F.lit(rank), "start_line": start, "end_line": end, "start_offset": first, "end_offset": last, "reason_code": code, "reason_detail": detail, "sample_prefix": sample.cast("binary")}
    return [c.alias(n) for n, c in named.items()]


def unread_times(rows: DataFrame, sample: Column) -> DataFrame:
    return rows.select("path", "logical_source_id", "segment_id", *skip_columns(1, "TimeParse", F.lit("Timestamp extraction failed"), F.col("line_no"), F.col("line_no"), sample=sample))


def read_text(lines: DataFrame, run: str, zone: str = "UTC", files: DataFrame | None = None, pattern: str | None = None) -> Read:
    """A line that begins with a timestamp (of the file's ``shape``, if files have one) opens a record, the lines after it go
    on with it, up to ``LOOKAHEAD``; lines before a file's first record are no records."""
    rows = prepared(lines, files)
    told = told_text(rows, zone, F.col("shape") if "shape" in rows.columns else None, pattern)
    known = (F.col("opens") & F.col("utc").isNotNull()).cast("long")
    numbered = along(stretched(told, "path", stretch()), "path", "line_no", sums={"k": known}, latest={"record": F.when(F.col("opens"), F.col("line_no"))})
    owned = numbered.where(F.col("record").isNotNull() & (F.col("line_no") - F.col("record") <= LOOKAHEAD))
    head = F.max(F.when(F.col("line_no") == F.col("record"), F.struct(*IDENTITY, "utc", "basis", "offset_minutes", "original", "level", "message", "fields_json", "k"))).alias("h")
    # at most LOOKAHEAD lines besides the first
    more = F.sort_array(F.collect_list(F.when(F.col("line_no") > F.col("record"), F.struct("line_no", "line")))).alias("more")
    whole = owned.groupBy("path", "record").agg(head, more).select("path", "h.*", "more").where("utc is not null")
    whole = whole.withColumn("message", F.when(F.size("more") > 0, F.concat("message", F.lit("\n"), F.array_join(F.transform("more", lambda x: x["line"]), "\n"))).otherwise(F.col("message")))
    # skips and segments need no more of the lines than these, once; a record is one opening line with a time
    brief = told.where("opens").select("path", "logical_source_id", "segment_id", "line_no", "utc", F.when(F.col("utc").isNull(), F.substring("line", 1, SAMPLE)).alias("sample"))
    opened = cache(lambda: written(brief, "opened"))
    times = lambda: opened().where("utc is not null").select("segment_id", F.col("utc").alias("timestamp_utc"))
    return Read(as_logs(whole, run), lambda: skip_rows(unread_times(opened().where("utc is null"), F.col("sample"))), times)


def read_told(told: DataFrame, ends: DataFrame, kind: str, run: str) -> Read:
    """Rows and skips of lines that are records or bad. ``ends``: path, last_line and last_byte of each file."""
    k, good = RESYNC[kind], F.col("bad").isNull()

    def kept(told: DataFrame) -> DataFrame:
        cut = stretched(told, "path", stretch())
        numbered = along(cut, "path", "line_no", sums={"idx": F.lit(1), "k": (good & F.col("utc").isNotNull()).cast("long")}, marks={"bad_before": (~good, "idx"), "good_before": (good, "idx")})
        # a file is given up with the first of so many bad lines in a row
        over = numbered.where(~good & (F.col("idx") - F.coalesce("good_before", F.lit(0)) == ABANDON))
        stops = over.groupBy("path").agg(F.min("idx").alias("stop_idx"))
        return by_stretch(numbered, "path", stops, "left", cut).where(F.col("stop_idx").isNull() | (F.col("idx") <= F.col("stop_idx")))

    # skips and segments need no more of the lines than these, once
    brief = cache(lambda: written(told.select("path", "logical_source_id", "segment_id", "line_no", "byte_end", "utc", "bad", "detail", "sample", "head"), "brief"))

    def times() -> DataFrame:
        rows = brief()
        if not rows.where(~good).groupBy("path").count().where(F.col("count") >= ABANDON).isEmpty():  # else no file can be given up
            rows = kept(rows)
        return rows.where(good & F.col("utc").isNotNull()).select("segment_id", F.col("utc").alias("timestamp_utc"))

    logs = as_logs(kept(told).where(good & F.col("utc").isNotNull()), run)
    return Read(logs, lambda: skip_rows(regions(kept(brief()), k, ends)), times)


def regions(kept: DataFrame, k: Column | int, ends: DataFrame) -> DataFrame:
    """Skipped regions, given-up files and unread times of rows with idx, bad_before and stop_idx (null unless their file is given
    up). A region begins with a bad line that comes more than ``k`` lines after the last one, and ends with the k-th good line."""
    good = F.col("bad").isNull()
    gap = F.col("idx") - F.col("bad_before")
    starts, stop = ~good & (gap.isNull() | (gap > k)), F.col("idx") == F.col("stop_idx")
    unread = good & F.col("utc").isNull()
    events = kept.select("path", "logical_source_id", "segment_id", "line_no", "byte_end", "bad", "detail", "sample", "head", starts.alias("starts"), F.coalesce(stop, F.lit(False)).alias("stop"), (good & (gap == k)).alias("ends"), unread.alias("unread")).where("starts or ends or stop or unread")
    events = written(events, "regions")  # a few rows a region, so that the lines are read for them once
    missed = events.where("unread")
    events = running(events.where("starts or ends or stop"), "path", stretch(), "line_no", sums={"region": F.col("starts").cast("long")})
    at = lambda flag, *c: F.max(F.when(F.col(flag), F.struct(*c)))
    ids = [F.first(c).alias(c) for c in ("logical_source_id", "segment_id")]
    begin = at("starts", "line_no", "byte_end", "bad", "detail", "sample").alias("s")
    end = F.max(F.when(F.col("ends") | F.col("stop"), F.struct("line_no", "byte_end"))).alias("e")
    found = events.groupBy("path", "region").agg(*ids, begin, end).join(ends, "path")
    last, offsets = F.coalesce("e.line_no", "last_line"), (F.col("s.byte_end"), F.coalesce("e.byte_end", "last_byte"))
    region = found.select("path", "logical_source_id", "segment_id", *skip_columns(0, F.col("s.bad"), F.col("s.detail"), F.col("s.line_no"), last, offsets, F.col("s.sample")))
    given_up = skip_columns(2, "Abandoned", F.lit(f"Abandoned after {ABANDON} consecutive bad lines"), F.col("line_no"), F.col("line_no"))
    abandoned = events.where("stop").select("path", "logical_source_id", "segment_id", *given_up)
    return region.union(abandoned).union(unread_times(missed, F.col("head")))


def file_ends(lines: DataFrame) -> DataFrame:
    return lines.groupBy("path").agg(F.max("line_no").alias("last_line"), F.max("byte_end").alias("last_byte"))


def csv_heads(lines: DataFrame, separator: str = ",") -> DataFrame:
    """path, names and header_line: the first line of each file that isn't blank is its header."""
    first = lines.where(F.trim("line") != "").groupBy("path").agg(F.min_by("line", "line_no").alias("header"), F.min("line_no").alias("header_line"))
    return first.select("path", cells(F.col("header"), separator).alias("names"), "header_line")


def read_csv(lines: DataFrame, run: str, zone: str = "UTC", files: DataFrame | None = None, separator: str | None = ",") -> Read:
    """Files with a header line, or with ``names``, ``header_line`` and ``delimiter`` in ``files``."""
    rows = prepared(lines, files)
    if "names" not in rows.columns:
        rows = rows.join(csv_heads(lines, separator or ","), "path")
    return read_told(told_csv(rows, zone, None if "delimiter" in rows.columns else separator), file_ends(lines), "csv", run)


def read_ndjson(lines: DataFrame, run: str, zone: str = "UTC", files: DataFrame | None = None) -> Read:
    return read_told(told_ndjson(prepared(lines, files), zone), file_ends(lines), "ndjson", run)


def ingest(lines: DataFrame, run: str, zone: str = "UTC", files: DataFrame | None = None, problems: DataFrame | None = None) -> Ingested:
    """Lines of any files to logs, skips and segments. Each file's format is told from its first lines; a file of no format is
    a skip (NotRecognized) and an empty segment. ``files`` (path, and size, modified and hash if they are known) names the
    files, also empty ones; ``problems`` (path, problem) are archives' entries that couldn't be read, each a skip."""
    spark = lines.sparkSession
    files = lines.select("path").distinct() if files is None else files
    names = [c.split()[0] for c in DETECTED.split(", ")]
    formats = written(detected(lines), "formats")  # a row a file: told once, so that the plans below start from it
    told = identified(files).join(formats, "path", "left").withColumn("format", F.coalesce("format", F.lit("unknown")))
    heads = lines.where(F.trim("line") != "").groupBy("path").agg(F.min("line_no").alias("first_line"))
    told = told.join(heads, "path", "left").withColumn("header_line", F.when(F.col("header"), F.col("first_line")))
    told = written(told, "told")
    many = told.count()
    of = {r.format for r in told.select("format").distinct().collect()}  # four at most
    wide = [c for c in (*IDENTITY, *names[5:], "delimiter", "header_line") if c != "header"]

    def pick(kind: str) -> DataFrame:
        some = told.where(F.col("format") == kind).select("path", *[c for c in dict.fromkeys(wide) if c != "path"])
        return F.broadcast(some) if many <= BROADCAST_FILES else some

    none = lambda schema: spark.createDataFrame([], schema)
    parts = [read(lines, run, zone, pick(kind)) for kind, read in (("text", read_text), ("csv", read_csv), ("ndjson", read_ndjson)) if kind in of]
    from logweft.schema import LOGS

    logs = reduce(DataFrame.unionByName, [p.logs for p in parts], none(LOGS)) if not parts else reduce(DataFrame.unionByName, [p.logs for p in parts])
    def reason(code: Column, detail: Column, source: Column, segment: Column) -> list[Column]:
        named = {"logical_source_id": source, "segment_id": segment, "segment_seq": F.lit(0).cast("long"), "reason_code": code, "reason_detail": detail}
        return [named.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in SKIPS]

    lost = told.where("format = 'unknown'").select(*reason(F.lit("NotRecognized"), F.concat(F.lit("No viable format detected for "), F.regexp_extract("path", r"[^/\\!]*$", 0)), F.col("logical_source_id"), F.col("segment_id")))
    if problems is not None:
        lost = lost.unionByName(problems.where("problem is not null").select(*reason(F.col("problem"), F.col("path"), logical_source(F.col("path")), F.lit("zip-entry"))))
    skips = lambda: reduce(DataFrame.unionByName, [p.skips for p in parts], lost)
    extra = [F.col(c) if c in files.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("size", "long"), ("modified", "timestamp_ntz"), ("hash", "string"))]
    segments = told.select("segment_id", "logical_source_id", "physical_file_id", F.col("path").alias("source_path"), *extra)
    rows = F.coalesce("row_count", F.lit(0))
    named = {
        "row_count": rows, "last_ingest_run_id": F.lit(run), "active": F.lit(True), "last_byte_offset": F.when(rows > 0, F.col("size")).otherwise(F.lit(0)), "source_path": F.col("source_path"),
        "file_size_bytes": F.col("size"), "last_modified_utc": F.col("modified"), "file_hash": F.col("hash"),
    }
    ids = ("segment_id", "logical_source_id", "physical_file_id", "min_ts_utc", "max_ts_utc")
    times = lambda: reduce(DataFrame.unionByName, [p.times() for p in parts], none("segment_id string, timestamp_utc timestamp_ntz"))
    counted = lambda: segments.join(segment_statistics(times()), "segment_id", "left").select(*ids, *[c.alias(n) for n, c in named.items()])
    return Ingested(logs, skips, counted)
