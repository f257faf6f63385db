"""From paths to logs, skips and segments: heads tell formats, then the files' lines are read once, told and written.

1. ``read_heads``: a row for each file and archive entry (encoding, format, problem), told from its first 256 KiB.
2. For the formats that there are, the lines of their files are read by ranges of bytes and told by expressions, and each range counts
   its records, bad lines and damage in the order it is read: no exchange, no sort. Text records take their continuation lines
   along; lines before a range's first record wait in the range's last row. The result is written once.
3. A range has one row of totals. Running sums over these rows, a row for 64 MB of files, give each range what came
   before it, and logs, skips and segments are read from the written rows with that joined.

Problems are rows: a file that can't be opened (IOError) or decoded (DecodeError), a damaged or nested archive entry, also one
whose damage shows after its head, a file of no format (NotRecognized). Each is a skip and an empty segment, and the other files
go on. ``formats`` overrides what was told, by path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logweft.functions.text import SEPARATORS
from logweft.operators.ingest import ABANDON, IDENTITY, LOOKAHEAD, RESYNC, SAMPLE, SKIP_COLUMNS, Ingested, as_logs, identified, regions, skip_rows, told_csv, told_ndjson, told_text, unread_times
from logweft.operators.views import segment_statistics
from logweft.schema import LOGS, SKIPS
from logweft.sources.files import RANGE, read_heads, read_ranges
from logweft.sources.shared import written

#: Files that are read together: their formats are broadcast, so that lines stay in order. More are read in several groups.
GROUP = 20_000
#: Bytes that a range has at least, but for a file's end.
LEAST_RANGE = 1 << 20
#: Ranges whose sums are broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 1_000_000
#: What a file keeps of its head.
OF_FILE = [*IDENTITY, "names", "time_fields", "shape", "delimiter", "header_line"]


def before(local: np.ndarray, holds: np.ndarray, part: np.ndarray, carried: int) -> np.ndarray:
    """The last value where a condition held earlier in the same part; 0 without one. ``carried`` is the first part's from before."""
    wide = np.int64(1) << 40
    marks = np.concatenate([[carried if carried else 0], np.where(holds, part * wide + local, 0)[:-1]])
    last = np.maximum.accumulate(marks)
    return np.where(last // wide == part, last % wide, 0)


def counted_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in their order with running counts of their range: idx, k (records), bads, and idx of the last bad and good one before."""
    idx0 = k0 = bads0 = bad0 = good0 = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        end = batch.column("is_end").to_numpy(zero_copy_only=False).astype(bool)
        bad = pc.is_valid(batch.column("bad")).to_numpy(zero_copy_only=False) & ~end
        good = ~bad & ~end
        known = good & pc.is_valid(batch.column("utc")).to_numpy(zero_copy_only=False)
        part = np.cumsum(end) - end  # ends close their part
        begins = np.concatenate([[0], np.flatnonzero(end)[: part[-1]] + 1])

        def along(flags: np.ndarray, carried: int, part=part, begins=begins) -> np.ndarray:
            total = np.cumsum(flags)
            base = np.where(begins > 0, total[begins - 1], -carried)
            return total - base[part]

        idx, k, bads = along(~end, idx0), along(known, k0), along(bad, bads0)
        bad_before, good_before = before(idx, bad, part, bad0), before(idx, good, part, good0)
        more = [pa.array(x.astype(np.int64)) for x in (idx, k, bads, bad_before, good_before)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *COUNTS])
        idx0, k0, bads0 = (0, 0, 0) if end[-1] else (int(idx[-1]), int(k[-1]), int(bads[-1]))
        bad0 = 0 if end[-1] else int(idx[-1] if bad[-1] else bad_before[-1])
        good0 = 0 if end[-1] else int(idx[-1] if good[-1] else good_before[-1])


COUNTS = ["idx", "k", "bads", "bad_before", "good_before"]
COUNTED = ", ".join(f"{c} long" for c in COUNTS)
WHOLE = "k long, last boolean, lines array<string>, n_before long, n_after long"


def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in their order as records with their continuation lines. A range's last row has the lines before its first
    record (``LOOKAHEAD`` at most), how many there are, and how many come after its last record (null without a record)."""
    held: pa.RecordBatch | None = None  # the record that is open, if it is of an earlier batch
    parts: list[str] = []  # its message, or the lines before a range's first record
    ahead: tuple[list, int] = ([], 0)
    n = k = 0
    opened = False

    def rows(batch: pa.RecordBatch, found: list[list]) -> pa.RecordBatch:
        messages, *more = map(list, zip(*found, strict=True))
        at = batch.schema.get_field_index("message")
        batch = batch.set_column(at, batch.schema.field(at), pa.array(messages, pa.string()))
        kinds = (pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64())
        arrays = [pa.array(x, kind) for x, kind in zip(more, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "k", "last", "lines", "n_before", "n_after"])

    for batch in batches:
        end, opens = batch.column("is_end").to_pylist(), batch.column("opens").to_pylist()
        known = pc.is_valid(batch.column("utc")).to_pylist()
        lines = batch.column("line").to_pylist()
        kept = batch.drop_columns(["opens", "line"])
        messages = kept.column("message").to_pylist()
        take, out = [], []  # rows of this batch, and what they get
        for i in range(batch.num_rows):
            if not opens[i] and not end[i]:
                n += 1
                if n <= LOOKAHEAD:
                    parts.append(lines[i])
                continue
            if not opened:
                ahead = (parts, n)
            elif held is not None:
                yield rows(held, [["\n".join(parts), k, end[i], None, None, None]])
                held = None
            else:
                out[-1][0], out[-1][2] = "\n".join(parts), end[i]
            take.append(i)
            if end[i]:
                out.append([None, k, None, *ahead, n if opened else None])
                parts, n, k, opened = [], 0, 0, False
            else:
                k += known[i]
                out.append([None, k, None, None, None, None])
                parts, n, opened = [messages[i]], 0, True
        if opened and take:  # the last record may go on
            held = kept.slice(take.pop(), 1)
            out.pop()
        if take:
            yield rows(kept.take(pa.array(take)), out)


def ranges_of(table: DataFrame, text: bool) -> DataFrame:
    """A row for each range, from the rows that close them: what its file has before it, and in all."""
    here, whole = Window.partitionBy("path").orderBy("start"), Window.partitionBy("path")
    ahead = here.rowsBetween(Window.unboundedPreceding, -1)
    ends = table.where("is_end")
    total = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    file = [F.sum("line_no").over(whole).alias("last_line"), F.max("byte_end").over(whole).alias("last_byte"), F.max("problem").over(whole).alias("broken")]
    if not text:
        summed = ends.select("path", "start", total("line_no").alias("b_lines"), total("idx").alias("b_idx"), total("k").alias("b_k"), F.sum("bads").over(whole).alias("file_bads"), "bad_before", "good_before", *file)
        latest = lambda c: F.max(F.when(F.col(c) > 0, F.col("b_idx") + F.col(c))).over(ahead)
        return written(summed.select("*", latest("bad_before").alias("b_bad"), latest("good_before").alias("b_good")).drop("bad_before", "good_before"), "ranges")
    latest = lambda c: F.last(F.when(F.col("n_after").isNotNull(), F.col(c)), ignorenulls=True).over(ahead)
    summed = ends.select("path", "start", total("line_no").alias("b_lines"), total("k").alias("b_k"), "lines", "n_before", latest("start").alias("owner"), latest("n_after").alias("owner_more"), *file)
    summed = written(summed, "text-ranges")
    chain = Window.partitionBy("path", "owner").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    room = (F.lit(LOOKAHEAD) - F.col("owner_more") - F.coalesce(F.sum("n_before").over(chain), F.lit(0))).cast("int")
    tails = summed.where("n_before > 0 and owner is not null").withColumn("room", room).where("room > 0")
    part = F.struct("start", F.slice("lines", F.lit(1), F.col("room")).alias("lines"))
    tails = tails.groupBy("path", F.col("owner").alias("start")).agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["lines"])), "\n").alias("tail"))
    return written(summed.drop("lines", "n_before", "owner", "owner_more").join(tails, ["path", "start"], "left"), "ranges")


def with_ranges(table: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of files that could be read to their end, with what their file has before their range."""
    side = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
    return table.where("not is_end").join(side, ["path", "start"]).where("broken is null").withColumns({"line_no": F.col("b_lines") + F.col("line_no"), "k": F.col("b_k") + F.col("k")})


def of_text(table: DataFrame, ranges: DataFrame, run: str) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Logs and skips of text files."""
    rows = with_ranges(table, ranges)
    more = F.when(F.col("last") & F.col("tail").isNotNull(), F.concat("message", F.lit("\n"), "tail")).otherwise(F.col("message"))
    return as_logs(rows.where("utc is not null").withColumn("message", more), run), lambda: unread_times(rows.where("utc is null"), F.col("sample"))


def of_structured(table: DataFrame, ranges: DataFrame, run: str) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Logs and skips of CSV and NDJSON files."""
    latest = lambda c, b: F.when(F.col(c) > 0, F.col("b_idx") + F.col(c)).otherwise(F.col(b))
    rows = with_ranges(table, ranges).withColumns({"bad_before": latest("bad_before", "b_bad"), "good_before": latest("good_before", "b_good")}).withColumn("idx", F.col("b_idx") + F.col("idx"))
    good, stop = F.col("bad").isNull(), F.lit(None).cast("long")
    if ranges.where(F.col("file_bads") >= ABANDON).limit(1).count():  # else no file can be given up
        over = rows.where(~good & (F.col("idx") - F.coalesce("good_before", F.lit(0)) == ABANDON))
        rows = rows.join(over.groupBy("path").agg(F.min("idx").alias("stop_idx")), "path", "left").where("stop_idx is null or idx <= stop_idx")
        stop = F.col("stop_idx")
    k = F.when(F.col("kind") == "csv", RESYNC["csv"]).otherwise(RESYNC["ndjson"])
    ends = ranges.groupBy("path").agg(F.max("last_line").alias("last_line"), F.max("last_byte").alias("last_byte"))
    return as_logs(rows.where(good & F.col("utc").isNotNull()), run), lambda: regions(rows.withColumn("stop_idx", stop), k, ends)


def kept_schema(rows: DataFrame, drop: tuple[str, ...], more: str) -> StructType:
    return StructType([*[f for f in rows.schema.fields if f.name not in drop], *StructType.fromDDL(more).fields])


def told_lines(spark: SparkSession, kind: str, some: list, files: DataFrame, zone: str, size: int, task: int) -> DataFrame:
    """The lines of files of one format, told, and counted in their ranges."""
    lines = read_ranges(spark, [(r.path, r.archive, r.entry_at, r.size) for r in some], size, task)
    rows = lines.join(F.broadcast(files.where(F.col("format") == kind).select("path", *OF_FILE)), "path").withColumns({"is_end": F.col("line").isNull(), "header_line": F.when(F.col("start") == 0, F.col("header_line"))})
    if kind == "text":
        told = told_text(rows, zone, F.col("shape"))
        told = told.withColumn("sample", F.when(F.col("utc").isNull(), F.substring("line", 1, SAMPLE)))
        return told.mapInArrow(whole_records, kept_schema(told, ("opens", "line"), WHOLE))
    names = {r.delimiter for r in some}
    told = told_csv(rows, zone, SEPARATORS[names.pop()] if len(names) == 1 else None) if kind == "csv" else told_ndjson(rows, zone)
    told = told.withColumn("kind", F.lit(kind))
    return told.mapInArrow(counted_lines, kept_schema(told, (), COUNTED))


def ingest_files(spark: SparkSession, *paths: str, run: str, zone: str = "UTC", formats: DataFrame | None = None, range_bytes: int | None = None) -> Ingested:
    """Files, folders and archives to logs, skips and segments. ``formats``: path and any columns of a head that it overrides. The paths of
    the files pass through the driver, as they do when Spark lists files; their lines don't. A range has 64 MB, or less if the files
    are too small to keep all cores busy otherwise; a task takes as many smaller ranges."""
    heads = written(read_heads(spark, *paths), "heads")
    if formats is not None:
        own = [c for c in formats.columns if c != "path"]
        given = formats.select("path", *[F.col(c).alias(f"own_{c}") for c in own], F.lit(True).alias("given"))
        heads = heads.join(given, "path", "left").select(*[F.when(F.col("given"), F.col(f"own_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in heads.columns])
    files = identified(heads).withColumns({"format": F.coalesce("format", F.lit("unknown")), "header_line": F.when(F.col("header"), F.col("first_line"))})
    readable = files.where("problem is null and format <> 'unknown'").select("path", "archive", "entry_at", "size", "format", "delimiter").collect()
    share = min(RANGE, max(LEAST_RANGE, sum(r.size for r in readable) // spark.sparkContext.defaultParallelism))
    size = range_bytes or share
    logs, skips, broken = [], [], []
    for structured in (False, True):
        parts = []
        for kind in ("csv", "ndjson") if structured else ("text",):
            some = [r for r in readable if r.format == kind]
            parts += [told_lines(spark, kind, some[at : at + GROUP], files, zone, size, max(size, share)) for at in range(0, len(some), GROUP)]
        if parts:
            table = written(reduce(DataFrame.unionByName, parts), "structured" if structured else "records")
            ranges = ranges_of(table, not structured)
            for found, into in zip((of_structured if structured else of_text)(table, ranges, run), (logs, skips), strict=True):
                into.append(found)
            broken.append(ranges.where("broken is not null").select("path", F.col("broken").alias("late")).distinct())
    late = reduce(DataFrame.unionByName, broken) if broken else spark.createDataFrame([], "path string, late string")
    known = files.join(F.broadcast(late), "path", "left").withColumn("problem", F.coalesce("problem", "late"))
    name = F.regexp_extract("path", r"[^/\\!]*$", 0)
    reason = F.coalesce("problem", F.when(F.col("format") == "unknown", F.lit("NotRecognized")))
    detail = F.coalesce("detail", F.when(F.col("problem").isNull(), F.concat(F.lit("No viable format detected for "), name)).otherwise(F.col("path")))
    unread = known.withColumns({"reason_code": reason, "reason_detail": detail, "segment_seq": F.lit(0).cast("long")}).where("reason_code is not null")
    unread = unread.select(*[F.col(c) if c in unread.columns else F.lit(None).cast(SKIPS[c].dataType).alias(c) for c in SKIP_COLUMNS])
    all_logs = reduce(DataFrame.unionByName, logs) if logs else spark.createDataFrame([], LOGS)
    all_skips = lambda: unread.unionByName(skip_rows(reduce(DataFrame.unionByName, [s() for s in skips]))) if skips else unread
    return Ingested(all_logs, all_skips, segments_of(known, all_logs, run))


def segments_of(files: DataFrame, logs: DataFrame, run: str) -> DataFrame:
    """A segment for each file, also for those that gave no rows."""
    rows = F.coalesce("row_count", F.lit(0))
    return files.join(segment_statistics(logs), "segment_id", "left").select(
        "segment_id", "logical_source_id", "physical_file_id", "min_ts_utc", "max_ts_utc", rows.alias("row_count"), F.lit(run).alias("last_ingest_run_id"), F.lit(True).alias("active"),
        F.when(rows > 0, F.col("size")).otherwise(F.lit(0)).alias("last_byte_offset"), F.col("path").alias("source_path"), F.col("size").alias("file_size_bytes"),
        F.col("modified").alias("last_modified_utc"), F.lit(None).cast("string").alias("file_hash"),
    )
