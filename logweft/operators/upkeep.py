"""Keeping a session's tables: plans for new files, changes, re-ingest, upserts and consistency, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweft.operators.ingest import Ingested
from logweft.operators.views import segment_statistics

#: Rows of a file of a written segment.
FILE_ROWS = 5_000_000
#: The column of microseconds in a written log, and what it has for a segment without rows.
MICROS, GONE = "timestamp_us", -(2**63)
RUNS = "run_id string, started_utc timestamp_ntz, completed_utc timestamp_ntz, status string"


def latest(segments: DataFrame, *by: str) -> DataFrame:
    """The newest segment for each key; segments without a time come last."""
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("last_modified_utc"), "segment_id")
    return segments.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def ingest_plan(files: DataFrame, segments: DataFrame, action: str = "Skip") -> DataFrame:
    """What to do with each candidate (path, size, modified, fingerprint, present): ``ingest``, or the action for files that
    are known by fingerprint or by path with another time. Paths that differ in case only are planned once."""
    once = files.withColumn("k", F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("path"))).where("k = 1").drop("k")
    active = segments.where("active")
    same = latest(active, "physical_file_id").select(F.col("physical_file_id").alias("fingerprint"), F.col("segment_id").alias("same_segment"))
    moved = latest(active, "source_path").select(F.lower("source_path").alias("low"), F.col("segment_id").alias("path_segment"), "last_modified_utc")
    both = once.join(same, "fingerprint", "left").join(moved, F.lower("path") == F.col("low"), "left")
    zipped, known = F.lower("path").endswith(".zip"), F.col("same_segment").isNotNull()
    changed = F.col("path_segment").isNotNull() & (F.col("modified") != F.col("last_modified_utc"))
    what = F.when(~F.col("present"), "missing").when(zipped, "ingest").when(known | changed, action).otherwise("ingest")
    reason = F.when(~F.col("present"), "File does not exist").when(zipped, F.lit(None)).when(known, f"File already ingested with same fingerprint; action={action}").when(changed, f"File path exists but contents changed since previous ingest; action={action}")
    return both.select("path", what.alias("plan"), F.when(what == action, F.coalesce("same_segment", "path_segment")).alias("segment_id"), reason.alias("reason"))


def file_changes(files: DataFrame, segments: DataFrame) -> DataFrame:
    """New, Deleted, Modified or Unchanged for each path: by size, then by time (to the microsecond), then by hash if both have one."""
    old = latest(segments.where("active"), "source_path").select(F.col("source_path").alias("path"), F.col("file_size_bytes").alias("old_size"), F.col("last_modified_utc").alias("old_modified"), F.col("file_hash").alias("old_hash"))
    both = files.select("path", "size", "modified", "hash", F.lit(True).alias("here")).join(old.withColumn("there", F.lit(True)), "path", "full")
    state = F.when(F.col("there").isNull(), "New").when(F.col("here").isNull(), "Deleted").when(F.col("size") != F.col("old_size"), "Modified").when(F.col("modified") == F.col("old_modified"), "Unchanged").when(F.col("hash") == F.col("old_hash"), "Unchanged").otherwise("Modified")
    return both.select("path", state.alias("state"))


def replaced(table: DataFrame, new: DataFrame, *key: str, keys: DataFrame | None = None) -> DataFrame:
    """The table with the rows of some keys replaced: rows of ``keys`` (else of the keys that ``new`` has) go, and the new rows
    come. With ``keys``, what is read again and gives nothing goes, too."""
    gone = new if keys is None else keys
    return table.join(gone.select(*key).distinct(), list(key), "left_anti").unionByName(new.select(*table.columns))


def reingested(logs: DataFrame, skips: DataFrame, segments: DataFrame, again: Ingested) -> Ingested:
    """The session's tables after files were read again: logs, skips and the segment's row are replaced by segment id, also
    where a segment gives no rows now. Files that changed have new ids; their old segments are named by their path."""
    old = segments.join(again.segments.select("source_path").distinct(), "source_path", "left_semi").select("segment_id")
    ids = old.union(again.segments.select("segment_id")).distinct()
    swap = lambda table, new: replaced(table, new, "segment_id", keys=ids)
    return Ingested(swap(logs, again.logs), swap(skips, again.skips), swap(segments, again.segments))


def write_segments(logs: DataFrame, path: str, segments: DataFrame | None = None) -> None:
    """Replaces the segments that ``logs`` has, and those of ``segments`` (segment_id), in a table partitioned by segment, in one commit of Spark: a
    segment without rows any more becomes one row without a time, which ``read_segments`` leaves out. A segment is a task for each ``FILE_ROWS`` rows. Rows get their time
    in microseconds besides, which footers sum up."""
    rows = logs.withColumn(MICROS, F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01'"), F.col("timestamp_utc")))
    if segments is not None:
        gone = segments.select("segment_id").distinct().join(logs.select("segment_id").distinct(), "segment_id", "left_anti")
        rows = rows.unionByName(gone.withColumn(MICROS, F.lit(GONE)), allowMissingColumns=True)
    rows = rows.repartition("segment_id", F.floor(F.col("record_index") / FILE_ROWS)).sortWithinPartitions("segment_id", "timestamp_utc", "record_index")
    rows.write.partitionBy("segment_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def with_metadata(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments with the size, time and hash that their files (path, size, modified, hash) have now."""
    now = files.select(F.col("path").alias("source_path"), F.lit(True).alias("_here"), F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("hash").alias("_hash"))
    both = segments.join(now, "source_path", "left")
    new = {"file_size_bytes": "_size", "last_modified_utc": "_modified", "file_hash": "_hash"}
    return both.select(*[F.when(F.col("_here"), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in segments.columns])


def started(runs: DataFrame, run: str, now) -> DataFrame:
    """The runs with a new one, going on."""
    return runs.unionByName(runs.sparkSession.createDataFrame([(run, now, None, "running")], RUNS))


def ended(runs: DataFrame, run: str, now, status: str = "completed") -> DataFrame:
    """The runs with one ended: completed, or failed."""
    this = F.col("run_id") == run
    return runs.withColumns({"completed_utc": F.when(this, F.lit(now)).otherwise(F.col("completed_utc")), "status": F.when(this, status).otherwise(F.col("status"))})


def interrupted(runs: DataFrame) -> DataFrame:
    """Runs that never ended."""
    return runs.where("completed_utc is null")


def recorded(history: DataFrame, text: str, now) -> DataFrame:
    """The history of queries (query_id, query_text, executed_utc) with one more, under the next number; blank ones aren't kept."""
    if not text.strip():
        return history
    new = history.agg((F.coalesce(F.max("query_id"), F.lit(0)) + 1).alias("query_id"))
    return history.unionByName(new.select("query_id", F.lit(text.strip()).alias("query_text"), F.lit(now).cast("timestamp_ntz").alias("executed_utc")), allowMissingColumns=True)


def incomplete_segments(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """Segments of runs that never ended, counted by run."""
    return segments.join(runs.where("status = 'running'").select(F.col("run_id").alias("last_ingest_run_id")), "last_ingest_run_id").groupBy("last_ingest_run_id").agg(F.count("*").alias("segment_count"))


def abandoned(runs: DataFrame, now) -> DataFrame:
    """Runs that never ended, marked as given up."""
    going = F.col("status") == "running"
    return runs.withColumns({"completed_utc": F.when(going, F.lit(now)).otherwise(F.col("completed_utc")), "status": F.when(going, "abandoned").otherwise(F.col("status"))})


def consistency(segments: DataFrame, logs: DataFrame) -> DataFrame:
    """Each segment's stated and actual number of rows."""
    return segments.select("segment_id", F.col("row_count").alias("stated_rows")).join(segment_statistics(logs).select("segment_id", "row_count"), "segment_id", "left").select("segment_id", "stated_rows", F.coalesce("row_count", F.lit(0)).alias("actual_rows"))
