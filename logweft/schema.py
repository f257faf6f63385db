"""The shape of the fact table ``logs`` and an adapter from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

LOGS = StructType(
    [
        StructField("timestamp_utc", TimestampNTZType(), False),
        StructField("timestamp_basis", StringType(), False),
        StructField("timestamp_effective_offset_minutes", IntegerType(), False),
        StructField("timestamp_original", StringType()),
        StructField("logical_source_id", StringType(), False),
        StructField("source_path", StringType(), False),
        StructField("physical_file_id", StringType(), False),
        StructField("segment_id", StringType(), False),
        StructField("ingest_run_id", StringType(), False),
        StructField("record_index", LongType(), False),
        StructField("level", StringType()),
        StructField("message", StringType(), False),
        StructField("fields", StringType()),
    ]
)
COLUMNS = LOGS.fieldNames()
#: The total order of ``logs``.
KEY = ["timestamp_utc", "segment_id", "record_index"]

SKIPS = StructType(
    [
        StructField("logical_source_id", StringType(), False),
        StructField("segment_id", StringType(), False),
        StructField("segment_seq", LongType(), False),
        StructField("start_line", LongType()),
        StructField("end_line", LongType()),
        StructField("start_offset", LongType()),
        StructField("end_offset", LongType()),
        StructField("reason_code", StringType(), False),
        StructField("reason_detail", StringType()),
        StructField("sample_prefix", BinaryType()),
    ]
)


def logs_of_events(events: DataFrame) -> DataFrame:
    """``events`` seen as log rows."""
    event = F.col("event_type")
    level = F.when(event == "error", "ERROR").when(event == "purchase", "WARN").when(event == "signup", "INFO").when(event == "view", "DEBUG")
    return events.select(
        F.col("ts").cast("timestamp_ntz").alias("timestamp_utc"),
        F.lit("Utc").alias("timestamp_basis"),
        F.lit(0).alias("timestamp_effective_offset_minutes"),
        F.lit(None).cast("string").alias("timestamp_original"),
        F.concat(F.lit("source-"), (F.col("user_id") % 3).cast("string")).alias("logical_source_id"),
        F.lit("events.parquet").alias("source_path"),
        F.lit("events").alias("physical_file_id"),
        F.concat(F.lit("seg-"), (F.col("event_id") % 2).cast("string")).alias("segment_id"),
        F.lit("run-0").alias("ingest_run_id"),
        F.col("event_id").alias("record_index"),
        level.alias("level"),
        F.concat(F.lit("Event #"), F.col("event_id").cast("string"), F.lit(": "), event, F.lit(" props "), F.col("props")).alias("message"),
        F.col("props").alias("fields"),
    )
