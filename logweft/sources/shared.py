"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, where the session names no shared folder (tests, a laptop).
LOCAL_SHARED = "file:///tmp/logweft-shared"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a cluster without it is refused, as each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = told.get() if told.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = LOCAL_SHARED
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a folder that doesn't exist yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
