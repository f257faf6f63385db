"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode, where the session names no shared folder (tests, a laptop).
LOCAL_SHARED = "file:///tmp/logweft-shared"
#: A slice of an Arrow batch that Python works on ends after so many rows, or with the row that reaches so many bytes.
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` or ``setCheckpointDir`` names it. Without
    either, a cluster has no such folder: each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        told = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = told.get() if told.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = LOCAL_SHARED
    return named.rstrip("/")


#: Whether the shuffle files of a query go as soon as it ends, instead of when the driver collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str, cleaned: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: cuts its lineage, and a lost executor loses nothing. With ``cleaned``, the shuffle files
    of writing it go at once, so that those of one step don't lie beside those of the next."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", spark.conf.get(CLEANED, "false")
    if cleaned:
        spark.conf.set(CLEANED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made, once nothing reads it any more."""
    spark = df.sparkSession
    hadoop = spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that is never a broadcast. Spark tells a table's size by its compressed files, of the columns that are read by
    their share: so it would broadcast tables that take ten times its bound and more in the driver."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str) -> Column:
    """Identity of a text, 128 bits; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def id_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def sampled(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """At most ``most`` rows, those of least hash of their key. A bound on the hash, from the number of rows, comes first:
    so a task hands on its share of the sample, not a sample of its own."""
    n, least = rows.count(), F.xxhash64(*key)
    few = rows.where(least < int(-(2**63) + 2**64 * 1.2 * most / n)) if n > 2 * most else rows
    return few.orderBy(least, *key).limit(most)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``SLICE_ROWS`` rows, each closed by the row whose strings and bytes reach ``most`` bytes."""
    ends = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            ends += np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = min(at + SLICE_ROWS, int(np.searchsorted(ends, done + most)) + 1, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def released() -> None:
    """Gives back to the system what a task has freed. Spark keeps its Python workers, which would else hold the most that any task took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


#: The most that Spark puts into an Arrow batch for Python; its own bound of 64 MB is held by each task's JVM side and by its worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def python_step(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``run`` over Arrow batches that end with the row that reaches ``SLICE_BYTES``. The bound is the session's from here on, as the
    plan reads it when it runs; a smaller one stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_BYTES).rstrip("b")) <= SLICE_BYTES:
        conf.set(BATCH_BYTES, str(SLICE_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)  # what it held is free as it ends
        released()

    return df.mapInArrow(whole, schema)


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., list]], arrow: bool = False, most: int = SLICE_BYTES) -> DataFrame:
    """Python over Arrow batches: ``make()`` runs once a task and gives a function of the batch's columns (lists of Python
    values, or Arrow arrays) that returns the output columns, as lists or Arrow arrays, in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, most):  # a slice at a time bounds what Python holds
                got = f(*(part.columns if arrow else (c.to_pylist() for c in part.columns)))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(got, out, strict=True)], schema=out)

    return python_step(df, run, schema)


def change_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], tuple[list | None, list | None]]]) -> DataFrame:
    """``df`` with all its columns. ``make()`` runs once a task and gives a function of the values of ``column`` that
    returns new values, or None to leave them, and marks of the rows that stay, or None for all."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                values, stay = f(part.columns[at].to_pylist())
                if values is not None:
                    part = part.set_column(at, part.schema.field(at), pa.array(values, part.schema.field(at).type))
                yield part if stay is None else part.filter(pa.array(stay, pa.bool_()))

    return python_step(df, run, df.schema)
