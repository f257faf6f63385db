"""Sinks: logs as CSV, JSON Lines and Parquet, in key order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweft.functions.text import csv_cell
from logweft.operators.filters import LogFilter
from logweft.schema import COLUMNS, KEY
from logweft.sources.sink import write_sink

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0'"


def ordered(logs: DataFrame, flt: LogFilter = LogFilter()) -> DataFrame:
    """Rows in key order, by ranges: each file holds a range, files are named in order."""
    return logs.where(flt.column()).select(*COLUMNS).orderBy(*KEY)


def csv_lines(logs: DataFrame, *keep: str) -> DataFrame:
    """Lines of CSV: quoted only where it must be, null as empty, times with seven fractional digits."""
    cells = [csv_cell(F.date_format(c, STAMP) if c == "timestamp_utc" else F.col(c).cast("string")) for c in COLUMNS]
    return logs.select(*keep, F.concat_ws(",", *cells).alias("value"))


def json_lines(logs: DataFrame) -> DataFrame:
    """Lines of JSON: all keys, null where there is no value, ``fields`` as JSON where it is, else as text."""
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))

    def value(name: str):
        if name == "timestamp_utc":
            return F.concat(F.lit('"'), F.date_format(name, STAMP), F.lit('"'))
        if name == "fields":
            return F.when(F.try_parse_json(name).isNotNull(), F.col(name)).when(F.col(name).isNotNull(), quoted(F.col(name))).otherwise(F.lit("null"))
        if name in ("record_index", "timestamp_effective_offset_minutes"):
            return F.coalesce(F.col(name).cast("string"), F.lit("null"))
        return F.when(F.col(name).isNull(), "null").otherwise(quoted(F.col(name)))

    pairs = [F.concat(F.lit(f'"{c}":'), value(c)) for c in COLUMNS]
    return logs.select(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")).alias("value"))


def export(logs: DataFrame, path: str, kind: str, flt: LogFilter = LogFilter(), about: dict[str, str] | None = None) -> None:
    """Writes a folder of files in key order, which appear together: ``csv`` with a header in the first, ``jsonl``, or ``parquet``. ``about``
    is in the footer of each Parquet file, else in ``_metadata.json`` beside the files."""
    rows = ordered(logs, flt)
    said = {"kind": kind, "about": json.dumps(about or {})}
    if kind == "parquet":
        write_sink(rows, path, **said)
    elif kind == "csv":
        write_sink(csv_lines(rows), path, header=",".join(COLUMNS), **said)
    else:
        write_sink(json_lines(rows), path, **said)
