"""String, hash and level functions, each an expression that Spark compiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Synonyms of the levels.
LEVELS = {
    "TRACE": ("TRACE", "TRC", "VERBOSE", "VRB"),
    "DEBUG": ("DEBUG", "DBG", "FINE"),
    "INFO": ("INFO", "INF", "INFORMATION"),
    "WARN": ("WARN", "WRN", "WARNING"),
    "ERROR": ("ERROR", "ERR"),
    "FATAL": ("FATAL", "FTL", "CRITICAL", "CRI"),
}


def normal_level(level: Column) -> Column:
    """Upper case, synonyms as one name; blank as null."""
    up = F.upper(F.trim(level))
    named = reduce(lambda c, kv: c.when(up.isin(*kv[1]), kv[0]), LEVELS.items(), F.when(up == "", F.lit(None).cast("string")))
    return named.otherwise(up)


def short_id(*parts: Column) -> Column:
    """The first 16 hexadecimal characters of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def file_id(path: Column, size: Column, modified: Column) -> Column:
    """Identity of a file by path, size and time of change (a UTC timestamp)."""
    stamp = F.concat(F.date_format(modified.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))
    return short_id(path, size.cast("string"), stamp)


def segment_id(physical: Column, region: int = 0) -> Column:
    return short_id(physical, F.lit(str(region)))


def logical_source(path: Column) -> Column:
    """The file's name without folder, extension and timestamps; the full name where nothing is left."""
    name = F.regexp_extract(path, r"[^/\\!]*$", 0)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    bare = F.regexp_replace(stem, r"\d{4}[-_. T]?\d{2}[-_. T]?\d{2}(?:[-_. T]?\d{2}[-_.: ]?\d{2}(?:[-_.: ]?\d{2})?)?", "")
    bare = F.regexp_replace(bare, r"\d{8,14}", "")
    bare = F.regexp_replace(bare, r"^[-_. ]+|[-_. ]+$", "")
    return F.when(bare == "", name).otherwise(bare)


def like_literal(text: str) -> str:
    """A LIKE pattern for the text itself: wildcards and backslashes are escaped."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_text(column: Column, text: str) -> Column:
    """Whether the text occurs, in any case; a percent sign or underscore stands for itself."""
    return column.ilike(f"%{like_literal(text)}%")


def contains_pattern(column: Column, text: str) -> Column:
    """Whether the text occurs, in any case, where percent sign and underscore are wildcards and backslashes are plain."""
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}


def cells(line: Column, separator: str = ",") -> Column:
    """The cells of a CSV line: quotes may stand anywhere, doubled ones inside quotes are one, an open one runs to the end."""
    sep = "\\" + separator if separator in "|." else separator
    found = F.regexp_extract_all(F.concat(F.lit(separator), line), F.lit(f'{sep}((?:[^"{sep}]++|"(?:[^"]++|"")*+(?:"|$))*+)'), F.lit(1))
    return F.transform(found, lambda c: F.when(F.contains(c, F.lit('"')), F.replace(F.regexp_replace(c, '"((?:[^"]++|"")*+)(?:"|$)', "$1"), F.lit('""'), F.lit('"'))).otherwise(c))


def csv_cell(value: Column) -> Column:
    """A cell as CSV writes it: quoted where it must be, empty for null."""
    return F.when(value.isNull(), "").when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def fuzzy(column: Column, typed: str) -> Column:
    """Whether the typed letters occur in this order, in any case."""
    escaped = ["\\" + c if not c.isalnum() else c for c in typed.lower()]
    return F.lower(column).rlike(".*".join(escaped)) if typed else F.lit(True)


def preview(column: Column, size: int = 80) -> Column:
    return F.when(F.length(column) > size, F.concat(F.substring(column, 1, size), F.lit("…"))).otherwise(column)


# Reasons of skipped regions that count as errors.
ERROR_REASONS = ("DecodeError", "IOError", "ZipEntryCorrupt", "Abandoned")


def is_error(reason: Column) -> Column:
    """Whether a skipped region's reason counts as an error."""
    return reason.isin(*ERROR_REASONS)


def folder_name(title: Column, created: Column) -> Column:
    """A session's folder: its time, and the title without characters that file systems refuse."""
    safe = F.substring(F.regexp_replace(F.trim(title), r'[\\/:*?"<>|\s\p{Cntrl}]+', "_"), 1, 60)
    return F.concat(F.date_format(created, "yyyyMMdd_HHmmss"), F.lit("_"), safe)


def field_of(fields: Column, name: str) -> Column:
    """A member of ``fields`` (JSON text) by name, as text; null where there is none. The name is taken as it is, dots and all."""
    return F.try_variant_get(F.try_parse_json(fields), "$[" + "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "string")


def string_fields(fields: Column) -> Column:
    """A map of strings as JSON text; null where it is empty."""
    return F.when(F.size(fields) > 0, F.to_json(fields))
