"""Lines of JSON as maps of strings, each value in the text that the line has."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

BLANK = re.compile(r"[ \t\n\r]*").match


def _refused(name: str):
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_refused)


def _plain(text: str) -> str:
    """Text without half surrogate pairs."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def raw_fields(line: str | None) -> dict[str, str] | None:
    """The members of an object: strings as they read, null as empty, all else as it is written; of one name the last. None for
    what isn't one object."""
    try:
        at = BLANK(line or "", 0).end()
        if (line or "")[at : at + 1] != "{":
            return None
        out: dict[str, str] = {}
        at = BLANK(line, at + 1).end()
        more = line[at : at + 1] != "}"
        while more:
            if line[at : at + 1] != '"':
                return None
            name, at = scanstring(line, at + 1, True)
            at = BLANK(line, at).end()
            if line[at : at + 1] != ":":
                return None
            begin = BLANK(line, at + 1).end()
            value, at = _DECODER.raw_decode(line, begin)
            out[_plain(name)] = _plain(value) if isinstance(value, str) else "" if value is None else line[begin:at]
            at = BLANK(line, at).end()
            more = line[at : at + 1] == ","
            at = BLANK(line, at + 1).end() if more else at
        return out if line[at : at + 1] == "}" and BLANK(line, at + 1).end() == len(line) else None
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(MapType(StringType(), StringType()))
def json_fields(line: pa.Array) -> pa.Array:
    """``raw_fields`` of each line."""
    found = [raw_fields(x) for x in line.to_pylist()]
    return pa.array([None if f is None else list(f.items()) for f in found], pa.map_(pa.string(), pa.string()))
