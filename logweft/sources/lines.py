"""Text files as tables of numbered lines, archives included, and the format of each file."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweft.functions.text import SEPARATORS
from logweft.functions.times import SHAPES, TIME_FIELDS, stamp_text
from logweft.operators.running import running

#: Lines that the format of a file is told from.
SNIFFED = 2000

# Names of columns that hold a time, first ones first, and of those that hold a day and a time of day; in any case.
CSV_TIME_NAMES = ("timestamp", "datetime", "date_time", "time", "date", "ts", "@timestamp", "@t", "log_time", "logtime", "event_time", "eventtime", "created_at", "createdat", "updated_at", "updatedat")
DATE_NAMES = ("date", "log_date", "logdate")
TIME_NAMES = ("time", "log_time", "logtime")


def numbered(lines: DataFrame) -> DataFrame:
    """(path, block, at, line) as (path, line_no, byte_end, line): numbers and offsets run over a file's blocks."""
    size = F.octet_length("line").cast("long") + 1
    return running(lines, "path", F.col("block"), "at", sums={"line_no": F.lit(1), "byte_end": size}).select("path", "line_no", "byte_end", "line")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """UTF-8 text files, split by Spark into blocks, as numbered lines."""
    text = spark.read.text(list(paths))
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^﻿|\r$", "").alias("line"))
    return numbered(rows)


# The characters that Windows-1252 has at 80 to 9F, and those that stand for these bytes otherwise.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CONTROLS = "".join(map(chr, (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F)))


def decoded(content: Column) -> Column:
    """Bytes as text: by their byte order mark, else as UTF-8 if they are valid, else as Windows-1252."""
    head = F.hex(F.substring(content, 1, 3))
    utf16 = lambda kind: F.decode(F.substring(content, 3, 2**31 - 1), kind)
    western = F.translate(F.decode(content, "ISO-8859-1"), CONTROLS, WINDOWS)
    return F.when(head == "EFBBBF", F.decode(F.substring(content, 4, 2**31 - 1), "UTF-8")).when(head.startswith("FFFE"), utf16("UTF-16LE")).when(head.startswith("FEFF"), utf16("UTF-16BE")).when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(western)


def unzipped(files: DataFrame) -> DataFrame:
    """(path, content) of archives as (path, content, problem): each entry as ``archive!/entry``. Archives in archives and
    damaged entries come with a problem and without content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content or b""))
                except (zipfile.BadZipFile, OSError, ValueError):
                    yield pa.RecordBatch.from_pylist([{"path": path, "problem": "ZipEntryCorrupt"}], schema)
                    continue
                for entry in archive.infolist():
                    name, data, problem = f"{path}!/{entry.filename}", None, None
                    if entry.is_dir():
                        continue
                    if entry.filename.lower().endswith(".zip"):
                        problem = "NestedArchive"
                    else:
                        try:
                            data = archive.read(entry)
                        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError):
                            problem = "ZipEntryCorrupt"
                    yield pa.RecordBatch.from_pylist([{"path": name, "content": data, "problem": problem}], schema)

    return files.select("path", "content").mapInArrow(run, "path string, content binary, problem string")


#: Files up to this size are hashed.
HASHED_BYTES = 50 << 20


def hashed(files: DataFrame) -> DataFrame:
    """(path, content) with ``hash``: the SHA-256 of what a file holds; null for files above ``HASHED_BYTES``."""
    return files.withColumn("hash", F.when(F.octet_length("content") <= HASHED_BYTES, F.sha2("content", 256)))


def content_lines(files: DataFrame) -> DataFrame:
    """(path, content) as numbered lines, in any of the encodings that ``decoded`` tells."""
    text = F.regexp_replace(decoded(F.col("content")), "\r\n", "\n")
    lines = files.where("content is not null").select("path", F.posexplode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("at", "line"))
    return numbered(lines.withColumn("block", F.floor(F.col("at") / 100_000)))


def head_lines(lines: DataFrame, most: int = SNIFFED) -> DataFrame:
    """Each file's first lines that aren't blank, numbered by ``k``, wherever they stand: stretches that begin after so many
    are left out by their counts, so no task sorts a whole file."""
    stretch = F.floor(F.col("line_no") / 4000)
    some = lines.where(F.trim("line") != "").withColumn("_s", stretch)
    earlier = Window.partitionBy("path").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = some.groupBy("path", "_s").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    near = some.join(counts.where(F.col("before") < most).select("path", "_s"), ["path", "_s"]).drop("_s")
    return near.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("line_no"))).where(F.col("k") <= most)


def read_time(text: str) -> float | None:
    """A timestamp's seconds, bare times as if in UTC; None for text that ``with_utc`` can't read. Tells formats of files."""
    raw = " ".join(text.split())
    if re.fullmatch(r"\d{10}(?:\.\d+)?|\d{13}", raw):
        return float(raw) / (1000 if len(raw) == 13 else 1)
    s = re.sub(r"(?<=:\d\d),(?=\d)", ".", raw).replace("/", "-")
    try:
        if re.match(r"\d{4}-\d{2}-\d{2}(?:$|[T ]\d{2}:)", s):
            at = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", s).replace(". ", " ").rstrip("."))
            return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()
    except ValueError:
        return None
    for form in PYTHON_FORMATS if s[:1].isdigit() or s[:1].isupper() else ():
        try:
            at = datetime.strptime(f"2024 {raw}" if form.startswith("%Y %b") else raw if "%b" in form else s, form)
        except ValueError:
            continue
        return (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()
    return None


#: The formats of ``with_utc`` besides ISO 8601.
PYTHON_FORMATS = ("%y-%m-%d %H:%M:%S", "%y-%m-%d %H:%M:%S.%f", "%m-%d-%y %H:%M:%S", "%d-%m-%y %H:%M:%S", "%m-%d-%Y %H:%M:%S", "%m-%d-%Y %H:%M:%S.%f", "%d-%m-%Y %H:%M:%S", "%d-%m-%Y %H:%M:%S.%f", "%m-%d-%Y", "%d-%m-%Y", "%d/%b/%Y:%H:%M:%S %z", "%Y %b %d %H:%M:%S")


def cut(line: str, sep: str) -> list[str]:
    """The cells of a line as ``cells`` cuts them."""
    if '"' not in line:
        return line.split(sep)
    out, held, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if c == '"':
            if quoted and line[i + 1 : i + 2] == '"':  # doubled inside quotes
                held.append(c)
                i += 1
            else:
                quoted = not quoted
        elif c == sep and not quoted:
            out.append("".join(held))
            held = []
        else:
            held.append(c)
        i += 1
    return [*out, "".join(held)]


def share(values: list[str], most: int | None = None) -> float:
    """The part of the first values that are times; 0 without any."""
    some = values[:most]
    return sum(read_time(v) is not None for v in some) / len(some) if some else 0.0


def ndjson_probe(lines: list[str]) -> dict | None:
    """Five lines at least, 95 % of them objects: half for the objects, half for those whose time field can be read."""
    objects = []
    for line in lines:
        try:
            value = json.loads(line)
        except ValueError:
            continue
        if isinstance(value, dict):
            objects.append({k: v if isinstance(v, str) else json.dumps(v) for k, v in value.items()})
    rate = len(objects) / len(lines)
    if len(lines) < 5 or rate < 0.95:
        return None
    field = next((n for n in TIME_FIELDS if any(n in x for x in objects) and share([x.get(n, "") for x in objects], 10) >= 0.8), None)
    sure_of = 0.5 * rate + 0.5 * (share([x.get(field, "") for x in objects]) if field else 0.0)
    return {"format": "ndjson", "confidence": 0.9 * rate if sure_of < 0.4 else sure_of, "time_fields": [field] if field else None}


def csv_probe(lines: list[str]) -> dict | None:
    """The delimiter whose most common number of cells is most common (95 % at least, two cells), a header by its letters,
    and the column, or the day's and the time's column, whose cells can be read as times (95 %)."""
    if len(lines) < 5:
        return None
    best = (0.0, 0.0, "", [])
    for name, sep in SEPARATORS.items():
        rows = [cut(line, sep) for line in lines]
        sizes = Counter(map(len, rows))
        rate, wide = max(sizes.values()) / len(rows), sum(map(len, rows)) / len(rows)
        if len(rows[0]) >= 2 and (rate > best[0] or (abs(rate - best[0]) < 0.01 and wide > best[1])):
            best = (rate, wide, name, rows)
    rate, wide, delimiter, rows = best
    if rate < 0.95 or wide < 2:
        return None
    number = lambda c: re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", c) is not None
    word = lambda c, more="": all(x.isalpha() or x in "_ " + more for x in c)
    top, second = ([c.strip() for c in r if c.strip()] for r in rows[:2])
    words, data_words = sum(word(c, "@") for c in top), sum(word(c) for c in second)
    data_numbers = sum(not word(c) and (number(c) or read_time(c) is not None) for c in second)
    header = len(rows[0]) == len(rows[1]) and words > sum(map(number, top)) and (words > data_words or data_numbers > data_words)
    names = rows[0] if header else [f"Column{i}" for i in range(len(rows[0]))]
    data = [r for r in rows[header:] if len(r) == len(names)]
    first = [r for r in rows[header : header + 10] if len(r) == len(names)]
    low = [n.lower() for n in names]
    day, hour = (next((i for i, n in enumerate(low) if n in known), None) for known in (DATE_NAMES, TIME_NAMES))
    tried = [[day, hour]] if day is not None and hour is not None else []
    tried += [[low.index(n)] for n in CSV_TIME_NAMES if n in low] + [[i] for i in range(len(names))]
    value = lambda r, at: " ".join(c for i in at if (c := r[i].strip()))
    fields = next((at for at in tried if share([value(r, at) for r in first]) >= 0.8), None)
    times = share([value(r, fields) for r in data]) if fields else 0.0
    if times < 0.95:
        return None
    return {"format": "csv", "confidence": rate * 0.4 + times * 0.6, "delimiter": delimiter, "header": bool(header), "names": names, "time_fields": [names[i] for i in fields]}


def text_probe(lines: list[str]) -> dict | None:
    """Twenty lines at least: of the shapes that half of the lines begin with, 0.7 for their part, and 0.3 more if their times
    never fall by over two seconds."""
    best = None
    for shape, pattern in SHAPES.items() if len(lines) >= 20 else ():
        find = re.compile(pattern.replace("?<ts>", "?P<ts>")).match
        found = [m["ts"] for line in lines if (m := find(line))]
        if len(found) < 0.5 * len(lines):
            continue
        times = [x for t in found if (x := read_time(t)) is not None]
        sure_of = 0.7 * len(found) / len(lines) + 0.3 * all(b >= a - 2 for a, b in zip(times, times[1:]))
        if best is None or sure_of > best["confidence"]:
            best = {"format": "text", "confidence": sure_of, "shape": shape}
    return best


def told_format(lines: list[str]) -> dict:
    """The format of a file with these first lines that aren't blank; of equally sure ones ndjson comes before csv, csv before text."""
    found = sorted(filter(None, (f(lines) for f in (ndjson_probe, csv_probe, text_probe))), key=lambda x: -x["confidence"])
    best = found[0] if found else {"format": "unknown", "confidence": 0.0}
    return best | {"ambiguous": len(found) > 1 and found[0]["confidence"] - found[1]["confidence"] < 0.02}


DETECTED = "path string, format string, confidence double, ambiguous boolean, delimiter string, header boolean, names array<string>, time_fields array<string>, shape string"


def detected(lines: DataFrame) -> DataFrame:
    """The format of each file that has a line which isn't blank, from its first lines: path, format (ndjson, csv, text or
    unknown), confidence, ambiguous (another format comes within 0.02), and what reading takes: delimiter, header, names,
    time_fields, shape. Of equally sure formats ndjson comes before csv, csv before text. A file's first ``SNIFFED`` lines
    meet in one task."""
    columns = [c.split()[0] for c in DETECTED.split(", ")]

    def probe(rows: pd.DataFrame) -> pd.DataFrame:
        best = told_format(rows.sort_values("k")["line"].tolist())
        return pd.DataFrame([[(best | {"path": rows["path"].iloc[0]}).get(c) for c in columns]], columns=columns)

    return head_lines(lines).select("path", "k", "line").groupBy("path").applyInPandas(probe, DETECTED)


#: Confidence from which a file is read without asking.
SURE = 0.95


def sure(formats: DataFrame) -> DataFrame:
    """The files that can be read without asking: one format, told with confidence."""
    return formats.where((F.col("format") != "unknown") & ~F.col("ambiguous") & (F.col("confidence") >= SURE))


def preview(lines: DataFrame, n: int = 5) -> DataFrame:
    """The first lines of each file that aren't blank, with the timestamp each begins with."""
    return head_lines(lines, n).select("path", "line_no", "line", stamp_text(F.col("line")).alias("stamp"))
