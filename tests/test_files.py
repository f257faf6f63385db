"""Files of four encodings, cut anywhere; archives; and ingest from paths against ingest from lines."""

import io
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logweft.operators import ingest
from logweft.operators.ingest_files import ingest_files
from logweft.sources import files, sink
from logweft.sources.lines import content_lines

ENCODINGS = {"utf-8": b"", "utf-8-sig": b"", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff", "cp1252": b""}


def content(text: str, encoding: str) -> bytes:
    return ENCODINGS[encoding] + text.encode(encoding)


def by_ranges(data: bytes, size: int, chunk: int):
    """The lines as ranges of ``size`` bytes have them, read ``chunk`` bytes at a time."""
    encoding, mark = files.encoding_of(data[: files.TELLING])
    unit = 2 if mark == 2 else 1
    out = []
    cuts = list(range(0, max(len(data), 1), size - size % 2))
    for a, b in zip(cuts, [*cuts[1:], None]):
        source = io.BytesIO(data)
        source.seek(max(a - unit, mark) if a > mark else mark)
        for _, part, ends in files.whole_lines(source, a, b, mark, encoding, chunk):
            lines = files.lines_of(part, encoding)
            assert len(lines) == len(ends)
            out += zip(lines, ends.tolist())
    return out


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_lines_wherever_they_are_cut(encoding):
    dice = random.Random(encoding)
    for _ in range(60):
        lines = ["".join(dice.choice("ab€é ") for _ in range(dice.randrange(12))) for _ in range(dice.randrange(1, 14))]
        text = "€" + "".join(line + dice.choice(["\n", "\r\n", "\r"]) for line in lines) + dice.choice(["", "last"])
        data = content(text, encoding)
        want = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n").split("\n")
        for size in (2, 4, 10, 34, 10_000):
            for chunk in (2, 6, 1000):
                got = by_ranges(data, size, chunk)
                assert [x for x, _ in got] == want, (text, size, chunk)
                assert got[-1][1] == len(data)


def test_encodings_are_told():
    assert files.encoding_of("é".encode("utf-8")) == ("utf-8", 0)
    assert files.encoding_of("é x".encode("cp1252")) == ("windows-1252", 0)
    assert files.encoding_of(("x" * 8191 + "é").encode()[:8192]) == ("utf-8", 0)
    assert files.encoding_of(b"") == ("utf-8", 0)
    assert files.encoding_of(b"\xef\xbb\xbfa") == ("utf-8", 3)
    assert files.text_of(b"\x80\x81", "windows-1252") == "€\x81"


def stamped(k: int) -> str:
    return f"2024-03-{1 + k // 1440 % 28:02d} {k // 60 % 24:02d}:{k % 60:02d}:00"


def some_files(dice: random.Random) -> dict[str, bytes]:
    """Text with continuation lines and unread times, CSV and NDJSON with damage, prose, an empty file."""
    text = ["garbage first"]
    for k in range(90):
        text.append(f"{stamped(k) if k % 17 else '2024-99-99 10:00:00'} {dice.choice(['INFO', 'wrn [a]', 'err [a] [b]'])} event {k} é")
        text += [f"  at frame {j}" for j in range(dice.choice([0, 0, 0, 0, 1, 3]))]
    csv = ["level,message,time,message"] + [f"info,\"m, {k}\",{stamped(k)},last {k}" if k % 50 != 20 else "x,y" for k in range(150)]
    csv[7] = "info,unread,nothing,last"
    ndjson = [f'{{"ts": "{stamped(k)}", "msg": "a", "n": 1.50, "msg": "m{k}", "o": {{"x":  [1, 2]}}}}' if k % 40 else "{broken" for k in range(120)]
    end = dice.choice(["\n", "\r\n"])
    return {"app-2024-01-01.log": end.join(text), "b.csv": end.join(csv) + end, "c.ndjson": end.join(ndjson), "d.txt": "some\nprose\n" * 30, "e.log": ""}


LOG = ["logical_source_id", "record_index", "timestamp_utc", "level", "message", "fields", "timestamp_original"]
SKIP = ["logical_source_id", "segment_seq", "start_line", "end_line", "reason_code", "reason_detail", "sample_prefix"]


def rows(df, columns):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("encoding, size", [("utf-16-le", 300), ("cp1252", 10**6)])
def test_from_paths_as_from_lines(spark, tmp_path, encoding, size):
    found = {name: content(text, encoding) for name, text in some_files(random.Random(size)).items()}
    for name, data in found.items():
        (tmp_path / name).write_bytes(data)
    got = ingest_files(spark, str(tmp_path), run="r", range_bytes=size)
    table = spark.createDataFrame([(f"/x/{n}", d) for n, d in found.items()], "path string, content binary")
    names = table.select("path")
    want = ingest.ingest(content_lines(table), "r", files=names)
    assert rows(got.logs, LOG) == rows(want.logs, LOG)
    assert rows(got.skips, SKIP) == rows(want.skips, SKIP)
    assert {r.reason_code for r in got.skips.collect()} == {"TimeParse", "CsvColumnMismatch", "JsonMalformed", "NotRecognized"}
    counts = ["logical_source_id", "row_count", "min_ts_utc", "max_ts_utc"]
    assert rows(got.segments, counts) == rows(want.segments, counts)
    assert {r.last_byte_offset for r in got.segments.where("row_count > 0").collect()} == {len(d) for n, d in found.items() if n[0] in "abc"}


def test_long_records_across_ranges(spark, tmp_path):
    """A record of more lines than it may have, over many ranges, then one of few."""
    lines = [*(f"{stamped(k)} INFO {k}" for k in range(30)), *(f"  line {k}" for k in range(5000)), f"{stamped(40)} INFO end", "  more"]
    (tmp_path / "a.log").write_text("\n".join(lines))
    for size in (777, 10**6):
        messages = {r.record_index: r.message for r in ingest_files(spark, str(tmp_path), run="r", range_bytes=size).logs.collect()}
        assert len(messages) == 31
        assert messages[29] == "\n".join(["29", *lines[30 : 30 + ingest.LOOKAHEAD]])
        assert messages[30] == "end\n  more"


def test_given_up_files(spark, tmp_path):
    good = [f"{stamped(k)},info" for k in range(2000)]
    (tmp_path / "a.csv").write_text("\n".join(["time,level", *good, *["x"] * 12_000, *good]))
    got = ingest_files(spark, str(tmp_path), run="r", range_bytes=5000)
    assert got.logs.count() == 2000
    assert [(r.start_line, r.end_line, r.reason_code) for r in got.skips.orderBy("segment_seq").collect()] == [(2002, 12001, "CsvColumnMismatch"), (12001, 12001, "Abandoned")]


def test_archives_and_files_that_cant_be_read(spark, tmp_path):
    text = "\n".join(f"{stamped(k)} INFO event {k}" for k in range(4000))
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr("in/app.log", text)
        box.writestr("in/app.log/", "")
        box.writestr("more.zip", b"x")
        box.writestr("win.log", content(text.replace("event", "é"), "utf-16-le"))
        box.writestr(zipfile.ZipInfo("late.log"), random.Random(1).randbytes(400_000).hex())
        box.writestr("late2.log", "\n".join(f"{stamped(k)} INFO {random.Random(k).random()}" for k in range(30_000)))
    data = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(tmp_path / "a.zip") as box:
        late = box.getinfo("late2.log").header_offset + 300_000
    data[late : late + 40] = bytes(40)
    (tmp_path / "a.zip").write_bytes(data)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "odd.log").write_bytes(b"\xff\xfea\x00\x00\xd8b\x00")
    (tmp_path / "ok.log").write_text(text)
    got = ingest_files(spark, str(tmp_path), str(tmp_path / "absent.log"), run="r", range_bytes=10_000)
    counts = {Path(r.source_path).name: r.row_count for r in got.segments.collect()}
    assert counts == {"app.log": 4000, "more.zip": 0, "win.log": 4000, "late.log": 0, "late2.log": 0, "bad.zip": 0, "odd.log": 0, "absent.log": 0, "ok.log": 4000}
    assert sorted((r.logical_source_id, r.reason_code) for r in got.skips.collect()) == [
        ("absent", "IOError"), ("bad", "ZipEntryCorrupt"), ("late", "NotRecognized"), ("late2", "ZipEntryCorrupt"), ("more", "NestedArchive"), ("odd", "DecodeError")]
    assert got.logs.where(F.col("source_path").endswith("win.log")).select("message").first().message.startswith("é ")


def test_formats_may_be_given(spark, tmp_path):
    (tmp_path / "few.csv").write_text("when;what\n2024-01-01 00:00:00;a\n")
    assert ingest_files(spark, str(tmp_path), run="r").logs.count() == 0
    given = spark.createDataFrame([(str(tmp_path / "few.csv"), "csv", "semicolon", True, ["when", "what"], ["when"])], "path string, format string, delimiter string, header boolean, names array<string>, time_fields array<string>")
    (row,) = ingest_files(spark, str(tmp_path), run="r", formats=given).logs.collect()
    assert (str(row.timestamp_utc), row.message) == ("2024-01-01 00:00:00", "2024-01-01 00:00:00;a")


def test_heads_dont_grow_with_files(tmp_path):
    big = tmp_path / "big.log"
    big.write_text("\n".join(f"{stamped(k)} INFO x" for k in range(40_000)))
    read = []

    class Counted(io.FileIO):
        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    real, files.opened = files.opened, lambda path: Counted(path)
    try:
        (row,) = files.HeadReader({"paths": f'["{big}"]'}).read(files.Files([(str(big), big.stat().st_size, 0.0)]))
    finally:
        files.opened = real
    assert read == [files.HEAD] and row[1] == "text"


def test_no_files(spark, tmp_path):
    got = ingest_files(spark, str(tmp_path), run="r")
    assert (got.logs.count(), got.skips.count(), got.segments.count()) == (0, 0, 0)


@pytest.mark.parametrize("encoding", ENCODINGS)
def test_a_file_is_sorted_by_many_tasks(spark, tmp_path, monkeypatch, encoding):
    """Ranges of a file's lines are written by tasks of their own, and its bytes are those of one writer."""
    lines = {name: [f"é {name} {k}" for k in range(n)] for name, n in (("a.log", 500), ("in/b.log", 40), ("c.log", 1))}
    table = spark.createDataFrame([(name, k, x) for name, some in lines.items() for k, x in enumerate(some)], "file string, at long, line string").orderBy(F.rand(3))
    seen, real = [], sink.write_sink

    def spied(rows, path, **options):
        seen.append((options["kind"], rows.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]))
        real(rows, path, **options)

    monkeypatch.setattr(sink, "write_sink", spied)
    monkeypatch.setattr(sink, "PART_LINES", 50)
    sink.write_lines(table, str(tmp_path / "out"), "at", encoding)
    mark = {"utf-8-sig": b"\xef\xbb\xbf"}.get(encoding, ENCODINGS[encoding])
    assert {name: (tmp_path / "out" / name).read_bytes() for name in lines} == {name: mark + "".join(f"{x}\n" for x in some).encode(encoding.removesuffix("-sig")) for name, some in lines.items()}
    assert [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_")] == []
    assert seen[0][0] == "parts" and seen[0][1] < 250


def test_small_ranges_share_tasks():
    """Tasks grow with the bytes, not with the number of ranges."""
    options = {"files": '[["/a.log", null, null, 100000]]', "range": "100", "task": "50000"}
    tasks = [t.ranges for t in files.LineReader(options).partitions()]
    assert [len(t) for t in tasks] == [500, 500] and [r[3] for t in tasks for r in t] == list(range(0, 100_000, 100))


def test_archives_are_cut(spark, tmp_path):
    """An archive is written from sorted ranges of its entry's lines, and the entry is read by ranges of which none has all of it."""
    lines = [f"{stamped(k)} INFO é {k}" for k in range(3000)]
    table = spark.createDataFrame([(name, "in/app.log", k, x) for name in ("0.zip", "1.zip") for k, x in enumerate(lines)], "file string, entry string, at long, line string").orderBy(F.rand(3))
    sink.write_archives(table.union(spark.sql("select '0.zip', 'more.zip', 0L, 'x'")), str(tmp_path), "at")
    with zipfile.ZipFile(tmp_path / "0.zip") as box:
        assert box.namelist() == ["in/app.log", "more.zip"] and box.testzip() is None
        entry = box.getinfo("in/app.log")
        assert box.read(entry).decode().splitlines() == lines
    tasks = files.LineReader({"files": f'[["a", "{tmp_path / "0.zip"}", {entry.header_offset}, {entry.file_size}]]', "range": "20000"})
    found = [[x for b in tasks.read(t) for x in b.column("line").to_pylist() if x is not None] for t in tasks.partitions()]
    assert len(found) > 3 and max(map(len, found)) < 1500 and [x for some in found for x in some] == lines
