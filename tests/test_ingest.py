import csv
import glob
import io
import json
import random
import zipfile
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweft.functions import text
from logweft.operators import ingest, intervals, segments, upkeep
from logweft.schema import logs_of_events
from logweft.sources import export, lines, sink
from logweft.streaming import tail


def table(spark, text, path="/l/app.log"):
    rows, at = [], 0
    for n, line in enumerate(text.split("\n"), 1):
        at += len(line.encode()) + 1
        rows.append((path, n, at, line))
    return spark.createDataFrame(rows, "path string, line_no long, byte_end long, line string")


HEADS = [
    ("2024-03-15 10:00:00.123 INFO [MyApp.Core] [task-42] Processing item", "INFO", "Processing item", {"subsource": "MyApp.Core", "task_id": "task-42"}),
    ("2024-03-15 10:00:00.123 INFO [x][t1] start", "INFO", "start", {"subsource": "x", "task_id": "t1"}),
    ("2024-03-15 10:00:00.123 wrn Disk low", "WARN", "Disk low", None),
    ("2022-05-12 16:25:14Z SRV [MASTER] Connected", "SRV", "Connected", {"subsource": "MASTER"}),
    ("2024-03-15 10:00:00.123 >>> plain", None, ">>> plain", None),
    ("[15/Mar/2024:10:30:45 +0200] GET /x", "GET", "/x", None),
    ("Mar 5 10:30:45 host up", "HOST", "up", None),
    ("1710500000\tinf ok", "INFO", "ok", None),
]


@pytest.mark.parametrize(("line", "level", "message", "fields"), HEADS)
def test_text_heads(spark, line, level, message, fields):
    row = ingest.read_text(table(spark, line), "r").logs.first()
    assert (row.level, row.message, json.loads(row.fields) if row.fields else None) == (level, message, fields)


def test_a_pattern_of_ones_own(spark):
    row = ingest.read_text(table(spark, "2024-03-15 10:00:00 <E|core> broken"), "r", pattern=r"^\s*<(\w+)\|(\w+)>\s*(.+)$").logs.first()
    assert (row.level, row.message, json.loads(row.fields)) == ("E", "broken", {"subsource": "core"})


def test_text_continuations(spark):
    lines_ = "garbage\n2024-01-01 00:00:00 INFO a\n  one\n\n2024-01-01 00:00:01 INFO b\nGET [15/Mar/2024:10:30:45 +0200]\n" + "\n".join("x" * 3 for _ in range(5000))
    rows = ingest.read_text(table(spark, lines_), "r").logs.orderBy("record_index").collect()
    assert [r.message for r in rows[:1]] == ["a\n  one\n"] and len(rows) == 2 and rows[1].message.count("\n") == ingest.LOOKAHEAD


def test_unread_times_are_skips(spark):
    read = ingest.read_text(table(spark, "2024-01-01 00:00:00 INFO a\n2024-13-41 00:00:00 INFO b\n2024-01-01 00:00:02 INFO c"), "r")
    assert [r.record_index for r in read.logs.orderBy("timestamp_utc").collect()] == [0, 1]
    assert [(r.segment_seq, r.start_line, r.reason_code, bytes(r.sample_prefix)[:10]) for r in read.skips.collect()] == [(1, 2, "TimeParse", b"2024-13-41")]


def test_stretches_of_a_file_agree_with_one_pass(spark, monkeypatch):
    rng = random.Random(1)
    text = table(spark, "\n".join(rng.choice(['{"ts": "2024-01-01", "m": 1}', "bad", "", '{"m": 2}']) for _ in range(400)), "/l/a.ndjson")
    got = []
    for size in (50_000, 7):
        monkeypatch.setattr(ingest, "stretch", lambda size=size: F.floor(F.col("line_no") / size))
        read = ingest.read_ndjson(text, "r")
        got.append((sorted(map(tuple, read.logs.select("record_index", "message").collect())), sorted(tuple(r) for r in read.skips.drop("sample_prefix").collect())))
    assert got[0] == got[1] and [r[2] for r in got[0][1]] and sorted({r[2] for r in got[0][1]}) == list(range(1, len(got[0][1]) + 1))


@pytest.mark.parametrize(("line", "want"), [("a,b", ["a", "b"]), (",a,", ["", "a", ""]), ('"a,b",c', ["a,b", "c"]), ('x"y""z"w,1', ['xy"zw', "1"]), ('a,"open, to the end', ["a", "open, to the end"]), ("", [""]), ('""', [""])])
def test_csv_cells(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(text.cells(F.col("l")).alias("c")).first().c == want == lines.cut(line, ",")


def test_csv_damage_walk_through(spark):
    read = ingest.read_csv(table(spark, "\n".join(["ts,b"] + ["2024-01-01,2"] * 3 + ["1", "1,2,3"] + ["2024-01-01,2"] * 5 + ["", "never,2"]), "/l/a.csv"), "r")
    skips = read.skips.orderBy("segment_seq").collect()
    assert read.logs.count() == 8 and [(r.segment_seq, r.start_line, r.end_line, r.reason_code) for r in skips] == [(1, 5, 11, "CsvColumnMismatch"), (2, 13, 13, "TimeParse")]
    assert bytes(skips[0].sample_prefix) == b"1" and skips[0].reason_detail == "expected 2 columns, found 1"


def test_of_columns_with_one_name_the_last_counts(spark):
    row = ingest.read_csv(table(spark, "ts,x,x\n2024-01-01,1,2", "/l/a.csv"), "r").logs.first()
    assert json.loads(row.fields) == {"ts": "2024-01-01", "x": "2"}


def test_abandoned_file(spark):
    text = table(spark, "\n".join(['{"ts": "2024-01-01"}'] * 2 + ["bad"] * (ingest.ABANDON + 5) + ['{"ts": "2024-01-01"}'] * 9), "/l/a.ndjson")
    read = ingest.read_ndjson(text, "r")
    assert [(r.segment_seq, r.reason_code, r.start_line, r.end_line) for r in read.skips.orderBy("segment_seq").collect()] == [(1, "JsonMalformed", 3, ingest.ABANDON + 2), (2, "Abandoned", ingest.ABANDON + 2, ingest.ABANDON + 2)]
    assert read.logs.count() == 2


def test_ndjson_fields(spark):
    line = '{"timestamp": "2024-01-01T00:00:00Z", "level": "inf", "msg": "x", "n": 1, "ok": true, "z": null, "deep": {"a": [1]}}'
    read = ingest.read_ndjson(table(spark, line + "\n[1]\nnope\n\n{bad", "/l/a.ndjson"), "r")
    row = read.logs.first()
    assert (row.level, row.message, json.loads(row.fields)) == ("INFO", "x", {"timestamp": "2024-01-01T00:00:00Z", "n": "1", "ok": "true", "z": "", "deep": '{"a": [1]}'})
    assert [(r.start_line, r.end_line) for r in read.skips.collect()] == [(2, 5)]


def test_one_pass_over_the_lines(spark, tmp_path):
    """As planned, an exchange of the lines is made once and read again."""
    (tmp_path / "a.ndjson").write_text("\n".join('{"ts": "2024-01-01"}' for _ in range(50)))
    logs = ingest.read_ndjson(spark.read.text(str(tmp_path)).select(F.lit("a").alias("path"), F.monotonically_increasing_id().alias("line_no"), F.lit(0).cast("long").alias("byte_end"), F.col("value").alias("line")), "r").logs
    assert logs.count() == 50
    plan = logs._jdf.queryExecution()
    logs.write.format("noop").mode("overwrite").save()
    assert plan.executedPlan().toString().count("Scan text") <= 6


def test_files_zip_and_encodings(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbf2024-01-01 00:00:00 INFO a\r\n2024-01-01 00:00:01 INFO b\n")
    got = lines.read_lines(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(1, "2024-01-01 00:00:00 INFO a"), (2, "2024-01-01 00:00:01 INFO b")]
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("in/u16.log", "héé\nzwei".encode("utf-16"))
        z.writestr("latin.log", "caf\xe9 \u20ac\n".encode("cp1252"))
        z.writestr("more.zip", b"x")
    torn = io.BytesIO()
    with zipfile.ZipFile(torn, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.log", "some words " * 50)
    torn = bytearray(torn.getvalue())
    torn[40:50] = b"\xff" * 10
    torn = bytes(torn)
    files = spark.createDataFrame([("b.zip", box.getvalue()), ("bad.zip", b"no"), ("torn.zip", torn)], "path string, content binary")
    entries = lines.unzipped(files)
    assert {(r.path, r.problem) for r in entries.collect()} == {("b.zip!/in/u16.log", None), ("b.zip!/latin.log", None), ("b.zip!/more.zip", "NestedArchive"), ("bad.zip", "ZipEntryCorrupt"), ("torn.zip!/a.log", "ZipEntryCorrupt")}
    assert [(r.path[6:], r.line_no, r.line) for r in lines.content_lines(entries).orderBy("path", "line_no").collect()] == [("/in/u16.log", 1, "héé"), ("/in/u16.log", 2, "zwei"), ("/latin.log", 1, "café €")]


def test_detection(spark):
    text = table(spark, "\n" * 5000 + "\n".join(f"2024-01-01 00:00:{n:02d} INFO something" for n in range(30)), "t")
    falling = table(spark, "\n".join(f"2024-01-01 00:{59 - n:02d}:00 INFO something" for n in range(30)), "f")
    csv = table(spark, "timestamp;level;message\n" + "\n".join(f"2024-01-01 00:00:{n:02d};INFO;x" for n in range(30)), "c")
    two = table(spark, "Log_Date,a,Time\n" + "\n".join(f"2024-01-01,x y,00:00:{n:02d}" for n in range(30)), "d")
    nd = table(spark, "\n".join('{"time": "soon", "ts": "2024-01-01", "m": 1}' for _ in range(6)), "n")
    odd = table(spark, "hello\nworld", "o")
    got = {r.path: r for r in lines.detected(text.union(csv).union(nd).union(odd).union(falling).union(two)).collect()}
    assert {p: r.format for p, r in got.items()} == {"t": "text", "c": "csv", "n": "ndjson", "o": "unknown", "f": "text", "d": "csv"}
    assert got["c"].delimiter == "semicolon" and got["n"].confidence == 1.0 and got["n"].time_fields == ["ts"] and got["d"].time_fields == ["Log_Date", "Time"]
    assert got["t"].confidence == 1.0 and got["f"].confidence == 0.7 and got["t"].shape == "ISO-8601"
    assert lines.preview(text).count() == 5


def test_ingest_of_files_and_problems(spark):
    text = table(spark, "\n".join(f"2024-01-01 00:00:{n:02d} INFO something" for n in range(30)), "/l/t.log")
    files = spark.createDataFrame([("/l/t.log", 5, datetime(2024, 1, 1), "h"), ("/l/empty.txt", 0, datetime(2024, 1, 1), "e")], "path string, size long, modified timestamp_ntz, hash string")
    problems = spark.createDataFrame([("b.zip!/x.zip", "NestedArchive")], "path string, problem string")
    got = ingest.ingest(text, "r", files=files, problems=problems)
    assert got.logs.count() == 30 and sorted(r.reason_code for r in got.skips.collect()) == ["NestedArchive", "NotRecognized"]
    assert sorted((r.source_path, r.row_count, r.file_size_bytes, r.file_hash) for r in got.segments.collect()) == [("/l/empty.txt", 0, 0, "e"), ("/l/t.log", 30, 5, "h")]
    none = ingest.ingest(text.limit(0), "r")
    assert none.logs.count() == none.skips.count() == none.segments.count() == 0


times = st.lists(st.tuples(st.integers(0, 3 * 86400), st.integers(-5, 90_000)), max_size=12)


@settings(max_examples=15, deadline=None)
@given(times)
def test_merged_intervals(spark, pairs):
    zero = datetime(2024, 1, 1)
    rows = [(zero + timedelta(seconds=a), zero + timedelta(seconds=a + b)) for a, b in pairs]
    df = spark.createDataFrame(rows, "start_utc timestamp_ntz, end_utc timestamp_ntz")
    want = []
    for a, b in sorted(r for r in rows if r[0] < r[1]):
        if want and a <= want[-1][1]:
            want[-1] = (want[-1][0], max(b, want[-1][1]))
        else:
            want.append((a, b))
    assert sorted(map(tuple, intervals.merged(df).collect())) == want


def test_daily_follows_the_clock(spark):
    got = intervals.daily(spark, "2024-03-31", "2024-03-31", zone="Europe/Rome").first()
    assert (got.start_utc, got.end_utc) == (datetime(2024, 3, 30, 23), datetime(2024, 3, 31, 22))


def test_segments_are_replaced_alone(spark, tmp_path):
    logs = logs_of_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    path = str(tmp_path / "logs")
    upkeep.write_segments(logs, path)
    upkeep.write_segments(logs.where("segment_id = 'seg-1' and record_index < 100"), path)
    upkeep.write_segments(logs.where("segment_id = 'seg-2'"), path, spark.sql("select 'seg-2' as segment_id"))
    got = {r.segment_id: r["count"] for r in segments.read_segments(spark, path).groupBy("segment_id").count().collect()}
    assert got == {"seg-0": 500, "seg-1": 50}
    upkeep.write_segments(logs.limit(0), path, spark.sql("select 'seg-0' as segment_id"))
    assert {r.segment_id for r in segments.read_segments(spark, path).select("segment_id").distinct().collect()} == {"seg-1"}


@pytest.mark.parametrize("kind", ["csv", "jsonl", "parquet"])
def test_export(spark, tmp_path, kind):
    logs = logs_of_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    path = str(tmp_path / kind)
    export.export(logs, path, kind, about={"title": "t"})
    files = sorted(glob.glob(f"{path}/part-*"))
    want = logs.orderBy("timestamp_utc", "segment_id", "record_index").collect()
    if kind == "parquet":
        back = [r for f in files for r in pq.read_table(f).to_pylist()]
        assert [(r["segment_id"], r["record_index"]) for r in back] == [(r.segment_id, r.record_index) for r in want]
        assert all(pq.ParquetFile(f).metadata.metadata[b"title"] == b"t" for f in files)
        assert spark.read.parquet(path).schema["timestamp_utc"].dataType.simpleString() == "timestamp_ntz"
        return
    lines = [x for f in files for x in open(f).read().splitlines()]
    assert json.load(open(f"{path}/_metadata.json")) == {"title": "t"}
    if kind == "csv":
        head, *cells = csv.reader(lines)
        assert head == logs.columns and [int(c[9]) for c in cells] == [r.record_index for r in want]
    else:
        first = json.loads(lines[0])
        assert len(lines) == len(want) and len(first) == 13 and first["timestamp_original"] is None and isinstance(first["fields"], dict)


def test_failed_export_leaves_what_was_there(spark, tmp_path):
    logs = logs_of_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    path = tmp_path / "out"
    export.export(logs.limit(5), str(path), "csv")
    before = {f.name: f.read_text() for f in path.iterdir()}
    broken = logs.withColumn("message", F.when(F.col("record_index") == 700, F.raise_error(F.lit("no"))).otherwise(F.col("message")))
    with pytest.raises(Exception, match="no"):
        export.export(broken.repartition(3), str(path), "csv")
    assert {f.name: f.read_text() for f in path.iterdir()} == before
    export.export(logs, str(path), "jsonl")
    assert all(f.name.endswith(".jsonl") for f in path.iterdir())


def test_repeated_tasks_leave_one_copy(tmp_path):
    """Two attempts of a task write; the commit takes one, and the other goes."""
    import pyarrow as pa

    writer = sink.SinkWriter({"path": str(tmp_path / "out"), "kind": "jsonl"}, True)
    batch = pa.RecordBatch.from_pydict({"value": ["a", "b"]})
    system, folder = sink.filesystem(writer.path)
    system.create_dir(f"{folder}/{writer.attempts}")
    first, second = (writer.text(system, iter([batch]), f"{folder}/{writer.attempts}/{k}", 0) for k in "xy")
    writer.commit([sink.Written(second)])
    assert [(f.name, f.read_text()) for f in (tmp_path / "out").iterdir()] == [("part-00000.jsonl", "a\nb\n")] and first != second


def test_abandoned_runs(spark):
    runs = spark.createDataFrame([("a", "running", None), ("b", "completed", datetime(2024, 1, 1))], "run_id string, status string, completed_utc timestamp_ntz")
    assert [(r.status, r.completed_utc is None) for r in upkeep.abandoned(runs, datetime(2024, 1, 2)).orderBy("run_id").collect()] == [("abandoned", False), ("completed", False)]


def test_tail(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "app.log").write_text("2024-01-01 00:00:00 INFO a\nnoise\n2024-01-01 00:00:10 ERR b\n2024-01-01 00:02:00 INFO c\n")
    stream = tail.counted(tail.tail(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("tailed").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert sorted((r.level, r.row_count) for r in spark.table("tailed").collect()) == [("ERROR", 1), ("INFO", 1), ("INFO", 1)]


def test_skips_and_segments_share_what_was_told(spark, monkeypatch):
    """Lines are told once for skips and segments, which hold what the logs say, also of files that are given up."""
    texts = {"/l/a.log": ["2024-01-01 00:00:00 INFO x", "  more", "2024-99-99 00:00:00 INFO y", "2024-01-02 00:00:00 INFO z"], "/l/b.ndjson": ['{"ts": "2024-01-01"}', "{broken", '{"ts": "2024-01-03"}', "{a", "{b", "{c", '{"ts": "2024-01-04"}']}
    lines = spark.createDataFrame([(p, k, 10 * k, x) for p, some in texts.items() for k, x in enumerate(some, 1)], "path string, line_no long, byte_end long, line string")
    labels = []
    monkeypatch.setattr(ingest, "written", lambda df, label, write=ingest.written: labels.append(label) or write(df, label))
    formats = spark.createDataFrame([("/l/a.log",), ("/l/b.ndjson",)], "path string")
    for most in (10_000, 3):
        monkeypatch.setattr(ingest, "ABANDON", most)
        parts = [ingest.read_text(lines.where("path = '/l/a.log'"), "r", files=ingest.identified(formats)), ingest.read_ndjson(lines.where("path = '/l/b.ndjson'"), "r", files=ingest.identified(formats))]
        del labels[:]
        for part, n, skips in zip(parts, (2, 3 if most > 3 else 2), (1, 1 if most > 3 else 2), strict=True):
            logs, times = ([tuple(r) for r in rows.select("segment_id", "timestamp_utc").collect()] for rows in (part.logs, part.times()))
            assert sorted(logs) == sorted(times) and len(logs) == n and part.skips.count() == skips
            assert part.times().count() == n
        assert labels == ["opened", "brief", "regions"]
