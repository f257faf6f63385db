"""A file in any number of batches gives what ingest gives for the whole of it."""

import datetime
import json
import os
import random
import time

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logweft.operators import ingest
from logweft.streaming import tail

LINES = "path string, line_no long, byte_end long, line string"
CASES = {"text": 11, "csv": 12, "ndjson": 13}


def some_lines(kind: str, dice: random.Random, n: int = 160) -> list[str]:
    stamp = lambda k: f"2024-03-01 10:{k // 60 % 60:02d}:{k % 60:02d}"
    if kind == "text":
        out = ["before the first"]
        for k in range(n):
            out += [f"{stamp(k) if k % 19 else '2024-99-01 10:00:00'} INFO [x] event {k}", *(["  at frame"] * dice.choice([0, 0, 1, 4]))]
        return out
    good = {"csv": lambda k: f"{stamp(k) if k % 23 else 'no time'},info,m{k}", "ndjson": lambda k: f'{{"ts": "{stamp(k) if k % 23 else "no"}", "msg": "m{k}"}}'}[kind]
    lines = [dice.choice(["broken", ""]) if dice.random() < 0.12 else good(k) for k in range(n)]
    return (["time,level,message"] if kind == "csv" else []) + lines + ["broken", ""]


def batches(spark, tmp_path, rows: list[tuple], cuts: list[int]):
    """A stream that takes the rows between cuts as one batch each, their order within a batch lost."""
    folder = tmp_path / "in"
    folder.mkdir()
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        some = rows[a:b][::-1]
        frame = pd.DataFrame(some, columns=["path", "line_no", "byte_end", "line"])
        frame.to_parquet(folder / f"{k:04d}.parquet")
        os.utime(folder / f"{k:04d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drained(stream, name: str):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name)


def same_rows(got, want):
    logs = ["timestamp_utc", "record_index", "level", "message", "fields", "segment_id"]
    skips = ["segment_seq", "start_line", "end_line", "start_offset", "end_offset", "reason_code", "sample_prefix"]
    key = lambda df, c: sorted((str([bytes(x) if isinstance(x, bytearray) else x for x in r]) for r in df.select(*c).collect()))
    assert key(got.where("reason_code is null"), logs) == key(want.logs, logs)
    assert key(got.where("reason_code is not null"), skips) == key(want.skips, skips)
    return got.count()


@pytest.mark.parametrize("kind", CASES)
def test_batches_as_whole(spark, tmp_path, kind):
    dice = random.Random(CASES[kind])
    rows = []
    for path in ("/l/a.log", "/l/b.log"):
        at, lines = 0, some_lines(kind, dice)
        for n, line in enumerate(lines, 1):
            at += len(line) + 1
            rows.append((path, n, at, line))
        rows.append((path, len(lines), at, None))
    cuts = sorted(dice.sample(range(1, len(rows)), 5))
    whole = spark.createDataFrame([r for r in rows if r[3] is not None], LINES)
    files = None
    if kind == "csv":
        files = spark.createDataFrame([(p, ["time", "level", "message"], 1, "comma") for p in ("/l/a.log", "/l/b.log")], "path string, names array<string>, header_line long, delimiter string")
    want = {"text": ingest.read_text, "csv": ingest.read_csv, "ndjson": ingest.read_ndjson}[kind](whole, "r")
    got = drained(tail.followed(batches(spark, tmp_path, rows, cuts), kind, "r", files=files), f"followed_{kind}")
    assert same_rows(got, want) > 200


def plain(kind: str, resync: int, faults: str):
    """What a follower makes of lines: g(ood), b(ad), t(ime unread)."""
    rows = [{"line_no": n, "byte_end": 2 * n, "bad": "JsonMalformed" if f == "b" else None, "detail": "d", "sample": "s", "head": "h", "utc": None if f != "g" else "2024-01-01", "logical_source_id": "x", "segment_id": "y",
             "basis": "Utc", "offset_minutes": 0, "original": "", "physical_file_id": "z", "level": None, "message": "m", "fields_json": None} for n, f in enumerate(faults, 1)]
    state, out = tail.FRESH, []
    for row in rows:  # the state goes through its text form at each line
        follower = tail.Follower("p", "r", state)
        follower.lines, follower.bytes = row["line_no"], row["byte_end"]
        follower.structured(row, resync)
        state, out = follower.state(), out + follower.out
    follower = tail.Follower("p", "r", state)
    follower.end()
    return [(r["segment_seq"], r["start_line"], r["end_line"], r["reason_code"]) for r in out + follower.out if "reason_code" in r]


def test_regions_and_given_up_files(monkeypatch):
    assert plain("ndjson", 3, "gbgbgggg") == [(1, 2, 7, "JsonMalformed")]
    assert plain("ndjson", 3, "gbgggbtg") == [(1, 2, 5, "JsonMalformed"), (3, 7, 7, "TimeParse"), (2, 6, 8, "JsonMalformed")]
    monkeypatch.setattr(tail, "ABANDON", 4)
    assert plain("ndjson", 3, "gbbbbgg") == [(1, 2, 5, "JsonMalformed"), (2, 5, 5, "Abandoned")]


def test_silence_ends_a_record(spark, tmp_path):
    rows = [("/l/a.log", 1, 30, "2024-01-01 00:00:00 INFO a"), ("/l/a.log", 2, 33, "  b")]
    stream = tail.followed(batches(spark, tmp_path, rows, [1]), "text", "r", silence="1 second")
    query = stream.writeStream.format("memory").queryName("silent").outputMode("append").start()
    try:
        until = time.monotonic() + 90
        while time.monotonic() < until and not spark.table("silent").count():
            time.sleep(0.5)
    finally:
        query.stop()
    (row,) = spark.table("silent").collect()
    assert row.message in ("a\n  b", "a") and row.record_index == 0  # the second batch may come after the silence


def test_windows_of_a_followed_stream(spark, tmp_path):
    rows = [("/l/a.log", k + 1, 30 * k, f"2024-01-01 00:{k:02d}:00 INFO a") for k in range(10)] + [("/l/a.log", 10, 300, None)]
    got = tail.followed(batches(spark, tmp_path, rows, [3]), "text", "r").where(F.col("reason_code").isNull())
    assert drained(got.select("message", "timestamp_utc"), "windows_followed").count() == 10


def test_more_lines_than_memory_holds():
    """Rows in any order, with nulls, come out in order from runs on disk."""
    numbers = list(range(1, 2001))
    random.Random(5).shuffle(numbers)
    frames = [pd.DataFrame({"line_no": numbers[k : k + 30], "is_end": [n == 2000 for n in numbers[k : k + 30]], "utc": [pd.Timestamp("2024-01-01") if n % 3 else pd.NaT for n in numbers[k : k + 30]], "bad": ["x" if n % 2 else None for n in numbers[k : k + 30]]}) for k in range(0, 2000, 30)]
    frames.append(pd.DataFrame({"line_no": [2000], "is_end": [False], "utc": [pd.NaT], "bad": [None]}))
    for held in (100, 10**6):
        got = list(tail.in_order(iter(frames), held))
        assert [r["line_no"] for r in got] == [*range(1, 2001), 2000] and [r["is_end"] for r in got[-2:]] == [False, True]
        assert all((r["utc"] is None) == (r["line_no"] % 3 == 0) and r["bad"] == ("x" if r["line_no"] % 2 else None) for r in got if r["line_no"] < 2000)


IDS = {"logical_source_id": "x", "segment_id": "y", "physical_file_id": "z"}
TOLD = {"text": [("opens", pa.bool_()), ("line", pa.string())], "ndjson": [(c, pa.string()) for c in ("bad", "detail", "sample", "head")]}


def told(kind: str, what: str, line_no: int, end: bool) -> dict:
    """A told line: o(pens), u(nread time), c(ontinues), b(ad), g(ood)."""
    read = what in "og" and not end
    row = {"path": "p", "line_no": line_no, "byte_end": 2 * line_no, **IDS, "utc": datetime.datetime(2024, 1, 1, 0, 0, 0, line_no) if read else None, "basis": "Utc", "offset_minutes": 0, "original": "", "level": None, "message": f"m{line_no}" if what in "oug" else None, "fields_json": None, "is_end": end}
    if kind == "text":
        return row | {"opens": what in "ou" and not end, "line": None if end or what == "o" else f"{what}{line_no}"}
    return row | {"bad": "JsonMalformed" if what == "b" and not end else None, "detail": "d", "sample": "s", "head": f"h{line_no}"}


def by_line(kind: str, rows: list[dict], resync: int) -> tuple[list, list]:
    """Logs (number, time, message) and skips of lines that are taken one after the other."""
    if kind != "text":
        follower = tail.Follower("p", "r", tail.FRESH)
        for row in rows:
            follower.lines, follower.bytes = row["line_no"], row["byte_end"]
            follower.end() if row["is_end"] else follower.structured(row, resync)
        logs = [(r["record_index"], r["timestamp_utc"], r["message"]) for r in follower.out if "record_index" in r]
        return logs, [(r["segment_seq"], r["start_line"], r["end_line"], r["reason_code"]) for r in follower.out if "reason_code" in r]
    logs, skips, last, n = [], [], None, 0
    for row in rows:
        if row["is_end"] or row["opens"]:
            last, n = None, 0
        if row["opens"] and row["utc"] is None:
            skips.append((len(skips) + 1, row["line_no"], row["line_no"], "TimeParse"))
        elif row["opens"]:
            last = [len(logs), pd.Timestamp(row["utc"]), row["message"]]
            logs.append(last)
        elif last is not None and not row["is_end"] and (n := n + 1) <= tail.LOOKAHEAD:
            last[2] += "\n" + row["line"]
    return [tuple(r) for r in logs], skips


@pytest.mark.parametrize("kind", TOLD)
def test_pieces_as_lines(kind, monkeypatch):
    """The state sees pieces instead of lines, wherever they are cut; records between are numbered and come out packed."""
    monkeypatch.setattr(tail, "LOOKAHEAD", 5)
    monkeypatch.setattr(tail, "ABANDON", 6)
    dice, resync, few = random.Random(7), tail.RESYNC.get(kind), 0
    names = ["path", "line_no", "byte_end", *IDS, "utc", "basis", "offset_minutes", "original", "level", "message", "fields_json", "is_end"]
    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.timestamp("us"), pa.string(), pa.int32(), *[pa.string()] * 4, pa.bool_()]
    schema = pa.schema([*zip(names, types), *TOLD[kind]])
    for k in range(120):
        letters = dice.choices("ocu" if kind == "text" else "gbu", [5, dice.choice([1, 20]), 1], k=60)
        rows = [told(kind, x, 3 * n, False) for n, x in enumerate(letters, 1)]
        for at in (60, dice.randrange(60)):
            rows.insert(at, told(kind, "c", rows[at - 1]["line_no"] if at else 1, True))
        monkeypatch.setattr(tail, "PIECE_LINES", dice.choice([1, 3, 7, 100]))
        monkeypatch.setattr(tail, "PIECE_BYTES", dice.choice([1, 150, 10**6]))
        cuts = sorted({0, *dice.choices(range(len(rows)), k=3), len(rows)})
        cuts = [c for c in cuts if not 0 < c < len(rows) or rows[c - 1]["line_no"] < rows[c]["line_no"]]  # a line and its end are of one stretch
        state, stepped = tail.FRESH, []
        for a, b in zip(cuts, cuts[1:]):  # stretches, each a batch of its own
            follower = tail.Follower("p", "r", state)
            some = rows[a:b]
            dice.shuffle(some)
            found = tail.pieces(pa.Table.from_pylist(some, schema), kind).to_pylist()
            few += len(found) < b - a
            for piece in found:
                follower.lines, follower.bytes = piece["last_line"], piece["last_byte"]
                if piece["is_end"]:
                    follower.end()
                elif kind == "text":
                    follower.text_piece(json.loads(piece["head"]) | {"ids": IDS}, piece["line_no"], piece["logs"], piece["body"])
                else:
                    follower.structured_piece(json.loads(piece["head"]) | {"ids": IDS}, piece["line_no"], piece["body"], resync)
            state = follower.state()
            stepped += pa.Table.from_pandas(follower.rows(), tail.to_arrow_schema(tail.STEPPED), preserve_index=False).to_batches()
        got = pa.Table.from_batches(tail.unpacked(iter(stepped))).to_pylist()
        logs, skips = by_line(kind, rows, resync)
        assert sorted((r["record_index"], pd.Timestamp(r["timestamp_utc"]), r["message"]) for r in got if r["reason_code"] is None) == sorted(logs)
        assert sorted((r["segment_seq"], r["start_line"], r["end_line"], r["reason_code"]) for r in got if r["reason_code"]) == sorted(skips)
        assert all(r["logical_source_id"] == "x" and r["segment_id"] == "y" for r in got)
    assert few > 100


def test_state_gets_pieces(spark, tmp_path):
    """A path's one task gets few rows, however many lines the path has."""
    rows = [("/l/a.log", k, 30 * k, f"2024-01-01 00:00:00 INFO {k}") for k in range(1, 20_001)]
    stream = tail.followed(batches(spark, tmp_path, rows, []), "text", "r")
    query = stream.writeStream.format("memory").queryName("pieces_followed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert spark.table("pieces_followed").count() == 19_999  # the last one is open
    found, todo = [], [query._jsq.streamingQuery().lastExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "FlatMapGroupsInPandasWithState":
            found.append(node.metrics().apply("numOutputRows").value())
    assert len(found) == 1 and found[0] < 20_000 / 50
