"""Live tail: lines as a stream of log rows and skips, and running counts with late rows.

``followed`` keeps a state for each path: how many lines, records and bad lines there were, the record that is still open, and the
skipped region that is. So a file that comes in any number of batches gives the rows that ``ingest`` gives for the whole file.
A path's state goes along its lines in order, so it is one task for a path. That task gets pieces of some hundred lines, which
tasks of their own have made of stretches of a path: of a piece it sees the lines that touch what is outside the piece (a text
record's that is open at either side, bad lines and unread times) and says with which number the piece's other records, which are
packed, begin. Tasks of their own unpack them. So the work of one path is many tasks, but for a step a piece.
Lines of a path are taken in the order of ``line_no`` within a batch; batches must be in order. A row without a line, with the number of lines and bytes, ends its
path's file. A text record ends with the next one, with its file, or when its path is silent for ``silence``, if that is given
(such a stream never runs out: it waits for the time to pass); lines that come after that are no part of it.
"""

from __future__ import annotations

import heapq
import json
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from logweft.functions.text import logical_source
from logweft.functions.times import after_stamp_text, stamp_text, with_utc
from logweft.operators.ingest import ABANDON, IDENTITY, LOOKAHEAD, RESYNC, SAMPLE, after_stamp, identified, stretch, told_csv, told_ndjson, told_text
from logweft.schema import LOGS, SKIPS

#: What a path's state holds: the counts, then the open record with its lines, and the open region, as JSON.
STATE = "lines long, bytes long, idx long, k long, bad_at long, good_at long, seq long, n long, stopped boolean, record string, more string, region string"
FRESH = (0, 0, 0, 0, 0, 0, 0, 0, False, None, None, None)
#: Rows that come out: a log row or a skip.
FOLLOWED = StructType([StructField(f.name, f.dataType) for f in (*LOGS, *(g for g in SKIPS if g.name not in LOGS.names))])
#: Pieces of a path that are sorted in memory, those of a sorted run that are read at a time, and rows that come out together.
HELD, READ, OUT = 100_000, 500, 10_000
#: A piece ends with the line that reaches so many bytes (with ``LINE_BYTES`` for what isn't text), or after so many lines; pieces that are unpacked together.
#: Spark gathers 10,000 rows of a state's output in memory, so pieces are small. Bytes of a path's pieces that don't wait on disk.
PIECE_BYTES, PIECE_LINES, LINE_BYTES, UNPACKED, IN_MEMORY = 32_768, 512, 32, 32, 16 << 20
OF_LINE = [*IDENTITY, "utc", "basis", "offset_minutes", "original", "level", "message", "fields_json"]
#: Lines of a path from ``line_no`` on, or its end: ``head`` (JSON) is what the state must see, ``body`` packs ``logs`` rows.
PIECES = StructType([StructField("path", StringType()), *(StructField(n, LongType()) for n in ("line_no", "last_line", "last_byte", "logs")), *(StructField(n, StringType()) for n in IDENTITY), StructField("is_end", BooleanType()), StructField("head", StringType()), StructField("body", BinaryType())])
#: What a packed row has, by its name in ``FOLLOWED``.
PACKED = {"timestamp_utc": "utc", "timestamp_basis": "basis", "timestamp_effective_offset_minutes": "offset_minutes", "timestamp_original": "original", "level": "level", "message": "message", "fields": "fields_json"}
BODY = pa.schema([(PACKED[f.name], f.type) for f in to_arrow_schema(FOLLOWED) if f.name in PACKED])
#: Rows that come out of the state: of a piece, ``record_index`` of the first of its ``keep`` packed rows.
STEPPED = StructType([*FOLLOWED, StructField("first", LongType()), StructField("keep", IntegerType()), StructField("body", BinaryType())])


def tail(spark: SparkSession, folder: str, zone: str = "UTC") -> DataFrame:
    """A row for each line that begins with a timestamp, as files come in."""
    lines = spark.readStream.text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    timed = with_utc(lines.withColumn("stamp", stamp_text(F.col("line"))).where("stamp is not null"), "stamp", zone)
    level, message, _ = after_stamp(after_stamp_text(F.col("line")))
    return timed.where("utc is not null").select(F.col("utc").cast("timestamp").alias("timestamp_utc"), logical_source(F.col("path")).alias("logical_source_id"), level.alias("level"), message.alias("message"))


def counted(rows: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts by window, source and level; rows later than the watermark are left out."""
    return rows.withWatermark("timestamp_utc", late).groupBy(F.window("timestamp_utc", width).alias("w"), "logical_source_id", "level").agg(F.count("*").alias("row_count")).select(F.col("w.start").alias("window_start"), "logical_source_id", "level", "row_count")


class Follower:
    """The rows of one path, a line after the other."""

    def __init__(self, path: str, run: str, state: tuple):
        self.path, self.run, self.out = path, run, []
        (self.lines, self.bytes, self.idx, self.k, self.bad_at, self.good_at, self.seq, self.n, self.stopped, record, more, region) = state
        self.record, self.more, self.region = (json.loads(x) if x else None for x in (record, more, region))

    def state(self) -> tuple:
        held = [json.dumps(x) if x is not None else None for x in (self.record, self.more, self.region)]
        return (self.lines, self.bytes, self.idx, self.k, self.bad_at, self.good_at, self.seq, self.n, self.stopped, *held)

    def log(self, row: dict) -> None:
        self.out.append(
            {
                "timestamp_utc": pd.Timestamp(row["utc"]), "timestamp_basis": row["basis"], "timestamp_effective_offset_minutes": row["offset_minutes"], "timestamp_original": row["original"],
                "logical_source_id": row["logical_source_id"], "source_path": self.path, "physical_file_id": row["physical_file_id"], "segment_id": row["segment_id"], "ingest_run_id": self.run,
                "record_index": row["k"], "level": row["level"], "message": row["message"], "fields": row["fields_json"],
            }
        )

    def skip(self, row: dict, seq: int, code: str, detail: str, start: int, end: int, start_offset=None, end_offset=None, sample=None) -> None:
        self.out.append(
            {
                "logical_source_id": row["logical_source_id"], "segment_id": row["segment_id"], "segment_seq": seq, "start_line": start, "end_line": end, "start_offset": start_offset,
                "end_offset": end_offset, "reason_code": code, "reason_detail": detail, "sample_prefix": None if sample is None else sample.encode(),
            }
        )

    def packed(self, ids: dict, k: int, keep: int, first: int, body: bytes) -> None:
        self.out.append(ids | {"source_path": self.path, "ingest_run_id": self.run, "record_index": k, "first": first, "keep": keep, "body": body})

    def next_seq(self) -> int:
        self.seq += 1
        return self.seq

    def unread(self, row: dict, line: int, sample: str) -> None:
        self.skip(row, self.next_seq(), "TimeParse", "Timestamp extraction failed", line, line, sample=sample)

    def close_record(self) -> None:
        if self.record is not None:
            self.log(self.record | {"message": "\n".join([self.record["message"], *self.more])})
        self.record, self.more = None, None

    def text_piece(self, head: dict, first: int, logs: int, body: bytes) -> None:
        if self.record is not None:
            self.more += head["before"][: max(LOOKAHEAD - self.n, 0)]
            self.n += head["n_before"]
        if not head["opens"]:
            return
        self.close_record()
        if logs:
            self.packed(head["ids"], self.k, logs, first, body)
            self.k += logs
        for line, sample in head["unread"]:
            self.unread(head["ids"], line, sample)
        self.n = head["n_more"]
        if head["last"] is not None:
            self.record, self.more = head["last"] | head["ids"] | {"k": self.k}, head["more"]
            self.k += 1

    def close_region(self, line: int, offset: int) -> None:
        if self.region is not None:
            r = self.region
            self.skip(r, r["seq"], r["bad"], r["detail"], r["line_no"], line, r["byte_end"], offset, r["sample"])
        self.region = None

    def structured(self, row: dict, resync: int) -> None:
        if self.stopped:
            return
        self.idx += 1
        if row["bad"] is not None:
            if not self.bad_at or self.idx - self.bad_at > resync:
                self.region = {c: row[c] for c in ("logical_source_id", "segment_id", "bad", "detail", "sample", "line_no", "byte_end")} | {"seq": self.next_seq()}
            self.bad_at = self.idx
            if self.idx - self.good_at == ABANDON:
                self.close_region(row["line_no"], row["byte_end"])
                self.skip(row, self.next_seq(), "Abandoned", f"Abandoned after {ABANDON} consecutive bad lines", row["line_no"], row["line_no"])
                self.stopped = True
            return
        self.good_at = self.idx
        if self.bad_at and self.idx - self.bad_at == resync:
            self.close_region(row["line_no"], row["byte_end"])
        if row["utc"] is None:
            self.unread(row, row["line_no"], row["head"])
        else:
            if not row.get("packed"):
                self.log(row | {"k": self.k})
            self.k += 1

    def good(self, n: int) -> None:
        """So many packed rows that nothing else depends on."""
        if n and not self.stopped:
            self.idx += n
            self.good_at = self.idx
            self.k += n

    def structured_piece(self, head: dict, first: int, body: bytes, resync: int) -> None:
        k, at = self.k, 0
        for row in head["rows"]:
            self.good(row["at"] - at)
            self.structured(row | head["ids"], resync)
            at = row["at"] + 1
        self.good(head["n"] - at)
        if self.k > k:
            self.packed(head["ids"], k, self.k - k, first, body)

    def end(self) -> None:
        self.close_record()
        self.close_region(self.lines, self.bytes)

    def rows(self) -> pd.DataFrame:
        rows = [{"body": None, "sample_prefix": None} | row for row in self.out]
        return pd.DataFrame(rows, columns=STEPPED.names).astype({"timestamp_utc": "datetime64[us]"} | {c: "Int64" for c in ("record_index", "segment_seq", "start_line", "end_line", "start_offset", "end_offset", "first")} | {c: "Int32" for c in ("timestamp_effective_offset_minutes", "keep")} | {"body": object, "sample_prefix": object})


def in_order(frames: Iterator[pd.DataFrame], held: int = HELD) -> Iterator[dict]:
    """Rows by line_no, a path's end last. More than ``held`` rows are sorted as runs, which wait on the task's disk and are merged
    as they are read: of each run there are ``READ`` rows in memory."""

    def run(some: list[pd.DataFrame]) -> list[pa.RecordBatch]:
        rows = pd.concat(some).sort_values(["line_no", "is_end"])
        return pa.Table.from_pandas(rows, preserve_index=False).to_batches(max_chunksize=READ)

    def read(path: str) -> Iterator[dict]:
        with pa.OSFile(path) as source, pa.ipc.open_stream(source) as batches:
            for batch in batches:
                yield from batch.to_pylist()

    with tempfile.TemporaryDirectory() as folder:
        paths, some, n = [], [], 0
        for frame in frames:
            some, n = [*some, frame], n + len(frame)
            if n >= held:
                paths.append(f"{folder}/{len(paths)}")
                batches = run(some)
                with pa.OSFile(paths[-1], "wb") as into, pa.ipc.new_stream(into, batches[0].schema) as out:
                    for batch in batches:
                        out.write_batch(batch)
                some, n = [], 0
        last = (row for batch in (run(some) if n else []) for row in batch.to_pylist())
        yield from heapq.merge(*map(read, paths), last, key=lambda row: (row["line_no"], row["is_end"]))


def text_head(lines: pa.Table) -> tuple[dict, pa.Table]:
    """Of a piece: the lines before its first record, its last record, and unread times; and the records between, whole."""
    at, text = np.flatnonzero(lines["opens"].to_numpy()), lines["line"].to_pylist()
    before = int(at[0]) if len(at) else len(text)
    head = {"opens": len(at) > 0, "before": text[: min(before, LOOKAHEAD)], "n_before": before}
    opening = lines.take(at)
    messages, more = opening["message"].to_pylist(), []
    for j, (a, b) in enumerate(zip(at, [*at[1:], len(text)])):
        more = text[a + 1 : min(b, a + 1 + LOOKAHEAD)]
        if more and j < len(at) - 1 and messages[j] is not None:
            messages[j] = "\n".join([messages[j], *more])
    read = opening["utc"].is_valid().to_numpy()
    if len(at):
        unread = [(n, text[a][:SAMPLE]) for n, a, r in zip(opening["line_no"].to_pylist(), at, read) if not r]
        last = {c: str(x) if c == "utc" else x for c, x in opening.select([c for c in OF_LINE if c not in IDENTITY]).slice(len(at) - 1).to_pylist()[0].items()} if read[-1] else None
        head |= {"unread": unread, "last": last, "more": more, "n_more": len(text) - int(at[-1]) - 1}
    whole = opening.set_column(opening.schema.get_field_index("message"), "message", pa.array(messages, pa.string()))
    return head, whole.slice(0, max(len(at) - 1, 0)).filter(pa.array(read[:-1]))


def structured_head(lines: pa.Table, resync: int) -> tuple[dict, pa.Table]:
    """Of a piece: bad lines and unread times, and the good lines that may end a region: the first ones, and those so many lines after a bad
    one; and the rows of all good lines."""
    bad, read = lines["bad"].is_valid().to_numpy(), lines["utc"].is_valid().to_numpy()
    seen = bad | ~read
    after = np.flatnonzero(bad) + resync
    seen[after[after < len(bad)]] = True
    seen[:resync] = True
    at = np.flatnonzero(seen)
    rows = lines.select(["line_no", "byte_end", "bad", "detail", "sample", "head"]).take(at).to_pylist()
    rows = [row | {"at": int(k), "packed": True, "utc": "read" if read[k] else None} for k, row in zip(at, rows)]
    return {"n": len(bad), "rows": rows}, lines.filter(pa.array(~bad & read))


def body_of(rows: pa.Table) -> bytes:
    (batch,) = rows.select(BODY.names).cast(BODY).combine_chunks().to_batches()
    return zlib.compress(batch.serialize(), 1)


def pieces(lines: pa.Table, kind: str) -> pa.Table:
    """Told lines of a stretch of a path, in any order, as ``PIECES``. An end is a piece of its own."""
    lines = lines.take(np.lexsort((lines["is_end"].to_numpy(), lines["line_no"].to_numpy()))).combine_chunks()
    ids = [c for c in IDENTITY if c in lines.column_names]
    texts = [c for c in ("line", "message", "original", "fields_json", "sample", "head") if c in lines.column_names]
    size = np.cumsum(LINE_BYTES + sum(pc.fill_null(pc.binary_length(lines[c]), 0).to_numpy().astype(np.int64) for c in texts))
    out, at = [], 0
    for stop in [*np.flatnonzero(lines["is_end"].to_numpy()), lines.num_rows]:
        while at < stop:
            done = size[at - 1] if at else 0
            n = int(min(stop - at, PIECE_LINES, np.searchsorted(size[at:stop], done + PIECE_BYTES) + 1))
            part = lines.slice(at, n)
            head, rows = text_head(part) if kind == "text" else structured_head(part, RESYNC[kind])
            (first,), (last,) = (part.select(["path", "line_no", "byte_end", *ids]).slice(k, 1).to_pylist() for k in (0, n - 1))
            out.append((first["path"], first["line_no"], last["line_no"], last["byte_end"], rows.num_rows, *map(first.get, IDENTITY), False, json.dumps(head), body_of(rows) if rows.num_rows else None))
            at += n
        if stop < lines.num_rows:
            (end,) = lines.select(["path", "line_no", "byte_end"]).slice(stop, 1).to_pylist()
            out.append((end["path"], end["line_no"], end["line_no"], end["byte_end"], 0, None, None, None, True, None, None))
            at = int(stop) + 1
    schema = to_arrow_schema(PIECES)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``STEPPED`` to ``FOLLOWED``."""
    schema = to_arrow_schema(FOLLOWED)

    def rows(some: pa.RecordBatch) -> pa.RecordBatch:
        bodies = [pa.ipc.read_record_batch(pa.py_buffer(zlib.decompress(b)), BODY).slice(0, n) for b, n in zip(some["body"].to_pylist(), some["keep"].to_pylist())]
        sizes = np.array([b.num_rows for b in bodies])
        body, of = pa.Table.from_batches(bodies, BODY).combine_chunks(), np.repeat(np.arange(len(sizes)), sizes)
        local = pa.array(np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        own = some.select(["logical_source_id", "source_path", "physical_file_id", "segment_id", "ingest_run_id", "record_index"]).take(pa.array(of))
        found = {n: body[c].combine_chunks() for n, c in PACKED.items()} | dict(zip(own.schema.names, own.columns))
        found["record_index"] = pc.add(found["record_index"], local)
        return pa.RecordBatch.from_arrays([pc.cast(found[f.name], f.type) if f.name in found else pa.nulls(len(of), f.type) for f in schema], schema=schema)

    for batch in batches:
        has = pc.is_valid(batch["body"])
        plain, bodies = batch.filter(pc.invert(has)).select(schema.names), batch.filter(has)
        yield pa.RecordBatch.from_arrays([pc.cast(c, f.type) for c, f in zip(plain.columns, schema)], schema=schema)
        for k in range(0, bodies.num_rows, UNPACKED):
            yield rows(bodies.slice(k, UNPACKED))


def followed(lines: DataFrame, kind: str, run: str, zone: str = "UTC", files: DataFrame | None = None, silence: str | None = None) -> DataFrame:
    """Log rows and skips (told apart by ``reason_code``) of a stream of lines (path, line_no, byte_end, line) of one format. ``files`` has, by path, what a
    head tells: for CSV ``names``, ``header_line`` and ``delimiter``."""
    rows = lines.withColumn("start", stretch()).repartition("path", "start")
    by_line = {"size", "modified"} <= set(lines.columns)  # else a file's identity goes by its path, and pieces get it
    rows = identified(rows) if by_line else rows.withColumns({c: F.lit(None).cast("string") for c in IDENTITY})
    if files is not None:
        rows = rows.join(F.broadcast(files), "path", "left")
    rows = rows.withColumn("is_end", F.col("line").isNull())
    told = told_text(rows, zone) if kind == "text" else told_csv(rows, zone, None) if kind == "csv" else told_ndjson(rows, zone)
    told = told.withColumn("utc", F.col("utc").cast("timestamp_ntz"))
    told = told if by_line else told.drop(*IDENTITY)
    if kind == "text":  # a line is needed unless it is an opening one whose time is read
        told = told.withColumns({"line": F.when(~F.col("opens") | F.col("utc").isNull(), F.col("line"))} | {c: F.when(F.col("opens"), F.col(c)) for c in ("message", "fields_json")})
    wait = int(pd.Timedelta(silence).total_seconds() * 1000) if silence else 0

    def pack(stretch_of_path: pa.Table) -> pa.Table:
        return pieces(stretch_of_path, kind)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        follower = Follower(key[0], run, state.get if state.exists else FRESH)
        with tempfile.SpooledTemporaryFile(IN_MEMORY) as store:

            def stored() -> Iterator[pd.DataFrame]:
                """What tells the order of pieces, and where the rest of them is stored."""
                for frame in batches:
                    where = []
                    for head, body in zip(frame["head"], frame["body"]):
                        head, body = (head or "").encode(), body or b""
                        where.append((store.tell(), len(head), len(body)))
                        store.write(head)
                        store.write(body)
                    yield frame[["line_no", "is_end", "last_line", "last_byte", "logs", *IDENTITY]].assign(**dict(zip(("at", "head", "body"), np.array(where, np.int64).reshape(-1, 3).T)))

            if state.hasTimedOut:
                follower.close_record()
                follower.n = LOOKAHEAD
            else:
                for piece in in_order(stored()):
                    if len(follower.out) >= OUT:
                        yield follower.rows()
                        follower.out = []
                    follower.lines, follower.bytes = piece["last_line"], piece["last_byte"]
                    if piece["is_end"]:
                        follower.end()
                        continue
                    store.seek(piece["at"])
                    head, body = json.loads(store.read(piece["head"])) | {"ids": {c: piece[c] for c in IDENTITY}}, store.read(piece["body"])
                    follower.text_piece(head, piece["line_no"], piece["logs"], body) if kind == "text" else follower.structured_piece(head, piece["line_no"], body, RESYNC[kind])
        state.update(follower.state())
        if follower.record is not None and wait:
            state.setTimeoutDuration(wait)
        yield follower.rows()

    made = told.groupBy("path", "start").applyInArrow(pack, PIECES)
    made = made if by_line else identified(made)
    out = made.groupBy("path").applyInPandasWithState(step, STEPPED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout)
    # a state's rows go into an exchange only after a projection
    return out.withColumn("to", F.xxhash64("source_path", "first")).repartition("to").mapInArrow(unpacked, FOLLOWED)
