"""WARC archives: a writer that turns repeated payloads into revisits, and a reader that salvages damaged archives.

``archives`` gives rows (archive, content): each content is a file of gzip members, one record each, of about ``ROLL``
bytes; it is a table like that of Spark's binaryFile source, so written tables and folders of .warc or .warc.gz files are
read alike. ``salvage`` reads such rows in one pass: every record is checked (member's check sum, version line, head,
length, closing lines, block digest). After a failed check it searches, in the file and in what a member holds, for the next
member or version line that starts a valid record, goes on from there, and logs the bytes between as a gap: by their places
in the file, and inside a member also by their places in its plain bytes. A member that is cut short or damaged gives the
records before the damage; in a member that fails its check sum, only those that their own digest confirms.

Null html is an empty payload. Of pages with equal payloads those with the smallest id are responses (all of them, if
rows repeat) and the others revisit it; null ids come after all others. Ids may be numbers or text. Empty tables give no
archives, null contents no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Archives are closed at this size, so a row holds about so many bytes and one record more.
ROLL = 4 << 20
#: Bytes that are inflated at a time, and rows' payloads that are held before they are handed on.
STEP = 1 << 16
#: A record's head is at most so long.
HEAD = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PAGE = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
LINE = re.compile(rb"(?:(?<=\n)|\A)" + re.escape(VERSION))


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    name = lambda x: f"<{PAGE}{quote(str(x), safe='') if x is not None else ''}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode("utf-8", "replace") + END + block + END) + packer.flush()


def archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(archive, content) with a record for each page."""
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    # only digests that repeat are joined; a payload that many pages share is one row of ``first``, so Spark splits the pages' side
    first = rows.groupBy("key").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").withColumn("again", F.lit(True)).drop("n")
    marked = rows.join(first, "key", "left").withColumn("revisit", F.coalesce("again", F.lit(False)) & ~F.col("page").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= least_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        row = lambda: pa.RecordBatch.from_pydict({"archive": [f"pages-{part:06d}-{n:05d}.warc.gz"], "content": pa.array([b"".join(held)], pa.binary())})
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, payload, key, first, revisit = (c[i].as_py() for c in batch.columns)
                held.append(record(page, url, payload, base64.b32encode(bytes.fromhex(key)).decode(), first, revisit))
                size += len(held[-1])
                if size >= ROLL:
                    yield row()
                    n, held, size = n + 1, [], 0
        if held:
            yield row()

    return marked.select(F.col("page").cast("string"), "url", "payload", "key", F.col("first").cast("string"), "revisit").mapInArrow(run, "archive string, content binary")


def parse(data: bytes | bytearray, at: int = 0, final: bool = True) -> tuple[dict | None, int, str]:
    """The record at a place of plain bytes, where it ends, and why there is none; no reason: more bytes may complete it."""
    if data[at : at + len(VERSION)] != VERSION:
        return None, at, "no version line" if final or len(data) - at >= len(VERSION) else ""
    end = data.find(END, at, at + HEAD)
    if end < 0:
        return None, at, "no end of head" if final or len(data) - at >= HEAD else ""
    head = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, at, "bad head line"
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if "warc-record-id" not in head or "warc-type" not in head:
        return None, at, "no record id or type"
    length = head.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        return None, at, "no length"
    start, stop = end + 4, end + 4 + int(length)
    if stop + 4 > len(data):
        return None, at, "cut short" if final else ""
    if data[stop : stop + 4] != END:
        return None, at, "no closing lines"
    block = bytes(data[start:stop])
    own = head.get("warc-block-digest", "").startswith("sha1:")
    if own and head["warc-block-digest"][5:] != sha1(block):
        return None, at, "block digest"
    return {"head": head, "block": block, "digested": own}, stop + 4, ""


def plain_records(chunks: Iterator[bytes]) -> Iterator[tuple]:
    """("record", record, start, end) and ("gap", reason, start, end) of plain bytes that come in chunks, in order."""
    held, base, at, lost = bytearray(), 0, 0, None
    more, final = iter(chunks), False
    while True:
        got, end, why = parse(held, at, final) if at < len(held) else (None, at, "")
        if got:
            if lost:
                yield "gap", lost[1], lost[0], base + at
            yield "record", got, base + at, base + end
            at, lost = end, None
        elif why:
            lost = lost or (base + at, why)
            m = LINE.search(held, at + 1)
            # a version line may begin in the last bytes
            at = m.start() if m else max(at + 1, len(held) - len(VERSION)) if not final else len(held)
            if m is None and not final and (chunk := next(more, None)) is not None:
                held += chunk
                m = LINE.search(held, at)
                at = m.start() if m else at
            elif m is None:
                final = True
                at = len(held)
        elif final:
            break
        elif (chunk := next(more, None)) is None:
            final = True
        else:
            if at > HEAD:
                del held[:at]
                base, at = base + at, 0
            held += chunk
    if lost:
        yield "gap", lost[1], lost[0], base + len(held)


def inflated(data: bytes, at: int, state: dict) -> Iterator[bytes]:
    """The plain bytes of the member at a place, as far as they can be read. Then ``state`` has where reading ended and why."""
    unpack, view = zlib.decompressobj(31), memoryview(data)
    state.update(end=len(data), why="member cut short")
    step = STEP
    while at < len(data):
        before = unpack.copy()
        try:
            plain = unpack.decompress(view[at : at + step])
        except zlib.error:
            if step == 1:
                state.update(end=at, why="bad member")
                return
            unpack, step = before, max(1, step // 16)  # up to the very byte
            continue
        if plain:
            yield plain
        at = min(at + step, len(data))
        if unpack.eof:
            state.update(end=at - len(unpack.unused_data), why="")
            return


def sound(data: bytes, at: int) -> bool:
    """Whether the member at a place has no error; it may be cut short."""
    state: dict = {}
    for _ in inflated(data, at, state):
        pass
    return state["why"] != "bad member"


def records(data: bytes) -> Iterator[tuple]:
    """("record", record, offset, inner offset) and ("gap", reason, start, end, inner start, inner end) of a file, in order."""
    at, lost, floor = 0, None, 0
    starts = re.compile(re.escape(MEMBER) + b"|(?:(?<=\n)|\\A)" + re.escape(VERSION))
    while at < len(data):
        member = data.startswith(MEMBER, at)
        state: dict = {"end": at, "why": "no version line"}
        inside, whole = [], None
        events = plain_records(inflated(data, at, state)) if member else ()
        for kind, x, start, end in events:
            if kind == "record" and not x["digested"]:  # then the member's check sum must speak for it
                whole = sound(data, at) if whole is None else whole
                kind, x = (kind, x) if whole else ("gap", "no digest in a bad member")
            if kind == "gap":
                inside.append((x, start, end))
                continue
            if lost:
                yield "gap", lost[1], lost[0], at, None, None
                lost = None
            for why, a, b in inside:
                yield "gap", why, at, None, a, b
            inside = []
            yield "record", x, at, start
        if not member:
            got, end, why = parse(data, at) if at >= floor else (None, at, "bad member")
            if got:
                if lost:
                    yield "gap", lost[1], lost[0], at, None, None
                yield "record", got, at, None
                at, lost = end, None
                continue
            state["why"] = why
        elif not state["why"]:  # a whole member
            if lost:
                yield "gap", lost[1], lost[0], at, None, None
                lost = None
            for why, a, b in inside:
                yield "gap", why, at, state["end"], a, b
            at = state["end"]
            continue
        # what a damaged member's records left, up to the next start: members may begin before the place where reading failed
        lost = lost or (at, state["why"])
        floor = max(floor, state["end"]) if member else floor
        m = starts.search(data, at + 1)
        while m and m[0] != MEMBER and m.start() < floor:
            m = starts.search(data, m.start() + 1)
        at = m.start() if m else len(data)
    if lost:
        yield "gap", lost[1], lost[0], len(data), None, None


def payload_of(x: dict) -> tuple[bytes | None, int, str]:
    """A record's payload (null where it revisits), its full length, and its digest: computed, or as a revisit has it."""
    head, block = x["head"], x["block"]
    http, _, body = block.partition(END) if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    if head.get("warc-type") == "revisit":
        m = re.search(rb"(?i)^content-length:\s*([0-9]+)", http, re.MULTILINE)
        return None, int(m[1]) if m else 0, head.get("warc-payload-digest", "").removeprefix("sha1:")
    return body, len(body), sha1(body)


def id_of(name: str | None) -> str | None:
    """A page's id as text, or another writer's record id as it is."""
    m = re.fullmatch(rf"<{re.escape(PAGE)}(.*)>", name or "")
    return (unquote(m[1]) or None) if m else name


SALVAGED = "archive string, kind string, offset bigint, end bigint, inner_offset bigint, inner_end bigint, page_id string, uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to string, payload binary, reason string"


def salvage(files: DataFrame, archive: str = "archive", content: str = "content", payloads: bool = True) -> DataFrame:
    """A row for each record (kind ``record``) and for each quarantined range of bytes (kind ``gap``, from offset to end;
    inside a member also from inner_offset to inner_end of its plain bytes)."""
    names = [c.split()[0] for c in SALVAGED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.columns[0][i].as_py(), batch.columns[1][i].as_py() or b""
                for kind, x, *places in records(data):
                    if kind == "gap":
                        rows.append((name, kind, *places, None, None, None, None, None, None, None, x))
                    else:
                        payload, length, digest = payload_of(x)
                        head, (offset, inner) = x["head"], places
                        rows.append((name, kind, offset, None, inner, None, id_of(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-type"), length, digest, id_of(head.get("warc-refers-to")), payload if payloads else None, None))
                        size += len(payload or b"") if payloads else 0
                    if len(rows) >= 1000 or size >= 64 * STEP:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(SALVAGED)).types
    return files.select(F.col(archive).cast("string"), content).mapInArrow(run, SALVAGED)
