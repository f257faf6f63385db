"""Media columns in Matroska: variable-length EBML elements, clusters, lacing and cues, read into packet tables.

``store`` lays a byte payload down as 8-bit samples, in frames of a fixed number of samples: blocks of several laced
frames (the three ways of lacing by turns), clusters of several blocks, and cues that point at the clusters.
``packets`` parses any such column, or a file of another writer, into a table of packets with track, timestamp in
nanoseconds, byte offset and size; elements of unknown size, void elements and unknown elements are handled. The frames of
a lace follow each other by the track's default duration; without one they share their block's timestamp. ``read`` joins
the packets' bytes in order again, computes features of the samples, and counts the cues that point at a cluster of their
time.

A null payload counts as empty. Payloads are padded to a positive multiple of the frame with bytes 255. A null media
value, or one that isn't Matroska, has no packets; a truncated one has those that are whole. Elements that go beyond what
holds them are left out, and a block whose head, lacing or sizes don't fit into it has no packets; both without an error.
Repeated rows stay repeated, and other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_rows, written

FRAME = 576
RATE = 8000
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 16
#: Nanoseconds of a tick.
SCALE = 1_000_000

# Element ids of the Matroska specification.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACES, CODEC, AUDIO, SAMPLING, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_TRACKS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NESTED = frozenset({SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE, CUE_TRACKS})
NONE, XIPH, FIXED, LACED = 0, 1, 2, 3


def size_bytes(n: int, width: int = 0) -> bytes:
    """A variable-length size; all ones stand for an unknown size, so they aren't used."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes | int) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def laced(frames: list[bytes], way: int) -> bytes:
    """The body of a block after its head: the number of further frames, their sizes as the way of lacing says, and the frames."""
    head = bytes([len(frames) - 1])
    if way == XIPH:
        head += b"".join(b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) for x in frames[:-1])
    elif way == LACED:
        sizes = [len(x) for x in frames[:-1]]
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:]):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """One Matroska file with the payload's bytes as unsigned 8-bit samples of one track."""
    head = element(EBML, element(VERSION, 1) + element(READ_VERSION, 1) + element(MAX_ID, 4) + element(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + element(DOC_VERSION, 4) + element(DOC_READ_VERSION, 2))
    body = [element(INFO, element(TIMESTAMP_SCALE, SCALE) + element(MUXER, b"logweft") + element(WRITER, b"logweft"))]
    audio = element(SAMPLING, np.array([RATE], ">f4").tobytes()) + element(CHANNELS, 1) + element(DEPTH, 8)
    body.append(element(TRACKS, element(TRACK, element(NUMBER, 1) + element(UID, 1) + element(KIND, 2) + element(LACES, 1) + element(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio))))
    at, cues = sum(map(len, body)), []
    block, step = FRAME * FRAMES_A_BLOCK, FRAME * FRAMES_A_BLOCK * BLOCKS_A_CLUSTER
    for k in range(0, len(payload), step):
        start = k * 1000 // RATE
        parts = [element(TIMESTAMP, start)]
        for n, b in enumerate(range(k, min(k + step, len(payload)), block)):
            frames = [payload[i : i + FRAME] for i in range(b, min(b + block, k + step, len(payload)), FRAME)]
            way = (NONE, XIPH, FIXED, LACED)[1 + n % 3 if len(frames) > 1 else 0]
            mark = b"\x81" + (b * 1000 // RATE - start).to_bytes(2, "big", signed=True) + bytes([0x80 | way << 1])
            parts.append(element(SIMPLE_BLOCK, mark + (laced(frames, way) if way else frames[0])))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE, element(CUE_TIME, start) + element(CUE_TRACKS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def number_at(data: bytes, at: int, keep_mark: bool = False) -> tuple[int, int]:
    """A variable-length number and its width; -1 for an unknown size. Width 0: there is none."""
    first = data[at] if at < len(data) else 0
    width = 9 - first.bit_length()
    if not first or at + width > len(data):
        return 0, 0
    n = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return n, width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), width


def frames_of(data: bytes, at: int, end: int) -> tuple[int, int, int, int, list[tuple[int, int]]] | None:
    """Track, relative time, flags, way of lacing, and (offset, size) of each frame of a block; None if they don't fit into it."""
    track, width = number_at(data, at)
    at += width
    if not width or at + 3 > end:
        return None
    time, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at, way = at + 3, flags >> 1 & 3
    if way == NONE:
        return track, time, flags, way, [(at, end - at)]
    if at >= end:
        return None
    more, at = data[at], at + 1
    sizes: list[int] = []
    if way == FIXED:
        if (end - at) % (more + 1):
            return None
        sizes = [(end - at) // (more + 1)] * more
    elif way == XIPH:
        for _ in range(more):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                return None
            sizes, at = [*sizes, size + data[at]], at + 1
    else:
        for k in range(more):
            n, width = number_at(data, at)
            at += width
            if not width or at > end or n < 0 and k == 0:
                return None
            n = (1 << 7 * width) - 1 if n < 0 else n  # all ones are a difference, too
            sizes.append(n if k == 0 else sizes[-1] + n - (1 << 7 * width - 1) + 1)
    if any(n < 0 for n in sizes) or at + sum(sizes) > end:
        return None
    found = []
    for size in sizes:
        found.append((at, size))
        at += size
    return track, time, flags, way, [*found, (at, end - at)]


def demux(data: bytes | None) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """Packets (track, timestamp ns, keyframe, lacing, offset, size) and cues (timestamp ns, track, offset of the cluster)."""
    packets, cues, _ = parsed(data)
    return packets, cues


def parsed(data: bytes | None) -> tuple[list[tuple], list[tuple[int, int, int]], dict[int, int]]:
    """As ``demux``, and the clusters' timestamps in ns by offset."""
    packets: list[tuple] = []
    cues: list[list[int]] = []
    clusters: dict[int, int] = {}
    lengths: dict[int, int] = {}
    data = data or b""
    if data[:4] != EBML.to_bytes(4, "big"):
        return [], [], {}
    at, scale, cluster, base, here, track = 0, SCALE, 0, 0, 0, 0
    ends = [len(data)]  # of the elements that are open
    while at < len(data):
        while len(ends) > 1 and at >= ends[-1]:
            ends.pop()
        kind, width = number_at(data, at, True)
        size, more = number_at(data, at + width)
        if not width or not more:
            break
        start = at + width + more
        if kind in NESTED:
            # one of unknown size ends with what holds it, or where a sibling begins; both only matter to its children
            ends.append(ends[-1] if size < 0 else min(start + size, ends[-1]))
            if kind == SEGMENT:
                base = start
            elif kind == CUE:
                cues.append([0, 0, 0])
            elif kind == CLUSTER:
                here, cluster = at, 0
            elif kind == TRACK:
                track = 0
            at = start
            continue
        end = ends[-1] if size < 0 else start + size
        if end > len(data):
            break
        if end > ends[-1]:
            at = ends[-1]
            continue
        if kind in (SIMPLE_BLOCK, BLOCK):
            if (got := frames_of(data, start, end)) is not None:
                number, time, flags, way, frames = got
                step = lengths.get(number, 0)
                packets += [(number, (cluster + time) * scale + k * step, bool(flags & 0x80) if kind == SIMPLE_BLOCK else None, way, *f) for k, f in enumerate(frames)]
        elif kind == TIMESTAMP:
            cluster = int.from_bytes(data[start : min(end, start + 8)], "big")
            clusters[here] = cluster * scale
        elif kind == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[start : min(end, start + 8)], "big") or SCALE
        elif kind == NUMBER:
            track = int.from_bytes(data[start : min(end, start + 8)], "big")
            if 0 in lengths:
                lengths[track] = lengths.pop(0)
        elif kind == DEFAULT_DURATION:
            lengths[track] = int.from_bytes(data[start : min(end, start + 8)], "big")
        elif kind in (CUE_TIME, CUE_TRACK, CUE_CLUSTER) and cues:
            n = int.from_bytes(data[start : min(end, start + 8)], "big")
            cues[-1][(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(kind)] = n * scale if kind == CUE_TIME else n + base if kind == CUE_CLUSTER else n
        at = end
    return packets, [tuple(c) for c in cues], clusters


def padded(payload: bytes | None) -> bytes:
    payload = payload or b""
    return payload + b"\xff" * (-len(payload) % FRAME if payload else FRAME)


def features(samples: bytes) -> tuple[int, int, int, int, int]:
    """Sum, least, greatest, sum of squared steps, and crossings of the middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    if not len(x):
        return 0, 0, 0, 0, 0
    return int(x.sum()), int(x.min()), int(x.max()), int((np.diff(x) ** 2).sum()), int(np.count_nonzero(np.diff(x >= 128)))


def store(docs: DataFrame, payload: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``n_bytes`` (unpadded) and ``media``: each row's payload, a string or binary column, as a Matroska file."""
    kinds = dict(docs.dtypes)
    rows = docs.select(*keep, F.coalesce(payload.cast("binary"), F.lit(b"")).alias("payload"))
    return map_rows(rows, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_bytes bigint, media binary", lambda: lambda *c: [*c[:-1], [len(x) for x in c[-1]], [mux(padded(x)) for x in c[-1]]])


def packets(stored: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The packet table: a row for each packet, with its number in the file."""
    kinds = dict(stored.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", p array<struct<track: bigint, timestamp_ns: bigint, keyframe: boolean, lacing: int, offset: bigint, size: bigint>>"
    names = ("track", "timestamp_ns", "keyframe", "lacing", "offset", "size")
    rows = map_rows(stored.select(*keep, media), schema, lambda: lambda *c: [*c[:-1], [[dict(zip(names, p)) for p in demux(x)[0]] for x in c[-1]]])
    return rows.select(*keep, F.posexplode("p").alias("packet", "p")).select(*keep, "packet", "p.*")


def read(stored: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``media``, ``payload`` (the packets' bytes in order) and ``feature``: numbers of packets and of cues that
    point at a cluster of their time, the last timestamp in ms and the features of the samples."""

    def run(*columns):
        payloads, found = [], []
        for x in columns[-1]:
            table, cues, clusters = parsed(x)
            payloads.append(b"".join([x[p[4] : p[4] + p[5]] for p in table]))
            last = table[-1][1] // 1_000_000 if table else 0
            found.append(f"packets={len(table)} cues={sum(clusters.get(o) == t for t, _, o in cues)} last_ms={last} sum={{}} min={{}} max={{}} steps={{}} crossings={{}}".format(*features(payloads[-1])))
        return [*columns, payloads, found]

    kinds = dict(stored.dtypes)
    return map_rows(stored.select(*keep, media), ", ".join(f"`{c}` {kinds[c]}" for c in (*keep, media)) + ", payload binary, feature string", lambda: run)


def digests(docs: DataFrame) -> DataFrame:
    """Per document the digests of what was stored, as a table of media in the shared folder, and of what was read back from it."""
    stored = written(store(docs, F.col("text")), "media")
    back = read(stored, keep=("doc_id", "n_bytes"))
    told = back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(octet_length(payload) - 31, 1), 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
    told = written(told, "digests")
    dropped(stored)
    return told
