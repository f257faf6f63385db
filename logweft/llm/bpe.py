"""Byte-level BPE encoding and decoding with a given rank file.

A text is cut into pieces by a pattern; each piece is merged on its own. A segment tree over the byte
positions of the piece holds at every inner node the least pair rank below it, so the leftmost pair of the
least rank is found on one way down, and a merge changes the leaves of the two live neighbours and of the
token that went: logarithmic work a merge, also for a piece of a million letters.

Null texts count as empty: no ids, no bytes. Equal texts give equal ids; repeated rows stay repeated. Other
columns of the input are ignored.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Pieces kept by a task with their ids, in two halves: when the newer is full the older goes, so memory is bounded.
CACHED_PIECES = 500_000
#: Longer pieces aren't kept.
CACHED_CHARS = 64


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def highest(ranks: dict[bytes, int]) -> int:
    """The highest rank; files may have gaps."""
    if (found := HIGHEST.get(id(ranks))) is None or found[0] is not ranks:
        HIGHEST.clear()
        HIGHEST[id(ranks)] = found = (ranks, max(ranks.values(), default=0))
    return found[1]


HIGHEST: dict[int, tuple[dict[bytes, int], int]] = {}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    none = highest(ranks) + 1
    get = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    level = [get(piece[i : i + 2], none) for i in range(n - 1)] + [none] * (size - n + 1)
    tree = level
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        tree = level + tree
    tree = [none, *tree]  # the root is 1, the children of k are 2 k and 2 k + 1
    end, before = list(range(1, n + 1)), list(range(-1, n))
    while (least := tree[1]) < none:
        node = 1
        while node < size:
            node *= 2
            if tree[node] != least:
                node += 1
        i = node - size
        gone = end[i]
        end[i] = stop = end[gone]
        changes = [(node, get(piece[i : end[stop]], none) if stop < n else none)]
        if gone < n - 1:
            changes.append((size + gone, none))
        if stop < n:
            before[stop] = i
        if (left := before[i]) >= 0:
            changes.append((size + left, get(piece[left:stop], none)))
        for node, rank in changes:
            tree[node] = rank
            while node > 1:
                other = tree[node ^ 1]
                if other < rank:
                    rank = other
                node >>= 1
                if tree[node] == rank:
                    break
                tree[node] = rank
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def encoder(ranks_path: str, pattern: str):
    """A function of texts that gives their ids one after another, and where those of each text end, with a 0 before."""
    ranks, find, known, older = read_ranks(ranks_path), regex.compile(pattern).findall, {}, {}

    def ids_of(piece: str) -> array:
        ids = older.get(piece) or array("i", merge_piece(piece.encode(), ranks))
        if len(piece) <= CACHED_CHARS:
            if len(known) >= CACHED_PIECES // 2:
                older.clear()
                older.update(known)
                known.clear()
            known[piece] = ids
        return ids

    def of(texts: list[str | None]) -> tuple[array, list[int]]:
        values, ends, seen = array("i"), [0], known.get
        for t in texts:
            for piece in find(t or ""):
                values += seen(piece) or ids_of(piece)
            ends.append(len(values))
        return values, ends

    return of


def decoder(ranks_path: str):
    """A function of ids, and where those of each row end with a 0 before, that gives what each row's ids stand for."""
    token = {rank: b for b, rank in read_ranks(ranks_path).items()}.__getitem__
    return lambda ids, ends: [b"".join(map(token, ids[a:b])) for a, b in zip(ends, ends[1:])]


def listed(values: array, ends: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32)))


def fields(df: DataFrame, keep: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ids array<int>"


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, and ``ids`` array<int> of every whole text."""

    def make():
        of = encoder(ranks_path, pattern)
        return lambda *columns: [*columns[:-1], listed(*of(columns[-1]))]

    return map_rows(docs.select(*keep, text), fields(docs, keep), make)


def decode(encoded: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``ids``, and ``bytes``: what the ids stand for. A null list gives no bytes."""

    def make():
        of = decoder(ranks_path)

        def run(*columns):
            ids = columns[-1].fill_null([]) if columns[-1].null_count else columns[-1]
            return [*columns, of(ids.flatten().to_numpy().tolist(), [0, *np.cumsum(ids.value_lengths().to_numpy()).tolist()])]

        return run

    return map_rows(encoded.select(*keep, "ids"), fields(encoded, keep) + ", bytes binary", make, arrow=True)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What ``decode`` gives of ``encode``, in one Python step: two in a task keep two workers a core in the executor."""

    def make():
        of, back = encoder(ranks_path, pattern), decoder(ranks_path)

        def run(*columns):
            values, ends = of(columns[-1])
            return [*columns[:-1], listed(values, ends), back(values, ends)]

        return run

    return map_rows(docs.select(*keep, text), fields(docs, keep) + ", bytes binary", make)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256 and decoded_sha256, from the ids and from what they decode to."""
    return round_trip(docs, ranks_path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
