"""Repeated passages across documents: found by content-chosen phrases, removed by Aho-Corasick automata.

A word is a run of bytes that aren't white space, unchanged. A window is ``WINDOW`` consecutive words of one document; words
that are covered by a window which also starts in a document of a smaller id are removed. The steps:

1. Documents of the same words are one class; all but its smallest id are removed whole, as each of their windows is in it.
   Only classes go on.
2. In each window the phrase of ``PHRASE`` words with the least hash stands for the window. Equal windows choose equal phrases, so
   two documents that share a window share a phrase. Phrases that one document has alone are done with: about one phrase for
   18 words is counted, not a row for each word.
3. The windows of the phrases left are hashed to 96 bits; a window that several documents have recurs, and the smallest of them
   owns it. A hot window is summed up in the tasks before it is shuffled.
4. Recurring windows in a row that have one owner are a passage of their document. Documents with passages are dealt to
   shards (``slices`` of 1,000 documents or 2 MB); a shard's passages, each text once with its least owner, become one
   automaton over words, and all documents of the shard stream through it. Each occurrence of a passage in a document with an
   id above its owner's is removed. A document meets one automaton, whatever the number of shards.

Soundness: all windows of a passage are in the owner. Completeness: a document's own passages are in its shard's automaton.

Null and wordless texts have no window and keep what they have. A row with a null id removes nothing and loses nothing. Repeated
rows of an id come out each, judged by their own text; equal ids don't remove from each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_rows, written

WINDOW, PHRASE = 50, 16
#: Ids of documents with candidates are broadcast up to so many (8 bytes each); beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of texts that are hashed together; longer words are hashed by themselves.
BLOCK, LONG_WORD = 1 << 19, 256
#: Bytes of a shard's texts and windows.
SHARD = 2 << 20
#: Code points for words of an automaton; with more distinct words, a word is two of them.
CODES = 1_000_000

_seeds = np.random.default_rng(12)
BYTE = _seeds.integers(1, 2**63, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
UP = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(BLOCK + LONG_WORD, BASE)]))
DOWN = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(BLOCK + LONG_WORD, np.uint64(pow(int(BASE), -1, 2**64)))]))
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
LEFT, RIGHT = _seeds.integers(0, 2**62, (2, 8), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and where the words start."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~WHITE[raw], [False]])))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = int(np.searchsorted(starts, base + BLOCK))
        part = BYTE[raw[base : base + BLOCK + LONG_WORD]] * UP[: len(raw[base : base + BLOCK + LONG_WORD])]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part)])
        s, e = starts[at:stop] - base, np.minimum(ends[at:stop] - base, len(part))
        out[at:stop] = mixed((sums[e] - sums[s]) * DOWN[s])
        at = stop
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out, starts


def joined(a: np.ndarray, b: np.ndarray, width: int, k: int) -> np.ndarray:
    """Hashes of sequences from those of their first ``width`` words and of the rest, which starts ``width`` words later."""
    n = max(0, min(len(a), len(b) - width))
    return mixed(a[:n] * LEFT[k] + b[width : width + n] * RIGHT[k])


def sequences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the phrases at each word, and two of the windows."""
    two = joined(words, words, 1, 0)
    four = joined(two, two, 2, 1)
    eight = joined(four, four, 4, 2)
    phrases = joined(eight, eight, 8, 3)
    most = joined(joined(phrases, phrases, 16, 4), phrases, 32, 5)
    return phrases, joined(most, two, 48, 6), joined(most, two, 48, 7)


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, 2**64 - 1, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: len(x) - width + 1], before[width - 1 : len(x)])


def hashed(texts: list[bytes]):
    """For each text: its number of words, the phrase that stands for each window, and the windows' hashes."""
    at = 0
    while at < len(texts):  # texts of so many bytes together, or one longer one
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= BLOCK:
            size += len(texts[stop])
            stop += 1
        words, starts = word_hashes(b"\n".join(texts[at:stop]))
        phrases, first, second = sequences(words)
        stands = least_of(phrases, WINDOW - PHRASE + 1)
        ends = np.cumsum([len(t) + 1 for t in texts[at:stop]])
        begin = 0
        for end in np.searchsorted(starts, ends).tolist():
            last = max(begin, end - WINDOW + 1)
            yield end - begin, stands[begin:last], first[begin:last], second[begin:last]
            begin = end
        at = stop


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def told(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, key (of the words), n_words, and the phrases that stand for its windows."""

    def make():
        def run(ids, texts):
            raw = [(t or "").encode() for t in texts]
            sizes, phrases = [], []
            for n, stands, _, _ in hashed(raw):
                sizes.append(n)
                phrases.append(np.unique(stands).view(np.int64))
            return ids, [digest(t.split()) for t in raw], sizes, lists(phrases, pa.int64())

        return run

    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, key binary, n_words long, phrases array<long>", make)


def windows(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, key, text, and place and hashes of the windows that one of the row's ``phrases`` stands for."""

    def make():
        def run(ids, texts, wanted):
            raw = [(t or "").encode() for t in texts]
            places, ones, twos = [], [], []
            for mine, (_, stands, first, second) in zip(wanted, hashed(raw), strict=True):
                at = np.flatnonzero(np.isin(stands, np.array(mine, np.int64).view(np.uint64)))
                places.append(at)
                ones.append(first[at].view(np.int64))
                twos.append((second[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            return ids, [digest(t.split()) for t in raw], texts, lists(places, pa.int32()), lists(ones, pa.int64()), lists(twos, pa.int32())

        return run

    return map_rows(docs.select("doc_id", "text", "phrases"), f"doc_id {kind}, key binary, text string, at array<int>, h1 array<long>, h2 array<int>", make)


def coded(words: list[bytes], codes: dict[bytes, int], wide: bool) -> str:
    """Words as code points, or as two of them; words that no passage has are code point 0."""
    numbers = [codes.get(w, 0) for w in words]
    if not wide:
        return "".join(map(chr, numbers))
    return "".join(chr(n % CODES) + chr(n // CODES) for n in numbers)


Runs = tuple[np.ndarray, np.ndarray]


def passages_of(texts: list[list[bytes]], runs: list[Runs]) -> dict[tuple[bytes, ...], object]:
    """The texts' passages with their least owners. ``runs``: places and owners of each text's recurring windows."""
    out: dict[tuple[bytes, ...], object] = {}
    for words, (places, owners) in zip(texts, runs, strict=True):
        order = np.argsort(places, kind="stable")
        places, owners = places[order], owners[order]
        cuts = np.flatnonzero((np.diff(places) != 1) | (owners[1:] != owners[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
            if a < b:
                passage, owner = tuple(words[places[a] : places[b - 1] + WINDOW]), owners[a]
                out[passage] = min(owner, out.get(passage, owner))
    return out


def covered(ids: list, texts: list[list[bytes]], runs: list[Runs]) -> list[np.ndarray]:
    """For each text: which of its words a passage of a smaller owner covers."""
    passages = passages_of(texts, runs)
    codes: dict[bytes, int] = {}
    for passage in passages:
        for w in passage:
            codes.setdefault(w, len(codes) + 1)
    wide = len(codes) >= CODES
    step = 2 if wide else 1
    automaton = ahocorasick.Automaton()
    for passage, owner in passages.items():
        automaton.add_word(coded(passage, codes, wide), (len(passage), owner))
    if passages:
        automaton.make_automaton()
    out = []
    for i, words in zip(ids, texts, strict=True):
        change = np.zeros(len(words) + 1, np.int64)
        for end, (size, owner) in automaton.iter(coded(words, codes, wide)) if passages else ():
            if owner < i and (end + 1) % step == 0:
                change[(end + 1) // step - size] += 1
                change[(end + 1) // step] -= 1
        out.append(np.cumsum(change[:-1]) > 0)
    return out


def removed(rows: DataFrame, kind: str) -> DataFrame:
    """doc_id, key, n_removed and kept_sha256 of documents with recurring windows (``runs``); a slice is a shard."""

    def make():
        def run(ids, keys, texts, runs):
            words = [t.encode().split() for t in texts.to_pylist()]
            windows = runs.flatten()
            places, owners = windows.field("at").to_numpy(zero_copy_only=False), windows.field("owner").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False))])
            gone = covered(ids.to_pylist(), words, [(places[a:b], owners[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            kept = [hashlib.sha256(b" ".join(w for w, g in zip(ws, gs.tolist(), strict=True) if not g)).hexdigest() for ws, gs in zip(words, gone, strict=True)]
            return ids, keys, [int(g.sum()) for g in gone], kept

        return run

    return map_rows(rows.select("doc_id", "key", "text", "runs"), f"doc_id {kind}, key binary, n_removed long, kept_sha256 string", make, arrow=True, most=SHARD)


def recurring(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space) for each row."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = written(told(docs, kind), "phrases")
    judged = (F.col("n_words") >= WINDOW) & F.col("doc_id").isNotNull()
    least = rows.where(judged).groupBy("key").agg(F.min("doc_id").alias("first"))
    classes = rows.where(judged).join(least, "key")
    phrases = classes.where("doc_id = first").select("doc_id", F.explode("phrases").alias("phrase"))
    shared = phrases.groupBy("phrase").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("phrase")
    candidates = written(phrases.join(shared, "phrase").groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases")), "candidates")
    some = docs.select("doc_id", "text")
    if candidates.count() <= BROADCAST_IDS:
        some = some.join(F.broadcast(candidates.select("doc_id")), "doc_id", "left_semi")
    found = written(windows(some.join(candidates, "doc_id"), kind), "windows")
    each = found.select("doc_id", "key", F.explode(F.arrays_zip("at", "h1", "h2")).alias("w")).select("doc_id", "key", "w.*")
    owners = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    owners = written(owners, "owners")  # so that both sides of the join below are dealt anew, and a hot window can be split
    later = each.join(owners, ["h1", "h2"]).where("owner < doc_id")
    runs = later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "owner")).alias("runs"))
    gone = written(removed(found.select("doc_id", "key", "text").join(runs, ["doc_id", "key"]), kind).dropDuplicates(["doc_id", "key"]), "removed")
    for done in (found, candidates, owners):
        dropped(done)
    copy, whole = F.col("doc_id") > F.col("first"), F.lower(F.hex("key"))
    kept = F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", whole))
    n = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    long = rows.where(judged).drop("phrases").join(least, "key").join(gone, ["doc_id", "key"], "left").select("doc_id", "n_words", n.cast("long").alias("n_removed"), kept.alias("kept_sha256"))
    return long.unionByName(rows.where(~judged).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), whole.alias("kept_sha256")))


#: The query in DuckDB.
TWIN = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, w, unnest(range(1, len(w) - 48)) as k from w where len(w) >= 50),
h as (select doc_id, k, sha256(array_to_string(w[k:k + 49], ' ')) as h from s),
o as (select h, min(doc_id) as owner from h group by h),
gone as (select distinct doc_id, unnest(range(k, k + 50)) as k from h join o using (h) where owner < doc_id),
g as (select doc_id, list(k) as gone, count(*) as n from gone group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(array_to_string(case when n is null then w else [w[i] for i in range(1, len(w) + 1) if not list_contains(gone, i)] end, ' ')) as kept_sha256
from w left join g on w.doc_id = g.doc_id
"""
