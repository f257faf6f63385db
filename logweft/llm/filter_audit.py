"""Which filter removes what, in every order: an audit of five filters over documents.

A: under 200 words; B: distinct words are under half of them; C: over 3 % of the characters are A-Z; D: a character of
``[#$%&*|]``; E: the text of a document of a smaller id. Words are maximal runs without white space, as they are written.

1. A task keeps chains by fingerprint (xxhash64 of the text): each chain holds full texts with their least id so far. Rows above
   that id are copies for certain and go on without their text, dealt by their id; what is left at the task's end (or after
   ``HELD`` bytes) goes on with its text, a row for a text, dealt by its fingerprint. So a text that a third of all rows hold
   is as many rows as there are tasks.
2. Partitions by fingerprint are sorted by (fingerprint, id), so one chain is held at a time: the first id of a text is its
   minimum, and later ids are copies.
3. Each document is now a mask of five bits. ``combineByKey`` merges vectors of counts, one cell for each mask and label, by part
   and a salt, then by part: a part's vector has 128 cells, whatever its number of documents.
4. The 120 orders are read from the vectors.

Null texts are empty: A fails, and E as for any text. A null id is neither smaller nor larger than another, so its row isn't
a copy and makes none. Rows that share id and text are each a row; none is a copy of the others. A document is good or toxic
if any of its label rows says so. Null and empty lang are one part. Extra columns are ignored; no rows give no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Bytes of texts that a task's chains hold before they go on.
HELD = 48 << 20
#: Rows of a partition of chains, on average.
ROWS = 50_000
#: Parts of a part's vectors that are merged by themselves first.
SALTS = 16
#: Cells of a part: mask, quality is 1, toxic is 1.
SHAPE = (32, 2, 2)
UPPER = bytes(range(65, 91))
SIGNS = b"#$%&*|"


def failures(text: str, raw: bytes) -> int:
    """The mask of the filters A to D that a text fails."""
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * upper > 3 * len(text)) << 2
        | (len(raw.translate(None, SIGNS)) < len(raw)) << 3
    )


Row = tuple[tuple, tuple]


def routed(rows: Iterator[tuple]) -> Iterator[Row]:
    """(id, text, part) of one task as ((where to, fingerprint, id), (text, part, mask, rows)): certain copies and ids of null
    without a text, dealt evenly, and the least of each text with it."""
    chains: dict[int, dict[bytes, list]] = {}
    held = 0

    def ended() -> Iterator[Row]:
        for fingerprint, chain in chains.items():
            for raw, (least, parts, mask) in chain.items():
                for part, n in parts.items():
                    yield (fingerprint, fingerprint, least), (raw, part, mask, n)

    for k, (i, text, part) in enumerate(rows):
        text = text or ""
        raw, away = text.encode(), xxhash.xxh64_intdigest(str(k))
        if i is None:
            yield (away, None, None), (None, part, failures(text, raw), 1)
            continue
        fingerprint = xxhash.xxh64_intdigest(raw)
        chain = chains.setdefault(fingerprint, {})
        known = chain.get(raw)
        if known is None:
            chain[raw] = [i, {part: 1}, failures(text, raw)]
            held += len(raw) + 200
        elif i == known[0]:
            known[1][part] = known[1].get(part, 0) + 1
        elif i > known[0]:
            yield (away, None, i), (None, part, known[2] | 16, 1)
        else:
            for old, n in known[1].items():
                yield (away, None, known[0]), (None, old, known[2] | 16, n)
            known[:2] = [i, {part: 1}]
        if held > HELD:
            yield from ended()
            chains.clear()
            held = 0
    yield from ended()


def order_of(key: tuple) -> tuple:
    """Rows without a text first, then by fingerprint and id."""
    return (0,) if key[1] is None else (1, key[1], key[2])


def settled(rows: Iterator[Row]) -> Iterator[tuple]:
    """Rows of a partition in the order of ``order_of`` as (id, part, mask, rows): ids above a text's first are copies."""
    now, chain = None, {}
    for (_, fingerprint, i), (raw, part, mask, n) in rows:
        if raw is not None:
            if fingerprint != now:
                now, chain = fingerprint, {}
            mask |= 16 * (chain.setdefault(raw, i) < i)
        yield i, part, mask, n


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and n: n rows of that id and part which fail these filters."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit(""))).rdd.mapPartitions(routed)
    many = max(rows.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS)
    dealt = rows.repartitionAndSortWithinPartitions(many, lambda key: key[0], keyfunc=order_of)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.sparkSession.createDataFrame(dealt.mapPartitions(settled), f"doc_id {kind}, part string, mask int, n long", verifySchema=False)


def vectors(rows: DataFrame) -> RDD:
    """(part, counts by mask and labels) from rows with part, mask, good, toxic and n."""

    def cells(index: int, rows: Iterator) -> Iterator[tuple]:
        for r in rows:
            yield (r.part, index % SALTS), (r.mask, int(r.good), int(r.toxic), r.n)

    def added(counts: np.ndarray, cell: tuple) -> np.ndarray:
        counts[cell[:3]] += cell[3]
        return counts

    salted = rows.rdd.mapPartitionsWithIndex(cells).combineByKey(lambda cell: added(np.zeros(SHAPE, np.int64), cell), added, np.add)
    return salted.map(lambda x: (x[0][0], x[1])).combineByKey(lambda c: c, np.add, np.add)


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders(part: str, counts: np.ndarray) -> list[tuple]:
    """The rows of a part: each order's steps, and for each filter what it removes in all orders together."""
    mask = np.arange(32)
    total, good, toxic = counts.sum(axis=(1, 2)), counts[:, 1].sum(axis=1), counts[:, :, 1].sum(axis=1)
    out, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        gone = np.zeros(32, bool)
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails = mask & bit > 0
            here = fails & ~gone
            redundant, gone = total[fails & gone].sum(), gone | fails
            removed = int(total[here].sum())
            shapley[name] += removed
            out.append((part, "".join(order), step, int(total[~gone].sum()), removed, int(redundant), int(total[bit]), int(good[here].sum()), int(toxic[here].sum())))
    return [(*row, shapley[row[1][row[2] - 1]]) for row in out]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    said = labels.groupBy("doc_id").agg(is_one("quality"), is_one("toxic")).where("quality or toxic")
    no = F.lit(False)
    rows = masks(docs).join(said, "doc_id", "left").select("part", "mask", F.coalesce("quality", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")
    return docs.sparkSession.createDataFrame(vectors(rows).flatMap(lambda x: orders(*x)), REPORT, verifySchema=False)


#: The query in DuckDB.
TWIN = r"""
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
said as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, map {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) over (partition by text), false)} as fails
  from w left join said on w.doc_id = said.doc_id),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
p as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, substr(filter_order, step, 1) as x, string_split(substr(filter_order, 1, step - 1), '') as earlier from p, (select unnest(range(1, 6)) as step)),
g as (select part, good, toxic, fails, count(*) as n from f group by all),
t as (select part, filter_order, step, x, g.n, good, toxic, fails[x] as here, len(list_filter(earlier, lambda e: e <> '' and fails[e])) > 0 as before,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda e: fails[e])) as many from g, s),
r as (select part, filter_order, step, x, sum(case when not here and not before then n else 0 end) as kept, sum(case when here and not before then n else 0 end) as removed,
    sum(case when here and before then n else 0 end) as redundant, sum(case when here and many = 1 then n else 0 end) as unique_fails,
    sum(case when here and not before and good then n else 0 end) as good_lost, sum(case when here and not before and toxic then n else 0 end) as toxic_lost
  from t group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
  cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
  cast(sum(removed) over (partition by part, x) as bigint) as shapley
from r
"""
