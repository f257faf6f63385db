"""Near-duplicate documents: MinHash signatures, banding, signature and full-set verification, and connected components.

Words are runs without white space, A-Z lower-cased; a document's set holds its distinct shingles of ``width`` words, or
the whole sequence as one if it is shorter. Two documents are linked if 100 * intersection >= percent * union. The steps:

1. One pass over all texts gives each document its number of shingles, a 128-bit key of its set, ``BANDS`` bucket numbers
   and a signature of ``BANDS * ROWS`` universal hash minima (a byte of each). Documents with the same key are one class,
   whose id is their smallest doc_id; only classes go on.
2. In each bucket with several classes, all are paired with the smallest and the largest: stars, not all pairs. Pairs
   whose sizes or signatures can't reach the threshold go; the others are compared on their full sets.
3. Components of the links come from alternating large-star and small-star. Buckets whose classes fell into several
   components are taken again, so that no link within a bucket is left out: in buckets of at most ``SMALL`` classes, those
   outside the smallest class's component against all of other components; and for larger buckets an exact prefix join:
   with shingles ordered from rare to common, linked sets share a shingle among their first few, at places that leave
   room for the rest of what they share.

Two documents at the threshold share a bucket with probability 1 - (1 - 0.8^6)^40 = 1 - 5e-6, and the signature test
lets them through with probability over 1 - 1e-7.

Null and wordless texts have an empty set and are linked with nothing. Rows with a null id have a null component and
aren't kept. Repeated rows of one id come out each; if their texts differ, each row has its own text's component, and
classes that the same id stands for, as their least, are one. Extra columns are ignored, or kept as they are by ``kept_rows``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, map_rows, python_step, slices, written

BANDS, ROWS = 40, 6
#: Pairs with a smaller share of equal signature bytes are no candidates: 6 standard deviations below 0.8.
SLACK = 0.155
CACHED_WORDS = 200_000
#: Ids of candidates are broadcast up to so many (8 bytes each); beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Classes of a bucket that may be paired with each other.
SMALL = 24
#: Columns of a block when minima are taken.
BLOCK = 1024
#: Nodes with more than one of so many parts of the rows, and more rows than a task minds, are hubs.
HUBS, HUB_ROWS = 100_000, 500

_seeds = np.random.default_rng(11)
#: The universal family: a * x + b modulo 2^32, a odd, on hashes of 32 bits.
A = (_seeds.integers(0, 2**31, BANDS * ROWS, np.uint32) << np.uint32(1)) | np.uint32(1)
B = _seeds.integers(0, 2**32, BANDS * ROWS, np.uint32)
#: Odd factors that give a word's place in a shingle.
PLACES = _seeds.integers(0, 2**62, 64, np.uint64) * np.uint64(2) + np.uint64(1)
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


def shingler(width: int):
    """A function of a text that gives the sorted 64-bit hashes of its distinct shingles."""
    known: dict[bytes, int] = {}

    def of(text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: only A-Z, and only the six white-space bytes
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > CACHED_WORDS:
            known.clear()
        try:
            h = np.array([known[w] for w in words], np.uint64)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in words], np.uint64)
        if len(h) < width:
            return mixed(np.array([(h * PLACES[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))]))
        total = h[: len(h) - width + 1] * PLACES[0]
        for k in range(1, width):
            total += h[k : len(h) - width + 1 + k] * PLACES[k]
        return np.unique(mixed(total))

    return of


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(A), 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), BLOCK):
        np.minimum(least, (np.multiply.outer(A, x[k : k + BLOCK]) + B[:, None]).min(axis=1), out=least)
    return least


def buckets(least: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band, its place included."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    return mixed((rows * PLACES[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * PLACES[ROWS]).view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key, buckets and signature; null key, buckets and signature for an empty set."""

    def make():
        of = shingler(width)

        def run(ids, texts):
            sizes, keys, bands, signs = [], [], [], []
            for t in texts:
                s = of(t)
                sizes.append(len(s))
                least = minima(s) if len(s) else None
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(buckets(least) if len(s) else None)
                signs.append((least & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            return [ids, sizes, keys, pa.array(bands, pa.list_(pa.int64())), signs]

        return run

    return map_rows(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles bigint, set_key binary, buckets array<bigint>, signature binary", make)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures may reach the threshold."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    kind = dict(pairs.dtypes)["a"]

    def run(a, b, x, y):
        joined = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
        keep = np.flatnonzero((joined(x) == joined(y)).mean(axis=1) >= percent / 100 - SLACK)
        return [[a[i] for i in keep], [b[i] for i in keep]]

    return map_rows(both.select("a", "b", "s_a", "s_b"), f"a {kind}, b {kind}", lambda: run)


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose ids a written table has."""
    ids = ids.withColumnRenamed("id", "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def shingle_sets(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """id and shingles (the bytes of sorted 64-bit hashes) of a written table of ids."""

    def make():
        of = shingler(width)
        return lambda ids, texts: [ids, [of(t).tobytes() for t in texts]]

    return map_rows(texts_of(ids, docs), f"id {dict(ids.dtypes)['id']}, shingles binary", make)


def shingle_lists(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """id, n and h: the number of shingles and their hashes. One Python step, as each further one in a task keeps a worker of its own."""

    def make():
        of = shingler(width)

        def run(ids, texts):
            sets = [of(t).view(np.int64) for t in texts]
            return [ids, [len(s) for s in sets], pa.array(sets, pa.list_(pa.int64()))]

        return run

    return map_rows(texts_of(ids, docs), f"id {dict(ids.dtypes)['id']}, n bigint, h array<bigint>", make)


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a written table) that are links by their full sets."""
    kind = dict(pairs.dtypes)["a"]
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = written(shingle_sets(ids, docs, width), "sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(a, b, x, y):
        keep = []
        for i, (s, t) in enumerate(zip(x, y)):
            same = len(np.intersect1d(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), assume_unique=True))
            if 100 * same >= percent * (len(s) // 8 + len(t) // 8 - same):
                keep.append(i)
        return [[a[i] for i in keep], [b[i] for i in keep]]

    links = written(map_rows(both.select("a", "b", "s_a", "s_b"), f"a {kind}, b {kind}", lambda: run), "links")
    dropped(sets)
    dropped(ids)
    return links


def prefix_pairs(members: DataFrame, docs: DataFrame, width: int, percent: int, made: list[DataFrame] | None = None) -> DataFrame:
    """Pairs (a, b) of the members (a written table: id, component, outside) that may be links between components, without
    loss: every pair of at least ``percent``, one of them outside, of different components, comes out. The tables that the result reads are added to ``made``."""
    listed = shingle_lists(members.select("id"), docs, width)
    shingles = written(listed.distinct().select("id", "n", F.explode("h").alias("h")), "shingles")
    ranked = shingles.join(shingles.groupBy("h").count(), "h")
    order = Window.partitionBy("id").orderBy("count", "h")
    # linked sets share at least percent of the larger, so a shingle of the larger's first n - ceil(p n / 100) + 1
    first = ranked.withColumn("at", F.row_number().over(order)).where(f"at <= n - ceil({percent} * n / 100) + 1").join(members, "id")
    first = written(first.select("h", "id", "n", "at", "component", "outside"), "prefixes")
    dropped(shingles)
    if made is not None:
        made.append(first)
    side = lambda c: first.select("h", *[F.col(k).alias(f"{k}_{c}") for k in ("id", "n", "at", "component", "outside")])
    low, high = side("y"), side("x")
    # the smaller's share of both is 2 p / (100 + p) of itself at least
    low = low.where(f"at_y <= n_y - ceil(2 * {percent} * n_y / {100 + percent}) + 1")
    room = F.expr(f"1 + least(n_x - at_x, n_y - at_y) >= {percent} * (n_x + n_y) / {100 + percent}")
    fits = (F.col("component_x") != F.col("component_y")) & ((F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("id_x") > F.col("id_y")))) & F.expr(f"100 * n_y >= {percent} * n_x") & room
    pairs = [high.where(a).join(low.where(b), "h").where(fits) for a, b in (("outside_x", "true"), ("not outside_x", "outside_y"))]
    return pairs[0].union(pairs[1]).select(*paired("id_x", "id_y"))


def tied(rows: DataFrame, size: int) -> DataFrame:
    """(a, b, m): each row with the least ``b`` of its ``a``. Nodes with a large part of the rows are so few that their least
    is broadcast, so no task holds all rows of such a node; the others are joined."""
    least = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    many = max(HUB_ROWS, size // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > many).select("a", "m"))  # at most 2 * HUBS
    rest = least.where(F.col("n") <= many).select("a", "m")
    return rows.join(hubs, "a").select("a", "b", "m").union(rows.join(hubs, "a", "left_anti").join(rest, "a").select("a", "b", "m"))


def large_star(edges: DataFrame, size: int) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return tied(both, size).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def small_star(edges: DataFrame, size: int) -> DataFrame:
    """The node and its lesser neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    told = tied(down, size)
    return told.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(told.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id) of every node of the links (a, b): the two stars by turns until nothing changes."""
    edges = written(links.select("a", "b").where("a != b").distinct(), "edges")
    told, size = None, edges.count()
    while True:
        large = written(large_star(edges, size), "edges")
        stars = written(small_star(large, size), "edges")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        dropped(edges)
        dropped(large)
        edges = stars
        if tuple(now) == told:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        told, size = tuple(now), now[0]


def paired(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def clusters(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept."""
    return keyed_clusters(docs, width, percent).drop("set_key")


def keyed_clusters(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """As ``clusters``, with the key of each row's set."""
    signed = written(signatures(docs, width), "signed")
    least = signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    # joined by id and key, which no two classes share; repeated rows of an id are the same class
    classes = written(signed.withColumnRenamed("doc_id", "id").join(least, ["id", "set_key"]).select("id", "set_key", "n_shingles", "buckets", "signature"), "classes")
    rows = classes.select("id", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members = written(rows.join(shared, "bucket").select("bucket", "id", "low", "high"), "members")

    def verified(pairs: DataFrame) -> DataFrame:
        held = written(likely(pairs.distinct(), classes, percent), "pairs")
        links = confirmed(held, docs, width, percent)
        dropped(held)
        return links

    stars = [members.where(f"id != {hub}").select(*paired("id", hub)) for hub in ("low", "high")]
    links = verified(stars[0].union(stars[1]))
    found = components(links)
    # members of buckets that hold several components, with the member's and with the least id's component
    named = members.join(found, "id", "left").select("bucket", "id", "low", F.coalesce("component", "id").alias("component"))
    spread = named.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.max(F.when(F.col("id") == F.col("low"), F.col("component"))).alias("low_component")).where("c1 < c2")
    left = written(named.join(spread.drop("c1", "c2"), "bucket"), "left")
    dropped(members)
    small = left.where(F.col("size") <= SMALL)
    outside = small.where("component != low_component").select("bucket", F.col("id").alias("x"), F.col("component").alias("cx"))
    across = outside.join(small.select("bucket", F.col("id").alias("y"), F.col("component").alias("cy"), "low_component"), "bucket").where("cx != cy and (cy = low_component or x < y)")
    large = left.where(F.col("size") > SMALL).groupBy("id", "component").agg(F.max(F.col("component") != F.col("low_component")).alias("outside"))
    large = written(large, "large")
    made: list[DataFrame] = []
    more = verified(across.select(*paired("x", "y")).union(prefix_pairs(large, docs, width, percent, made)))
    last = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    for t in (links, found, left, large, more, *made):
        dropped(t)
    found = last
    named = classes.select("id", "set_key").distinct().join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    named = written(named, "named")
    for t in (classes, found):
        dropped(t)
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), "set_key")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def kept_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one document of each group. Rows with a null id stay out of
    the comparison and stay. Where rows share an id, each is judged by its own text, and of rows with one id and one set the
    first by text stays (of rows alike in both any one); texts without a word are no copies and stay."""
    told = written(keyed_clusters(docs, width, percent).where("doc_id is not null"), "told")
    shared = written(told.groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared")
    gone = written(told.where("not kept").select("doc_id").union(shared).distinct(), "gone")
    # rows that share an id are few; only they are told apart by their sets
    again = written(docs.join(shared, "doc_id", "left_semi").select(*docs.columns), "again")
    keys = told.join(shared, "doc_id", "left_semi").where("kept and set_key is not null").select("doc_id", "set_key").distinct()
    by_key = signed_rows(again, width)
    first = Window.partitionBy("doc_id", "_set").orderBy("text", F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind]))
    one = by_key.where("_set is not null").join(keys.withColumnsRenamed({"doc_id": "_id", "set_key": "_key"}), (F.col("doc_id") == F.col("_id")) & (F.col("_set") == F.col("_key")), "left_semi")
    one = one.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(*docs.columns)
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    return out.union(one).union(by_key.where("_set is null").select(*docs.columns))


def signed_rows(docs: DataFrame, width: int) -> DataFrame:
    """docs with ``_set``, the key of each row's set; null for an empty set."""

    def make():
        of = shingler(width)

        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    sets = [of(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                    yield part.append_column("_set", pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()))

        return run

    return python_step(docs, make(), docs.withColumn("_set", F.lit(None).cast("binary")).schema)
