"""Secret scan over a trigram inverted index, in DataFrame functions only.

``trigram_query`` derives from a regular expression what any match must contain: a list of parts that must all hold,
each a list of alternatives, each a set of trigrams (lower case) that must all occur. Rules without a part have no
mandatory trigram and scan every text. ``scan`` builds postings (trigram, row) for the trigrams that the rules' queries
use, joins them with the queries' alternatives, and intersects them by counting per row; only those candidates, joined
back by row, are verified with the rule's regular expression, over the whole text.

Spans are code points, ends exclusive: starts are running sums of the lengths between and within matches. Null texts
count as empty: no spans. Equal texts give equal spans; repeated rows come out each. Extra columns are ignored.
"""

from __future__ import annotations

import re._constants as op
import re._parser as regex_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that a part of a query may expand to; beyond, the part is cut there.
EXPANSION = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    #: Understood alike by Java's and Python's regular expressions.
    pattern: str
    #: Group whose length counts, and its least length: shorter matches are dropped.
    group: int = 0
    least: int = 1


# The base rules, then those that the method adds.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # the same as AKIA[A-Z0-9]+ of 20 or more: nothing after a start within a run is longer
    Rule("hex", r"[0-9a-f]{24,}"),  # runs are maximal either way
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)


def _members(items: list) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < EXPANSION:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _strings(node) -> set[str] | None:
    """All strings that a node of a parsed expression matches, if they are few."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        return _members(value)
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] <= 2:
        one = _sequence(value[2])
        return None if one is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(one, repeat=n)}
    return {""} if kind is op.AT else None


def _sequence(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(found) * len(more) > EXPANSION:
            return None
        found = {a + b for a in found for b in more}
    return found


def _parts(nodes) -> list[set[str]]:
    """Sets of strings, of each of which every match contains one."""
    found, held = [], {""}
    for node in nodes:
        more = _strings(node)
        if more is not None and len(held) * len(more) <= EXPANSION:
            held = {a + b for a in held for b in more}
            continue
        found.append(held)
        held = more if more is not None and len(more) <= EXPANSION else {""}
        if more is None and node[0] is op.SUBPATTERN:
            found += _parts(node[1][3])
        elif more is None and node[0] is op.MAX_REPEAT and node[1][0] >= 1:
            found += _parts(node[1][2])
    return [*found, held]


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Parts, alternatives and trigrams that a text with a match must have; no part: it must be scanned."""
    query = []
    for strings in _parts(regex_parser.parse(pattern)):
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(sets):
            query.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))
    return query


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text") -> DataFrame:
    """row_key and kinds: the rules that a row's trigrams leave possible. Rules that have no query aren't listed."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    clauses = [(t, kind, p, a, len(alt), len(query)) for kind, query in queries.items() for p, part in enumerate(query) for a, alt in enumerate(part) for t in sorted(alt)]
    table = F.broadcast(docs.sparkSession.createDataFrame(clauses, "trigram string, kind string, part int, alternative int, trigrams int, parts int"))  # as long as the rules' text
    low = docs.select("row_key", F.lower(text).alias("low"))
    postings = low.select("row_key", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), t) for t in sorted({c[0] for c in clauses})]))).alias("trigram"))
    # a row's postings are brought together once; the counts below need no further exchange
    met = postings.join(table, "trigram").repartition("row_key").groupBy("row_key", "kind", "part", "alternative", "trigrams", "parts").agg(F.count_distinct("trigram").alias("n")).where("n = trigrams")
    whole = met.groupBy("row_key", "kind", "parts").agg(F.count_distinct("part").alias("n")).where("n = parts")
    return whole.groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))  # at most one entry a rule


def matches(rule: Rule, text: Column) -> Column:
    """Each match with the code points before it since the last one, its length, and whether it counts."""
    rx = F.lit(rule.pattern)
    whole, between = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, rule.pattern, -1)
    counted = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.group else whole
    return F.transform(F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), counted.alias("counted")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["counted"]) >= rule.least).alias("good")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text") -> DataFrame:
    """doc_id and spans, an array of (start, rank, kind, end) by start, then the rules' order."""
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    asked = {r.kind for r in rules if trigram_query(r.pattern)}
    # no key repeats but for repeated rows, which the row number keeps apart
    both = rows.join(candidates(rows, rules), "row_key", "left").withColumn("row_number", F.monotonically_increasing_id())
    none = F.array().cast("array<struct<gap: int, size: int, good: boolean>>")
    found = [F.when(F.array_contains("kinds", r.kind), matches(r, F.col("text"))).otherwise(none) if r.kind in asked else matches(r, F.col("text")) for r in rules]
    listed = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(r.kind).alias("kind"), m.alias("m")) for k, (r, m) in enumerate(zip(rules, found))])
    by_rule = both.select("row_key", "row_number", "doc_id", F.explode(listed).alias("r"))
    each = by_rule.select("row_key", "row_number", "doc_id", "r.rank", "r.kind", F.posexplode_outer("r.m").alias("at", "m"))
    before = "over (partition by row_key, row_number, rank order by at rows between unbounded preceding and current row)"
    placed = each.select("row_key", "row_number", "doc_id", "rank", "kind", "m.good", "m.size", F.expr(f"sum(m.gap + m.size) {before}").alias("end"))
    span = F.when(F.col("good"), F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "kind", "end"))
    return placed.groupBy("row_key", "row_number").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans")).select("doc_id", "spans")


def digests(docs: DataFrame) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    return scan(docs).select("doc_id", *counts, F.sha2(joined(F.expr(f"filter(spans, x -> x.kind in ({base}))")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def twin() -> str:
    """The same in DuckDB's SQL, without an index."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"select n, {k} as rank, {quoted(r.kind)} as kind, unnest(string_split_regex(t, {quoted(r.pattern)})) as gap, unnest(regexp_extract_all(t, {quoted(r.pattern)}, 0)) as hit, unnest(regexp_extract_all(t, {quoted(r.pattern)}, {r.group})) as counted, unnest(range(1, len(regexp_extract_all(t, {quoted(r.pattern)}, 0)) + 2)) as pos, {r.least} as least from d"
        for k, r in enumerate(BASE + MORE)
    ]
    kinds = ", ".join(quoted(r.kind) for r in BASE)
    return f"""
with d as (select row_number() over () as n, doc_id, coalesce(text, '') as t from documents),
m as ({' union all '.join(parts)}),
p as (select *, sum(length(gap) + length(hit)) over (partition by n, rank order by pos) as e from m where hit is not null),
s as (select n, rank, kind, cast(e - length(hit) as bigint) as s, cast(e as bigint) as e from p where length(counted) >= least),
g as (select n, {', '.join(f"count(*) filter (kind = {quoted(r.kind)}) as n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (kind in ({kinds})) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from s group by n)
select doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) as n_{r.kind}' for r in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (n)
"""
