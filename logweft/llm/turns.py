"""Repair of conversations whose turns are damaged: the cheapest edits that give a legal order of roles.

Rows are a conversation's by ``conv_id``, in the order of turn (nulls first), role and the md5 of the text. A row's first fault counts: blank, duplicate
(role and text seen earlier), truncated (its last character that isn't white space is none of ``.!?``). Legal role initials are
``(s?(ua)+)?``. Edits and their letters: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only one for blank and
duplicate rows), Insert an empty user or assistant turn 2; truncated rows that stay cost 1 more. Of the cheapest edits those
whose letters are ASCII-least count.

1. Spark deals conversations by the hash of their id and sorts each task's rows from a conversation's last turn to its first.
2. A task takes batches of ``BATCH`` rows. In each, one recursive DuckDB query runs over all conversations of the batch at once:
   each recursion advances one turn and keeps, for each state of the grammar, the least (cost, audit) from there to the end.
   From the last turn to the first, as then a letter comes before an audit and ties stay in order, which they don't if letters are
   appended to audits of different lengths. A conversation longer than a batch goes on in the next from its states' best.
3. Letters and rows meet by another sort from first to last, and the repaired turns go through SHA-256 as they come.

A task holds a batch, not a conversation, but for the audit, which is a column of the result. A conversation is one
sequence, so its digest takes one task, however long it is; and the audits that a recursion makes anew make time grow with
the square of the turns for conversations of many 10,000 turns.

Nulls in role and text are one space, as in the key of the damage; a null turn comes first and doesn't count for gaps, rows of
a null conv_id are a conversation. An empty role has no initial: it is never legal. Repeated rows are duplicates of the
first. Extra columns are ignored, and no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a recursion takes together.
BATCH = 40_000

STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1


def inserts(state: str) -> list[tuple[str, int, str]]:
    """(state, cost, letters) after no, one or two inserted turns; more come back to a state that there was."""
    out = [(state, 0, "")]
    for n in (1, 2):
        state = next(b for r, b in STATES[state].items() if r != "s")
        out.append((state, n * INSERT, "I" * n))
    return out


def moves() -> list[tuple[str, str, bool, str, int, str]]:
    """(initial, fault, from, to, cost, letters) of all inserts before a row and the row's own edit."""
    out = []
    for initial in ("s", "u", "a", "-"):
        for fault in ("drop", "cut", "none"):
            for start in STATES:
                for state, cost, letters in inserts(start):
                    out.append((initial, fault, start, state, cost + DELETE, letters + "D"))
                    if fault == "drop":
                        continue
                    more = cost + CUT * (fault == "cut")
                    if initial in STATES[state]:
                        out.append((initial, fault, start, STATES[state][initial], more + KEEP, letters + "K"))
                    for role in ("u", "a"):
                        if role in STATES[state]:
                            out.append((initial, fault, start, STATES[state][role], more + REROLE, letters + "R"))
    return out


def endings() -> list[tuple[str, int, str]]:
    """(state, cost, letters) of what is left to do after the last row."""
    return [(s, *min((cost, letters) for state, cost, letters in inserts(s) if state in ("", "a"))) for s in STATES]


ADVANCE = """
with recursive best(conv, step, state, cost, audit) as (
  select conv, 0::bigint, state, cost, audit from seeds
  union all
  select conv, any_value(step) + 1, state, min(b).cost, min(b).audit from (
    select best.conv, best.step, m.start as state, row(m.cost + best.cost, m.letters || best.audit)::struct(cost bigint, audit varchar) as b
    from best join turns t on t.conv = best.conv and t.step = best.step + 1
    join moves m on m.stop = best.state and m.initial = t.initial and m.fault = t.fault)
  group by conv, state)
select b.conv, b.state, b.cost, b.audit from best b join (select conv, max(step) as step from turns group by conv) using (conv, step)
"""


def solver():
    """A function of batches of (conversation, initial, fault), last turn first, and of the best from a conversation's later turns."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
    rows = moves()
    columns = dict(zip(("initial", "fault", "start", "stop", "cost", "letters"), map(list, zip(*rows)), strict=True))
    con.register("moves_now", pa.table(columns))
    con.execute("create table moves as select distinct * from moves_now")
    ends = endings()

    def solve(convs: list[int], steps: list[int], initials: list[str], faults: list[str], seeds: dict[int, list[tuple[str, int, str]]]) -> dict[int, list[tuple[str, int, str]]]:
        begin = [(c, *s) for c in dict.fromkeys(convs) for s in seeds.get(c, ends)]
        con.register("turns_now", pa.table({"conv": pa.array(convs, pa.int64()), "step": pa.array(steps, pa.int64()), "initial": initials, "fault": faults}))
        con.register("seeds_now", pa.table({"conv": pa.array([b[0] for b in begin], pa.int64()), "state": [b[1] for b in begin], "cost": pa.array([b[2] for b in begin], pa.int64()), "audit": [b[3] for b in begin]}))
        con.execute("create or replace temp table turns as from turns_now")
        con.execute("create or replace temp table seeds as from seeds_now")
        out: dict[int, list[tuple[str, int, str]]] = {}
        for conv, *best in con.execute(ADVANCE).fetchall():
            out.setdefault(conv, []).append(tuple(best))
        return out

    return solve


def solved(rows: DataFrame, kind: str, batch_rows: int) -> DataFrame:
    """conv_id, cost and audit. Rows of a task come a conversation after the other, each from its last turn to its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = solver()
        schema = pa.schema([("conv_id", id_type), ("cost", pa.int64()), ("audit", pa.string())])
        names: list = []  # the conversations of the batch; the last may go on
        convs: list[int] = []
        steps: list[int] = []
        initials: list[str] = []
        faults: list[str] = []
        seeds: dict[int, list[tuple[str, int, str]]] = {}

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal seeds
            best = solve(convs, steps, initials, faults, seeds) if convs else {}
            best = {**seeds, **best}
            ended = len(names) if last else len(names) - 1
            found = [next((cost, audit) for state, cost, audit in best[k] if state == "") for k in range(ended)]
            out = pa.RecordBatch.from_arrays([pa.array(names[:ended], id_type), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], schema=schema)
            seeds = {} if last else {0: best[len(names) - 1]}
            del names[:ended], convs[:], steps[:], initials[:], faults[:]
            return out

        for batch in batches:
            for conv, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not names or names[-1] != conv:
                    if len(convs) >= batch_rows:
                        yield flush(True)
                    names.append(conv)
                    step = 0
                elif len(convs) >= batch_rows:
                    yield flush(False)
                    step = 0
                step += 1
                convs.append(len(names) - 1)
                steps.append(step)
                initials.append(initial)
                faults.append(fault)
        if names:
            yield flush(True)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    id_type = to_arrow_type(StructType.fromDDL(f"conv_id {kind}").fields[0].dataType)
    return rows.select("conv_id", "initial", "fault").mapInArrow(run, f"conv_id {kind}, cost long, audit string")


def repaired(rows: DataFrame, kind: str) -> DataFrame:
    """conv_id and repaired_sha256. Each conversation's first row has its audit, the others role and text, first turn first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, audit, at, state, sha, any_yet = None, None, 0, "", None, False

        def say(role: str, text: str, initial: str) -> None:
            nonlocal state, any_yet
            sha.update((("\n" if any_yet else "") + role + ":" + text).encode())
            any_yet, state = True, STATES[state][initial]

        def insert() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                role = "assistant" if state == "u" else "user"
                say(role, "", role[0])
                at += 1

        for batch in batches:
            for name, letters, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if letters is not None:
                    if audit is not None:
                        insert()
                        out.append((conv, sha.hexdigest()))
                    conv, audit, at, state, sha, any_yet = name, letters, 0, "", hashlib.sha256(), False
                    continue
                insert()
                letter, at = audit[at], at + 1
                if letter == "R":
                    role = "assistant" if state == "u" else "user"
                if letter != "D":
                    say(role, text, role[0])
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], id_type), pa.array([o[1] for o in out], pa.string())], schema=schema)
            out.clear()
        if audit is not None:
            insert()
            yield pa.RecordBatch.from_arrays([pa.array([conv], id_type), pa.array([sha.hexdigest()], pa.string())], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    id_type = to_arrow_type(StructType.fromDDL(f"conv_id {kind}").fields[0].dataType)
    schema = pa.schema([("conv_id", id_type), ("repaired_sha256", pa.string())])
    return rows.select("conv_id", "audit", "role", "text").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the crc32 of ``conv_id:turn`` chooses."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", said("conv_id"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


def repair(conversations: DataFrame, rows: DataFrame, batch_rows: int = BATCH) -> DataFrame:
    """For each conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of its ``rows``
    (conv_id, turn, role, text)."""
    kind = dict(conversations.dtypes)["conv_id"]
    keyed = rows.withColumn("key", F.md5("text"))
    text = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    blank = F.length(text) == 0
    cut = ~F.substring(text, -1, 1).isin(".", "!", "?")
    small = keyed.select("conv_id", "turn", "role", "key", blank.alias("blank"), cut.alias("cut")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "key").orderBy("turn")) > 1
    ahead = F.lead(F.substring("role", 1, 1)).over(Window.partitionBy("conv_id").orderBy("turn", "role", "key"))
    marked = small.withColumn("seen", seen).withColumn("pair", F.concat(F.substring("role", 1, 1), ahead))
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("cut"), "truncated")
    marked = marked.withColumn("fault", fault)
    is_a = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = marked.groupBy("conv_id").agg(turns.alias("gaps"), *[is_a(F.col("fault") == n).alias(n) for n in ("blank", "duplicate", "truncated")], is_a(~F.col("pair").isin("su", "ua", "au")).alias("illegal"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("-")
    edits = F.when(F.col("fault").isin("blank", "duplicate"), "drop").when(F.col("fault") == "truncated", "cut").otherwise("none")
    last_first = marked.withColumns({"initial": initial, "edit": edits}).drop("fault").withColumnRenamed("edit", "fault").sortWithinPartitions("conv_id", F.desc("turn"), F.desc("role"), F.desc("key"), F.desc("seen"))
    best = solved(last_first, kind, batch_rows)
    told = best.select("conv_id", "audit", F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("key"), F.lit(0).alias("rank"))
    each = keyed.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "key", F.lit(1).alias("rank"))
    first_first = told.union(each).repartition("conv_id").sortWithinPartitions("conv_id", "rank", "turn", "role", "key")
    texts = repaired(first_first, kind)
    all_ids = conversations.select("conv_id").distinct()
    out = all_ids
    for part in (counts, best, texts):
        part = part.withColumnRenamed("conv_id", "id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


#: The query in DuckDB: the rows after damage, then the best edits from each conversation's last turn to its first.
TWIN = r"""
with recursive bytes as (select list(list_reduce([n::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: if(a & 1 = 1, xor(a >> 1, 3988292384), a >> 1)) order by n) as t from range(256) r(n)),
c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 20 as kind from conversations, bytes),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from c where kind <> 0),
f as (select *, role[1:1] as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as sign from d),
g as (select *, case when sign = '' then 'blank' when nth > 1 then 'duplicate' when sign not in ('.', '!', '?') then 'truncated' else '' end as fault,
    row_number() over (partition by conv_id order by turn desc nulls last, role desc, md5(text) desc, nth desc) as step,
    i || lag(i) over (partition by conv_id order by turn desc nulls last, role desc, md5(text) desc, nth desc) as pair from f),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(step) as n from g group by conv_id),
next(a, i, b) as (values ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
ins(a, b, cost, letters, lines) as (select distinct a, a, 0, '', []::varchar[] from next union all select a, b, 2, 'I', [if(i = 'u', 'user:', 'assistant:')] from next where i <> 's'
  union all select x.a, y.b, 4, 'II', [if(x.i = 'u', 'user:', 'assistant:'), if(y.i = 'u', 'user:', 'assistant:')] from next x join next y on x.b = y.a and x.i <> 's' and y.i <> 's'),
best(conv_id, step, n, state, b) as (
  select conv_id, 0::bigint, n, a, min(row(cost, letters, lines)::struct(cost int, audit varchar, lines varchar[])) from counts, ins where b in ('0', 'a') group by all
  union all
  select conv_id, any_value(step) + 1, n, a, min(row(b.cost + cost + case when op = 'D' then 3 when op = 'R' then 2 else 0 end + case when op <> 'D' and fault = 'truncated' then 1 else 0 end,
      letters || op || b.audit, lines || case when op = 'D' then [] when op = 'R' then [if(to_i = 'u', 'user:', 'assistant:') || text] else [role || ':' || text] end || b.lines)::struct(cost int, audit varchar, lines varchar[]))
  from (select best.conv_id, best.n, best.step, best.b, ins.a, ins.cost, ins.letters, ins.lines, g.fault, g.role, g.text, o.op, o.to_i
    from best join g on best.conv_id is not distinct from g.conv_id and g.step = best.step + 1
    join (select a, b, i as to_i, unnest(['K', 'R']) as op from next union all select distinct a, a, '', 'D' from next) o on o.b = best.state
    join ins on ins.b = o.a
    where op = 'D' or (g.fault not in ('blank', 'duplicate') and (if(op = 'K', o.to_i = g.i, o.to_i <> 's'))))
  group by conv_id, n, a)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(b.b.cost, 0)::bigint as cost, coalesce(b.b.audit, '') as audit, sha256(coalesce(array_to_string(b.b.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) i left join counts on i.conv_id is not distinct from counts.conv_id
left join best b on i.conv_id is not distinct from b.conv_id and b.step = b.n and b.state = '0'
"""
