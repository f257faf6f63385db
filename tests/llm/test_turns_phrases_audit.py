"""Conversation repair, repeated passages and the filter audit against plain versions, and on hard cases."""

import collections
import functools
import hashlib
import itertools
import random
import re
import sys

import numpy as np
import pytest

from logweft.llm import filter_audit, phrases, turns

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
WHITE = " \t\n\x0b\f\r"

# op11


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of rows (turn, role, text) by trying all edits."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    sys.setrecursionlimit(20_000)  # a call for each row and inserted turn
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(k, state, inserted):
        """Least (cost, audit, lines) from the k-th row on."""
        out = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        if inserted < 3:
            for r in follows[state].replace("s", ""):
                cost, audit, lines = best(k, r, inserted + 1)
                out.append((cost + 2, "I" + audit, ({"u": "user:", "a": "assistant:"}[r], *lines)))
        if k < len(rows):
            _, role, text = rows[k]
            cost, audit, lines = best(k + 1, state, 0)
            out.append((cost + 3, "D" + audit, lines))
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                for r in follows[state]:
                    cost, audit, lines = best(k + 1, r, 0)
                    if role[:1] == r:
                        out.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                    if r != "s":
                        out.append((cost + more + 2, "R" + audit, ({"u": "user:", "a": "assistant:"}[r] + text, *lines)))
        return min(out, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    told = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines)))


def repair(spark, conversations, **options):
    rows = spark.createDataFrame([(c, t, r, x, 1) for c, some in conversations.items() for t, r, x in some], "conv_id long, turn long, role string, text string, cost int")
    got = turns.repair(rows, rows.select("conv_id", "turn", "role", "text"), **options).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got}


def random_turns(dice, n):
    text = lambda: dice.choice(["Yes.", "No!", "cut", "", " \t", "What?", "é.", f"t{dice.random()}.", "line\n. "])
    return [(dice.choice([k, k, k, k + 1, None]), dice.choice(["user", "assistant", "user", "assistant", "system", "tool", "u2", " "]), text()) for k in range(n)]


def test_cheapest_edits_against_all(spark):
    dice = random.Random(5)
    conversations = {c: random_turns(dice, dice.randrange(1, 9)) for c in range(300)}
    want = {c: plain_repair(rows) for c, rows in conversations.items()}
    assert repair(spark, conversations) == want
    assert len({w[6] for w in want.values()}) > 100


def test_conversations_longer_than_a_batch(spark):
    dice = random.Random(6)
    conversations = {c: random_turns(dice, n) for c, n in enumerate([200, 1, 7, 90, 6, 2, 50])} | {None: random_turns(dice, 12)}
    want = {c: plain_repair(rows) for c, rows in conversations.items()}
    for batch in (1, 7, 1000):
        assert repair(spark, conversations, batch_rows=batch) == want


def test_ties_take_the_least_letters_of_the_whole_audit(spark):
    """Inserted turns make audits of different lengths, so the least start isn't part of the least whole."""
    dice = random.Random(7)
    conversations = {c: [(k, dice.choice(["user", "assistant", "system"]), f"{k}.") for k in range(9)] for c in range(60)}
    want = {c: plain_repair(rows) for c, rows in conversations.items()}
    assert any("I" in w[6] and "R" in w[6] for w in want.values())
    assert repair(spark, conversations) == want


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two? Three") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    got = turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [] if kind == 0 else [(c, t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert {(r.text, r.role) for r in got} >= {("", "assistant"), ("One Two Three", "assistant"), ("One. Two? Three", "user")}


def test_conversations_without_rows(spark):
    none = "conv_id long, turn long, role string, text string"
    some = spark.createDataFrame([(1, 0, "user", "Hi.")], none)
    (row,) = turns.repair(some, some.where("false")).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", sha(""))
    assert turns.repair(some.where("false"), some.where("false")).collect() == []


# op12

DOCS = "doc_id long, text string, n_words long, phrases string, key int, first long"


def plain_recurring(rows):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    owner = {}
    for i, w in texts:
        for k in range(len(w) - 49):
            h = tuple(w[k : k + 50])
            if i is not None:
                owner[h] = min(i, owner.get(h, i))
    out = []
    for i, w in texts:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if i is not None and owner[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        out.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def recurring(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOCS).repartition(4)
    return [tuple(r) for r in phrases.recurring(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]


ids = lambda rows: sorted(rows, key=str)


def test_recurring_windows_against_all(spark):
    dice = random.Random(3)
    word = lambda: dice.choice(["ab", "é", "x" * 300, "Word", "word", "w1", "w2", "w3", "w4", "w5", *[f"v{dice.randrange(400)}" for _ in range(20)]])
    some = lambda n: [word() for _ in range(n)]
    shared = [some(n) for n in (49, 50, 51, 70, 120, 300)]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(dice.randrange(4)):
            passage = dice.choice(shared)
            a, b = (0, len(passage)) if dice.random() < 0.4 else sorted(dice.sample(range(len(passage) + 1), 2))
            parts += [some(dice.randrange(30)), passage[a:b]]
        rows.append((dice.randrange(10**6), dice.choice([" ", "\n", "\t "]).join(itertools.chain(*parts, some(dice.randrange(40))))))
    rows += [(i, rows[i % 5][1]) for i in range(40)]  # copies
    rows += [rows[7], rows[7], (rows[8][0], rows[9][1]), (None, rows[3][1]), (None, None), (5, ""), (6, " \n"), (7, "one two")]
    rows += [(2_000_000 + i, " ".join(["same"] * (48 + i))) for i in range(5)]  # one word repeated
    want = plain_recurring(rows)
    assert ids(recurring(spark, rows)) == ids(want)
    assert 0 < sum(0 < w[2] < w[1] for w in want) and sum(w[2] == w[1] > 0 for w in want) >= 10


def test_nothing_recurs_and_no_rows(spark):
    rows = [(1, "a b c"), (2, " ".join(map(str, range(200))))]
    assert ids(recurring(spark, rows)) == ids(plain_recurring(rows))
    assert phrases.recurring(spark.createDataFrame([], DOCS)).collect() == []


def test_automata_of_many_words(monkeypatch):
    """With more distinct words than code points, a word is two of them, and matches start at words only."""
    texts = [[f"{k}".encode() for k in range(a, a + 90)] for a in (0, 20, 500)]
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    runs = [none, (np.arange(20), np.ones(20, np.int64)), none]
    usual = phrases.covered([1, 2, 3], texts, runs)
    monkeypatch.setattr(phrases, "CODES", 40)
    wide = phrases.covered([1, 2, 3], texts, runs)
    assert [u.tolist() for u in usual] == [w.tolist() for w in wide]
    assert usual[1].sum() == 69 and not usual[0].any() and not usual[2].any()


def test_hashes_of_words_across_blocks(monkeypatch):
    data = b" ".join([b"alpha", b"y" * 5000, b"beta", b"z" * 255, b"alpha"] * 40)
    whole, starts = phrases.word_hashes(data)
    monkeypatch.setattr(phrases, "BLOCK", 700)
    again, same = phrases.word_hashes(data)
    assert (whole == again).all() and (starts == same).all() and len(set(whole.tolist())) == 4


# op13

AUDIT = "doc_id long, text string, lang string, part string, mask int, quality int"


def plain_audit(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (i is not None and first[text] < i)
        mine = [(q, t) for j, q, t in labels if j == i and i is not None]
        parts.setdefault(lang or "", []).append((fails, any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)))
    out = []
    for part, docs in parts.items():
        shapley, steps = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, f in enumerate(order):
                left = [d for d in docs if not set(d[0]) & set(order[:k])]
                here = [d for d in left if f in d[0]]
                shapley[f] += len(here)
                steps.append((part, order, k + 1, len(left) - len(here), len(here), sum(f in d[0] for d in docs) - len(here), sum(d[0] == f for d in docs), sum(d[1] for d in here), sum(d[2] for d in here), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def audit(spark, rows, labels, **held):
    docs = spark.createDataFrame([(*r, "p", 9, 1) for r in rows], AUDIT).repartition(5)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(map(tuple, filter_audit.audit(docs, told).collect()))


def test_audit_against_plain(spark):
    dice = random.Random(9)
    texts = [None, "", "A|B", "é" * 40 + "ABC", " ".join(map(str, range(250))), " ".join(["a", "b"] * 200), " ".join(map(str, range(250))) + " #", "X" * 9 + " ".join(map(str, range(300)))]
    rows = [(dice.randrange(60) if dice.random() < 0.95 else None, dice.choice(texts), dice.choice(["en", "de", None, ""])) for _ in range(300)]
    labels = [(dice.choice([*range(60), None]), dice.choice([0, 1, None]), dice.choice([0, 1, None])) for _ in range(80)]
    assert audit(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_without_rows(spark):
    assert audit(spark, [], []) == []
    rows = [(1, "one", "en")]
    assert audit(spark, rows, []) == plain_audit(rows, [])


def test_chains_tell_colliding_texts_apart(monkeypatch):
    """One fingerprint for all texts, and chains that go on before the task ends."""
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda raw: 7)
    rows = [(3, "x", "en"), (1, "y", "en"), (2, "x", "de"), (2, "x", "en"), (4, "y", "en"), (None, "x", "en"), (1, "y", "en")]
    for held in (0, 10**9):
        monkeypatch.setattr(filter_audit, "HELD", held)
        dealt = sorted(filter_audit.routed(iter(rows)), key=lambda kv: filter_audit.order_of(kv[0]))
        got = collections.Counter()
        for i, part, mask, n in filter_audit.settled(iter(dealt)):
            got[i, part, mask & 16 > 0] += n
        assert got == {(3, "en", True): 1, (1, "en", False): 2, (2, "de", False): 1, (2, "en", False): 1, (4, "en", True): 1, (None, "en", False): 1}


@pytest.mark.parametrize("text, mask", [("", 1), (" ".join(["w"] * 200), 2), (" ".join(map(str, range(200))), 0), ("É" * 300, 1), ("a$", 9), ("AB" + "c" * 64, 1 | 4), ("AB" + "c" * 65, 1)])
def test_limits_of_filters(text, mask):
    assert filter_audit.failures(text, text.encode()) == mask
