"""Each operator against a plain version, and on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweft.llm import bpe, decontam, langid, matroska, minhash, pii_semicrf, quality_mil, queries, secrets_index, url_filter, warc
from logweft.llm.common import change_rows, written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, row_key long, set_key string, spans string, found string, media string, id long"
LONG = "lorem ipsum 1234 " * 20_000 + "x" * 60_000


def docs(spark, *texts, lang="en"):
    """Rows with hard cases besides the texts: null and empty ones, a null id, a repeated row, a very long text, and columns whose names operators use."""
    rows = [*enumerate(texts), (1000, None), (1001, ""), (1002, " \n\t"), (None, "no id here at all"), (1003, "again and again"), (1003, "again and again"), (1004, LONG)]
    return spark.createDataFrame([(i, t, lang, "s", 1, 0.5, "x", 7, "k", "z", "f", "m", 9) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# op1


def test_rules_and_urls(spark):
    cases = {
        "https://A.Example.COM/en/7?x#y": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://x.com/en/1": ("x.com", "/en/1", "com/en/", "block"),
        "http://y.example.net/de/81": ("y.example.net", "/de/81", "example.net/de/8", "block"),
        "http://y.example.net/de/71": ("y.example.net", "/de/71", "net/de/", "allow"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://xcom/en/": ("xcom", "/en/", None, None),
        "http://x.org?q=/es/": ("x.org", "", None, None),
        "nothing": ("", "", None, None),
        "": ("", "", None, None),
    }
    rows = spark.createDataFrame([(1, u) for u in cases] + [(2, None)], "page_id long, url string")
    got = url_filter.judged(rows, queries.RULES, keep=("page_id", "url")).collect()
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in got} == {**cases, None: ("", "", None, None)}


def test_segmentation_is_the_likeliest():
    words = {w: math.log(p) for w, p in {"free": 0.3, "bets": 0.2, "be": 0.2, "ts": 0.01, "cheap": 0.1, "pills": 0.1, "pill": 0.05, "s": 0.04}.items()}
    rng, total = random.Random(3), 10_000
    cost = lambda w: words.get(w, url_filter.unknown(len(w), total))

    def plain(name):
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(name)), k) for k in range(len(name)))
        return max(sum(cost(name[a:b]) for a, b in zip((0, *c), (*c, len(name)))) for c in cuts)

    for _ in range(60):
        name = "".join(rng.choice(["free", "bets", "pill", "s", "q", "be", "ts", "xyz"]) for _ in range(3))
        got = url_filter.segment(name, words, total)
        assert "".join(got) == name and sum(map(cost, got)) == pytest.approx(plain(name))
    assert url_filter.segment("cheappills", words, total) == ["cheap", "pills"] and url_filter.segment("freeqqqbets", words, total) == ["free", "qqq", "bets"]
    assert len(url_filter.segment("x" * 20_000, words, total)) == 1


def test_verdicts_against_plain(spark):
    """Naive Bayes counted and scored one url at a time, with the operator's own splits of names."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in url_filter.filtered(pages, queries.RULES).collect()}
    assert len(got) == pages.count()
    words = collections.Counter(w for r in pages.collect() for w in regex.findall(r"\p{L}+", re.sub("<[^>]*>", " ", r.html or "").lower()))
    total = sum(words.values())
    shares = {w: math.log(n / total) for w, n in words.items()}

    def plain(url):
        if not url or "://" not in url:
            return "", "", None, None
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(r, v) for r, v in queries.RULES if (low == r.split("/")[0] or low.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return low, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))

    tokens = lambda h, p: [(at, w) for at, t in (("h", h), ("p", p)) for n in regex.findall(url_filter.PARTS, t.lower()) for w in url_filter.segment(n, shares, total)]
    told = {r.page_id: plain(r.url) for r in pages.collect()}
    seen = {v: collections.Counter(t for h, p, _, w in told.values() if w == v for t in tokens(h, p)) for v in ("block", "allow")}
    rows, size = collections.Counter(w for *_, w in told.values() if w), len(seen["block"] | seen["allow"])
    odds = lambda t: math.log((seen["block"][t] + 1) / (seen["block"].total() + size + 1)) - math.log((seen["allow"][t] + 1) / (seen["allow"].total() + size + 1)) if t in seen["block"] or t in seen["allow"] else 0.0
    for i, (h, p, rule, verdict) in told.items():
        x = math.log((rows["block"] + 1) / (rows["allow"] + 1)) + sum(map(odds, tokens(h, p)))
        r = got[i]
        assert (r.host, r.path, r.rule) == (h, p, rule) and r.score == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-3)
        assert r.verdict == (verdict or ("block" if x > 0 else "allow")) or abs(x) < 1e-3


def test_url_filter(spark):
    pages = [(n, f"http://free-bets{n}.com/en/{n}", "<p>free bets here</p>") for n in range(20)] + [(50 + n, f"http://news{n}.net/de/{n}", "<p>daily news</p>") for n in range(20)]
    pages += [(90, "http://free-bets.io/win", None), (91, "http://news.io/x", "x"), (92, None, None), (92, None, None), (None, "http://a.org/es/1", "")]
    got = url_filter.filtered(spark.createDataFrame([(*p, "z", 1.0) for p in pages], "page_id long, url string, html string, host string, score double"), queries.RULES).collect()
    by = {r.page_id: r.verdict for r in got}
    assert len(got) == len(pages) and by[90] == "block" and by[91] == "allow" and by[None] == "block" and by[3] == "block" and by[55] == "allow"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filtered(none, queries.RULES).count() == 0


def test_only_frequent_names_are_broadcast(spark, monkeypatch):
    """Every other table grows with the pages, however small its files are."""
    plans, plan = {}, lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(url_filter, "written", lambda df, label: (plans.update({label: plan(df)}), written(df, label))[1])
    plans["result"] = plan(url_filter.filtered(spark.read.parquet(f"{SF}/pages.parquet"), queries.RULES))
    assert {k: n for k, p in plans.items() if (n := p.count("BroadcastHashJoin") + p.count("BroadcastNestedLoopJoin"))} == {"sums": 2}
    assert all(p.count("SortMergeJoin") for k, p in plans.items() if k in ("segments", "worth", "frequent", "sums", "result"))


# op2


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 8 * 16 * 2 + 9])
def test_matroska_round_trip(size):
    payload = matroska.padded(random.Random(size).randbytes(size))
    file = matroska.mux(payload)
    packets, cues = matroska.demux(file)
    assert b"".join(file[o : o + n] for *_, o, n in packets) == payload and [p[1] for p in packets] == sorted(p[1] for p in packets)
    assert all(file[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in cues)
    assert [p[1] for p in packets] == [k * 72_000_000 for k in range(len(packets))]  # 576 samples of 8000 a second
    _, _, clusters = matroska.parsed(file)
    assert cues and all(clusters[at] == t for t, _, at in cues)
    assert len(matroska.demux(file[: len(file) // 2])[0]) <= len(packets)


@pytest.mark.parametrize("way", [matroska.XIPH, matroska.LACED])
def test_lacing_of_unequal_frames(way):
    frames = [b"a" * n for n in (700, 3, 255, 510, 90)]
    body = b"\x81\x00\x05" + bytes([way << 1]) + matroska.laced(frames, way)
    track, time, _, got, places = matroska.frames_of(body, 0, len(body))
    assert (track, time, got) == (1, 5, way) and [body[a : a + n] for a, n in places] == frames


def test_malformed_files_give_no_errors():
    assert matroska.frames_of(b"\x81\x00", 0, 2) is None
    assert matroska.frames_of(b"\x81\x00\x00\x02\x05\xff", 0, 6) is None
    assert matroska.frames_of(b"\x81\x00\x00\x02\x01\x20abc", 0, 9) is None  # the first frame is longer than the block
    rng = random.Random(2)
    file = matroska.mux(matroska.padded(rng.randbytes(9000)))
    for _ in range(400):
        bad = bytearray(file[: rng.randrange(len(file))])
        for _ in range(min(3, len(bad))):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        assert all(n >= 0 and at + n <= len(bad) for *_, at, n in matroska.demux(bytes(bad))[0])


def test_features_against_plain(spark):
    df = docs(spark, "héllo wörld", "a" * 700)
    for r in matroska.read(matroska.store(df, F.col("text"))).collect():
        x = list(r.payload)
        steps = [b - a for a, b in zip(x, x[1:])]
        crossings = sum((a < 128) != (b < 128) for a, b in zip(x, x[1:]))
        n = len(x) // 576
        clusters = -(-n // (matroska.FRAMES_A_BLOCK * matroska.BLOCKS_A_CLUSTER))
        assert r.feature == f"packets={n} cues={clusters} last_ms={(n - 1) * 72} sum={sum(x)} min={min(x)} max={max(x)} steps={sum(s * s for s in steps)} crossings={crossings}"


def test_unknown_sizes_void_and_groups():
    block = b"\x81\x00\x00\x00abc"
    cluster = b"\x1f\x43\xb6\x75\x01" + b"\xff" * 7 + matroska.element(matroska.TIMESTAMP, 7) + matroska.element(0xEC, b"void") + matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, block))
    file = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + cluster + cluster
    packets, _ = matroska.demux(file)
    assert [(p[1], file[p[4] : p[4] + p[5]]) for p in packets] == [(7_000_000, b"abc")] * 2
    assert matroska.demux(None) == matroska.demux(b"no") == ([], [])


def test_media_digests(spark):
    df = docs(spark, "héllo", "a" * 576)
    got = {(r.doc_id, r.n_bytes): r for r in matroska.digests(df).collect()}
    for r in df.collect():
        raw = (r.text or "").encode()
        payload = matroska.padded(raw)
        g = got[r.doc_id, len(raw)]
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert matroska.digests(empty(spark)).count() == 0
    stored = matroska.store(df, F.col("text"))
    assert matroska.packets(stored).where("doc_id = 1").count() == 1


# op3


def windows_plain(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    return {tuple(words[k : k + 5]): k for k in range(len(words) - 4)}


def test_decontamination_against_plain(spark):
    documents, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in benchmark.collect()}
    want = {}
    for r in documents.collect():
        have = set(windows_plain(r.text))
        want[r.doc_id] = {i for i, t in items.items() if (w := set(windows_plain(t))) and len(w & have) >= 0.8 * len(w)}
    got = {r.doc_id: {int(x) for x in r.item_ids.split(",") if x} for r in decontam.report(documents, benchmark).collect()}
    assert got == want and any(want.values())


def test_exchanged_slots(spark):
    items = spark.createDataFrame([(1, "Yesterday Alice Smith bought 12 kg of apples for 30 dollars and then Alice Smith gave half of them to Bob."), (2, None), (3, "short"), (None, "")], "item_id long, text string")
    rows = docs(
        spark,
        "Intro here. Yesterday Carol bought 7 lb of apples for 99 euros and then Carol gave half of them to Dan. The end.",
        "Yesterday Carol bought 7 lb of apples for 99 euros and then Mallory gave half of them to Dan.",
        "Yesterday Alice Smith bought 12 kg of apples for 30 dollars and then Alice Smith gave half of them to Bob.",
        "Yesterday Carol sold one pear.",
    )
    got = [r for r in decontam.report(rows, items).collect()]
    assert len(got) == rows.count() and sorted(r.doc_id for r in got if r.contaminated) == [0, 2]
    kept = decontam.clean_rows(rows, items)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 2
    assert decontam.report(empty(spark), items).count() == 0 and decontam.report(rows, items.limit(0)).where("contaminated").count() == 0


def test_short_items_numbers_and_capitals(spark):
    items = spark.createDataFrame([("a", "Alice has 3 apples"), ("b", "12 + 7 * 3 = 57"), ("c", "short"), ("d", "My friend Alice Smith paid 30 dollars for apples and pears on Monday before noon"), (None, "one two")], "item_id string, text string")
    texts = ["So. Alice has 9 apples ok", "sum 12 + 7 * 3 = 57 yes", "12 + 8 * 3 = 57", "a short one", "So it is. Short. Yes", "MY FRIEND ALICE SMITH PAID 30 DOLLARS FOR APPLES AND PEARS ON MONDAY BEFORE NOON", "my friend alice smith paid 30 dollars for apples and pears"]
    got = {r.doc_id: r.item_ids for r in decontam.report(docs(spark, *texts), items).collect() if r.doc_id is not None and r.doc_id < 1000}
    assert got == {0: "a", 1: "b", 2: "", 3: "", 4: "c", 5: "d", 6: ""}


def test_edited_and_partial_copies(spark):
    words = [f"{a}{b}" for a in ("lo", "mi", "ra", "to", "ve") for b in ("na", "pe", "si", "ku", "da", "go")]
    item = " ".join(words)
    one, two = words.copy(), words.copy()
    one[15] = "other"
    two[9], two[20] = "other", "words"
    items = spark.createDataFrame([(1, item), (2, " ".join(reversed(words * 4)))], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.share) for r in decontam.report(docs(spark, " ".join(one), " ".join(two), " ".join(words[:13]), " ".join(words[:12])), items).collect() if r.doc_id is not None}
    assert got[0] == (True, 29 / 30) and got[1] == (True, 28 / 30) and got[2][0] and not got[3][0]


def plain_template(text, common=None):
    """Words with typed placeholders, one token after another: (placeholder or word, value). With ``common``, words at a
    sentence's start that aren't among these are names, too."""
    out, last = [], decontam.END
    for t in re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]", text or ""):
        low = t.lower()
        kind = decontam.END if t in ".!?\n" else decontam.NUM if t[0].isdecimal() or low in decontam.NUMBER_WORDS else decontam.UNIT if low in decontam.UNITS else decontam.CAPITAL if t[0].isupper() and t[1:2].islower() else decontam.PLAIN
        slot = kind == decontam.NUM and "NUM" or kind == decontam.UNIT and last == decontam.NUM and "UNIT" or kind == decontam.CAPITAL and (last != decontam.END or common is not None and low not in common) and "NAME"
        if slot == "NAME" and out and out[-1][0] == "NAME" and last == decontam.CAPITAL:
            out[-1] = ("NAME", out[-1][1] + " " + low)
        elif kind != decontam.END:
            out.append((slot or low, low))
        last = kind
    return out


def test_templates_against_plain(spark):
    """Windows with typed slots, consistent along each alignment, one document and one item at a time."""
    rng = random.Random(8)
    bits = ["Alice", "Bob Ray", "3", "twelve", "kg", "dollars", "apples", "bought", "the", "gave", "for", "and", "then", "him", "."]
    make = lambda n: " ".join(rng.choice(bits) for _ in range(n))
    items = {i: "so " + make(14) for i in range(12)}
    swap = {"Alice": "Carol", "Bob": "Dan", "3": "9", "kg": "lb", "12": "8"}
    texts = [make(30) for _ in range(30)] + [f"well {' '.join(swap.get(w, w) if k % 2 else w for w in t.split())} end" for k, t in enumerate(items.values())] + [f"{t} {make(9)}" for t in items.values()]

    common = {t for x in items.values() for t in re.findall(r"[^\W\d_]+", x) if not t[0].isupper()}

    def plain(text, item, common=None):
        doc, own = plain_template(text, common), plain_template(item, common)
        lines = collections.defaultdict(list)
        for a in range(len(doc) - 4):
            for b in range(len(own) - 4):
                x, y = doc[a : a + 5], own[b : b + 5]
                vague = sum(s in ("NUM", "UNIT", "NAME") for s, _ in y) > 3
                if [v for _, v in x] == [v for _, v in y] and [s for s, _ in x] == [s for s, _ in y] if vague else [s for s, _ in x] == [s for s, _ in y]:
                    lines[a - b].append((b, [] if vague else [(p[1], q[1]) for p, q in zip(x, y) if p[0] in ("NUM", "UNIT", "NAME")]))
        covered, run = set(), 0
        for found in lines.values():
            pairs = {p for _, slots in found for p in slots}
            if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                places = {b for b, _ in found}
                covered |= {b + k for b in places for k in range(5)}
                run = max(run, max(next(k for k in range(1, 99) if b + k not in places) + 4 for b in places))
        return len(covered) >= 0.8 * len(own) or run >= decontam.RUN

    folded = lambda t: re.findall(r"\d+|[^\W\d_]+", t.lower())

    def same_words(text, item):
        doc, own = folded(text), folded(item)
        held = {b for b in range(len(own) - 4) for a in range(len(doc) - 4) if doc[a : a + 5] == own[b : b + 5]}
        covered = {b + k for b in held for k in range(5)}
        return len(covered) >= 0.8 * len(own) or any(all(b + k in held for k in range(decontam.RUN - 4)) for b in held)

    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {int(x) for x in r.item_ids.split(",") if x} for r in decontam.report(rows, benchmark).collect()}
    want = {k: {i for i, t in items.items() if plain(text, t) or plain(text, t, common) or same_words(text, t)} for k, text in enumerate(texts)}
    assert got == want and sum(map(bool, want.values())) >= 12


def test_names_at_a_sentences_start(spark):
    """Questions that begin with an exchanged name are found; of words that stand in lower case elsewhere, a start is no name."""
    cases = {
        "Alice has 3 apples. Bob has 5 apples. How many apples do they have together?": "Carol has 7 apples. Dave has 9 apples. How many apples do they have together?",
        "Tom runs 5 km. Tom rests 10 minutes. Tom runs again.": "Ann runs 6 km. Ann rests 20 minutes. Ann runs again.",
        "Eve has 3 apples": "Zoe has 7 apples",
    }
    items = spark.createDataFrame([(k, t, 0) for k, t in enumerate(cases)], "item_id long, text string, key int")
    texts = [f"Some words before it. {t} And after it" for t in cases.values()]
    clean = ["Carol has 7 pears. Dave likes 9 apples. How few apples would she want alone?", "Ann runs 6 km. Bea rests 20 minutes. Cid runs again.", "They say Zoe had 7 apples", "Apples run. Minutes rest. Many have."]
    got = {r.doc_id: r.item_ids for r in decontam.report(docs(spark, *texts, *clean), items).collect() if r.doc_id is not None and r.doc_id < 1000}
    assert got == {0: "0,2", 1: "1", 2: "2", 3: "", 4: "", 5: "", 6: ""}  # the first holds the third, too


def test_the_filter_loses_nothing(spark, monkeypatch):
    documents, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontam.report(documents, benchmark).collect()))
    monkeypatch.setattr(decontam, "bitmap", lambda hashes: np.full(decontam.BITS // 8, 255, np.uint8))
    assert sorted(map(tuple, decontam.report(documents, benchmark).collect())) == want


# op4

BASE_PLAIN = {
    "assign": (re.compile(r"((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:(?:w|W)(?:o|O)(?:r|R)(?:d|D)|(?:w|W)(?:d|D))|(?i:secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def secrets_plain(text):
    return sorted((m.start(), k, kind, m.end()) for k, (kind, (rx, g, n)) in enumerate(BASE_PLAIN.items()) for m in rx.finditer(text or "") if len(m[g]) >= n)


def test_secrets_against_plain(spark):
    rng = random.Random(5)
    bits = ["token", "=", ": ", "PassWord", "secret", "'", '"', "abcdef123", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef01234567", " ", "é漢", "api_key", "apikey", "-", "x", "passwd", "short", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    df = docs(spark, *texts)
    got = collections.Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets_index.digests(df).collect())
    want = collections.Counter()
    for r in df.collect():
        found = secrets_plain(r.text)
        n = collections.Counter(k for _, _, k, _ in found)
        want[r.doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()] += 1
    assert got == want
    assert secrets_index.digests(empty(spark)).count() == 0


def test_added_rules(spark):
    token = "ghp_" + "aB3" * 12
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM"
    got = {r.doc_id: r.spans for r in secrets_index.digests(docs(spark, f"é {token} x", f"{jwt}", "-----BEGIN RSA PRIVATE KEY-----", "gho_short")).collect()}
    assert got[0] == "github:2:42" and got[1] == f"jwt:0:{len(jwt)}" and got[2] == "pem:0:31" and got[3] == ""


@pytest.mark.parametrize("rule", secrets_index.BASE + secrets_index.MORE, ids=lambda r: r.kind)
def test_trigram_queries_are_mandatory(rule):
    samples = {"assign": "Api_Key = 'abcdefgh'", "access": "AKIA" + "A" * 20, "hex": "ab" * 20, "github": "ghs_" + "a" * 40, "slack": "xoxr-" + "1" * 12, "google": "AIza" + "b" * 35, "stripe": "rk_live_" + "c" * 20, "jwt": "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "pem": "-----BEGIN EC PRIVATE KEY-----"}
    low = samples[rule.kind].lower()
    assert re.search(rule.pattern, samples[rule.kind])
    assert all(any(all(t in low for t in alt) for alt in part) for part in secrets_index.trigram_query(rule.pattern))
    assert (secrets_index.trigram_query(rule.pattern) == []) == (rule.kind == "hex")


# op5


def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 5000, "<p>a</p>\r\n\r\nWARC/1.1\r\n", "<p>a</p>"]
    pages = spark.createDataFrame([(i, f"http://x/{i} \r\né", h, "z") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "z"), (4, "http://again", "é" * 5000, "z")], "page_id long, url string, html string, key string")
    rows = warc.salvage(warc.archives(pages)).collect()
    assert all(r.kind == "record" for r in rows) and len(rows) == 9
    number = lambda x: None if x is None else int(x)
    got = sorted((-1 if r.page_id is None else int(r.page_id), r.record_type, number(r.refers_to), r.payload_bytes, r.payload_digest) for r in rows)
    size = lambda h: len((h or "").encode())
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {0: None, 1: None, 2: 1, 3: 0, 4: None, 5: None, 6: 0}
    want = [(i, "response" if first[i] is None else "revisit", first[i], size(h), sha(h)) for i, h in enumerate(html)]
    want += [(-1, "revisit", 0, 8, sha("<p>a</p>")), (4, "response", None, 10000, sha("é" * 5000))]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.salvage(warc.archives(pages.limit(0))).count() == 0


def salvaged(data):
    events = list(warc.records(data))
    return [warc.id_of(e[1]["head"]["warc-record-id"]) for e in events if e[0] == "record"], [e[1:] for e in events if e[0] == "gap"]


def test_salvage():
    members = [warc.record(n, f"http://x/{n}", f"payload {n} ".encode() * 50, "D", None, False) for n in range(6)]
    data = b"".join(members)
    assert salvaged(data) == (list("012345"), [])
    at = [0, *itertools.accumulate(map(len, members))]
    broken = bytearray(data)
    broken[at[2] + 40] ^= 0xFF
    found, gaps = salvaged(bytes(broken))
    assert found == list("01345") and [g[1:3] for g in gaps] == [(at[2], at[3])]
    found, gaps = salvaged(b"junk" + data[: at[4] + 30])
    assert found == list("0123") and [g[1:3] for g in gaps] == [(0, 4), (at[4] + 4, at[4] + 34)]
    plain = b"".join(zlib.decompress(m, 31) for m in members)
    found, gaps = salvaged(plain[:100] + plain[120:])
    assert found == list("12345") and len(gaps) == 1
    assert salvaged(b"") == ([], [])


def test_salvage_inside_members():
    rng = random.Random(1)
    plain = b"".join(zlib.decompress(warc.record(n, "u", f"payload {n} ".encode() * 50 + rng.randbytes(300), "D", None, False), 31) for n in range(6))
    packer = lambda x: (lambda c: c.compress(x) + c.flush())(zlib.compressobj(1, zlib.DEFLATED, 31))
    one = packer(plain)
    assert salvaged(one) == (list("012345"), [])
    assert salvaged(one[:-12])[0] == list("01234")
    bad = bytearray(plain)
    bad[plain.index(b"payload 2") + 3] ^= 1
    found, gaps = salvaged(packer(bytes(bad)))
    assert found == list("01345") and gaps[0][0] == "block digest" and gaps[0][3:] == (plain.index(b"WARC/1.1", plain.index(b"payload 1")), plain.index(b"WARC/1.1", plain.index(b"payload 2")))
    again = warc.record(9, "u", b"later", "D", None, False)
    assert salvaged(one[: len(one) // 2] + again)[0][-1] == "9"


def test_reading_takes_linear_time():
    rng = random.Random(3)
    parts = [warc.record(n, "u", rng.randbytes(20_000), "D", None, False) for n in range(100)]
    took = []
    for n in (1, 8):
        began = time.process_time()
        assert sum(1 for _ in warc.records(b"".join(parts * n))) == 100 * n
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.01)


def test_text_ids_and_other_columns(spark):
    pages = spark.createDataFrame([("a/1", "http://x", "<p>", 1, "p"), ("b é", None, "<p>", 2, "q")], "page_id string, url string, html string, payload int, first string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.salvage(warc.archives(pages)).collect()}
    assert got == {"a/1": ("response", None), "b é": ("revisit", "a/1")}


# op6


def test_language(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(documents, ~held)
    rows = langid.predict(documents.where(held), model, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    hard = langid.predict(docs(spark, "123 !!"), model).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in hard if r.lang_pred == "und") == [(0, "und"), (1000, "und"), (1001, "und"), (1002, "und")] and len(hard) == 8
    assert langid.predict(empty(spark), model).count() == 0
    untrained = langid.train(empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs(spark, "word"), untrained).collect()} == {"und"}
    kept = langid.known_rows(docs(spark, "123 !!", "le la des"), model, 0.3)
    assert kept.columns == docs(spark).columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1003, 1003, 1004]


def test_language_against_plain(spark, monkeypatch):
    """Counts, log shares, backoff and means, one text at a time; with all words joined, and with the frequent ones broadcast."""
    train = [("a", "the cat and the dog and the bird"), ("a", "a cat the"), ("b", "der hund und die katze und der vogel"), ("b", "die katze"), (None, "ignored words")]
    texts = ["the dog", "der hunde", "zzz", "qqcat", "Katzen und CAT", "", None, "12", "the the the der"]
    find = regex.compile(langid.LETTERS).findall
    words = {x: collections.Counter(w for lang, t in train if lang == x for w in find(t)) for x in "ab"}
    grams = {x: {k: collections.Counter() for k in langid.LENGTHS} for x in "ab"}
    for x, counts in words.items():
        for w, n in counts.items():
            for k in langid.LENGTHS:
                for i in range(len(w) + 2 - k + 1):
                    grams[x][k][f"^{w}$"[i : i + k]] += n
    log = lambda of, x, w: math.log(of[x][w] / of[x].total()) if of[x][w] else math.log(0.5 / sum(c.total() for c in of.values()))
    by = {k: {x: grams[x][k] for x in "ab"} for k in langid.LENGTHS}

    def plain(text):
        found = find((text or "").lower())
        if not found:
            return "und", 0.0
        sums = dict.fromkeys("ab", 0.0)
        for w in found:
            if any(words[x][w] for x in "ab"):
                for x in "ab":
                    sums[x] += log(words, x, w)
                continue
            for k in langid.LENGTHS:
                known = [g for i in range(len(w) + 2 - k + 1) if any(grams[x][k][g := f"^{w}$"[i : i + k]] for x in "ab")]
                if known:
                    for x in "ab":
                        sums[x] += sum(log(by[k], x, g) for g in known) / len(known)
                    break
        best = max("ab", key=lambda x: sums[x])
        return best, 1 / sum(math.exp((sums[x] - sums[best]) / len(found)) for x in "ab")

    rows = spark.createDataFrame([(i, t, "x", None, None) for i, t in enumerate(texts)], "doc_id long, text string, rest string, v string, n string")
    model = langid.train(spark.createDataFrame([(0, t, x) for x, t in train], "doc_id long, text string, lang string"), F.lit(True))
    for head in (0, 3, 300_000):
        monkeypatch.setattr(langid, "HEAD", head)
        for r in langid.predict(rows, model).collect():
            lang, score = plain(texts[r.doc_id])
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-3), (texts[r.doc_id], head)


def test_language_coverage(spark, monkeypatch):
    """Coverage by broadcast and by other words is the same, and tasks hold a number for each n-gram that coverage asks for, no other."""
    train = [("a", "the cat and the dog and a bird"), ("b", "der hund und die katze i a"), ("b", "die katze")]
    texts = spark.createDataFrame([(0, "the der a katze the xyz"), (1, "i a i"), (2, ""), (3, "mnop" * 50)], "doc_id long, text string")
    model = langid.train(spark.createDataFrame([(0, t, x) for x, t in train], "doc_id long, text string, lang string"), F.lit(True), gate=True)
    assert all(len(g) == 4 or (g[0], g[-1], len(g)) == ("^", "$", 3) for g in model.typical) and {type(x) for x in model.typical.values()} == {int}
    grams = lambda w: [f"^{w}$"[i : i + min(4, len(w) + 2)] for i in range(max(1, len(w) - 1))]
    known = {x: {g for lang, t in train if lang == x for w in t.split() for g in grams(w)} for x in "ab"}
    seen = [[g for w in t.split() for g in grams(w)] for t in ("the der a katze the xyz", "i a i")]
    for head in (0, 3, 300_000):
        monkeypatch.setattr(langid, "HEAD", head)
        got = {r.doc_id: r.cover for r in langid.head_sums(texts, model, "text", ("doc_id",)).collect()}
        assert [got[k] for k in (0, 1)] == [[*(float(sum(g in known[x] for g in some)) for x in "ab"), float(len(some))] for some in seen]
        assert got[2] is None and got[3][:2] == [0.0, 0.0]


def test_backoff_by_length(spark):
    """A length's n-grams are only made for words that no greater length told; all lengths are reached."""
    model = langid.train(spark.createDataFrame([(0, "the cat", "a"), (1, "der hund", "b")], "doc_id long, text string, lang string"), F.lit(True))
    found = langid.unseen_logs(model, spark.createDataFrame([("cats",), ("xcatx",), ("dexx",), ("qqtqq",), ("zzz",)], "word string"))
    assert [sorted(r.word for r in t.collect()) for t in found] == [["cats"], ["dexx", "xcatx"], [], ["qqtqq", "zzz"]]
    assert langid.grams_of(spark.createDataFrame([("cat",)], "word string"), "word", lengths=(4,)).count() == 2


def test_shuffle_files_go_as_a_table_is_written(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f.getName()) for f in (files.apply(i) for files in [blocks.getAllFiles()] for i in range(files.size())) if f.getName().startswith("shuffle_")}
    before = shuffles()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts", cleaned=True)
    for _ in range(100):  # executors delete them on their own
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_long_runs_of_letters(spark):
    """Whole runs count, in training and in scoring, and no n-gram is lost between windows."""
    rng = random.Random(5)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    train = spark.createDataFrame([(0, make("abcd", 70) + make("efgh", 500), "x"), (1, make("mnop", 600), "y")], "doc_id long, text string, lang string")
    model = langid.train(train, F.lit(True))
    texts = spark.createDataFrame([(0, make("abcd", 64) + make("mnop", 5000)), (1, make("efgh", 200)), (2, make("mnop", 64) + make("efgh", 5000))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(texts, model).collect()} == {0: "y", 1: "x", 2: "x"}
    run = make("abcdefgh", 1000)
    windows = langid.words_of(run, regex.compile(langid.LETTERS).findall)
    of = lambda w: {w[i : i + 4] for i in range(len(w) - 3)}
    assert set().union(*(of(langid.ended(w)) for w in windows)) == of(f"^{run}$") and max(map(len, windows)) <= langid.LONGEST + 1


# op7


def test_rows_that_dont_fit_the_sample_are_left_out_alone(spark, monkeypatch):
    """A row over the bound doesn't end the training, nor do rows after it go; a very long row is thinned."""
    monkeypatch.setattr(quality_mil, "PASSAGES", 60)
    monkeypatch.setattr(quality_mil, "SAMPLE", 40)
    rows = spark.createDataFrame([(i, " ".join(["word number", "Good text."][i % 2] for _ in range(3000 if i % 7 == 0 else 30))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = {}
    monkeypatch.setattr(quality_mil, "fit", lambda bags, y: seen.update(sizes=[len(b) for b in bags], y=y))
    quality_mil.train(rows, labels, F.lit(True))
    assert sum(seen["sizes"]) <= 60 and len(seen["sizes"]) > 20 and set(seen["y"]) == {0.0, 1.0}
    bag = np.arange(5000, dtype=np.float32)[:, None]
    thin = quality_mil.thinned(bag)
    assert len(thin) == quality_mil.ROW and thin[0] == 0 and thin[-1] == 4999 and len(quality_mil.thinned(bag[:7])) == 7


def test_spans_of_long_names_begin_at_their_token():
    text = "mail averyveryverylongfirstname.averyveryverylonglastname1 (at) example.com now"
    assert {(5, 75), (32, 75)} <= set(pii_semicrf.addresses(text)) and all(text[s - 1] in " ." for s, _ in pii_semicrf.addresses(text))
    long = "x" * 100 + ".tail (at) example.com"
    assert pii_semicrf.addresses(long) == [(101, len(long))]
    deep = "me [at] " + "a-label-of-more-than-24-letters" + ".b.c.d.e.f.com"
    assert (0, len(deep)) in pii_semicrf.addresses(deep)


def test_quality(spark):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    weights = quality_mil.train(documents, labels, ~held)
    rows = quality_mil.score(documents, weights).join(labels, "doc_id").where(held).collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in rows) >= 0.9 * len(rows)
    hard = quality_mil.score(docs(spark, "A B! " * 500), weights).collect()
    assert len(hard) == 8 and all(0 <= r.score <= 1 for r in hard)
    assert quality_mil.score(empty(spark), weights).count() == 0
    none = quality_mil.train(documents, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_mil.score(docs(spark, "x"), none).collect()} == {0.5}


def test_attention_gradients():
    """The gradients that learning takes are those of the loss, by differences."""
    rng = np.random.default_rng(0)
    x, at, y = rng.normal(size=(7, quality_mil.MEASURES)), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])
    p = quality_mil.begin(x)

    def loss(p):
        s = quality_mil.forward(p, x, at)[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name, grad in quality_mil.gradients(p, x, at, y).items():
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in p[name].shape)
            more, less = p[name].copy(), p[name].copy()
            more[i] += 1e-5
            less[i] -= 1e-5
            assert (loss(p | {name: more}) - loss(p | {name: less})) / 2e-5 == pytest.approx(grad[i], abs=1e-7)
    bags = [rng.normal(size=(n, quality_mil.MEASURES)).astype(np.float32) for n in (1, 4, 2)]
    fitted = quality_mil.forward(quality_mil.fit(bags, y), np.concatenate(bags), at)
    assert np.allclose(np.add.reduceat(fitted[5], at), 1) and fitted[0][0] > 0.9 > 0.1 > fitted[0][1]


def test_every_passage_is_encoded_and_trained_on(spark):
    assert len(quality_mil.measures("word " * 60_000)) == 1000 and quality_mil.measures("")[0].sum() == 0
    assert quality_mil.CLASSES[ord("Ж")] == quality_mil.UPPER and quality_mil.CLASSES[ord("中")] == quality_mil.LOWER
    bad = "!! $$ !! " * 400
    texts = [("good words of a text. " * 300 + (bad if k % 2 else ""), 1 - k % 2) for k in range(40)]  # the bad part comes after passage 20
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts)], "doc_id long, quality int")
    weights = quality_mil.train(rows, labels, F.lit(True))
    assert {r.doc_id % 2: r.score > 0.5 for r in quality_mil.score(rows, weights).collect()} == {0: True, 1: False}


# op8


def pii_plain(t):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and pii_semicrf.luhn(d)]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "23", "+", "-", " ", "(", ")", "4111111111111111", "b.c", "é", "0" * 30]), max_size=25))
def test_base_spans_against_plain(parts):
    text = "".join(parts)
    assert pii_semicrf.base_spans(text) == pii_plain(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "1.2.3.4", "555-123-4567", " tel ", "+4912345", "678 ", "4111 1111 1111 1111", "."]), min_size=1, max_size=4))
def test_segmentations_against_all(parts):
    weights = dict(pii_semicrf.START)
    lattice = pii_semicrf.lattice("".join(parts))
    if len(lattice) > 11:
        return
    clear = lambda c: all(lattice[a][1] <= lattice[b][0] or lattice[b][1] <= lattice[a][0] for a, b in itertools.combinations(c, 2))
    every = [c for r in range(len(lattice) + 1) for c in itertools.combinations(range(len(lattice)), r) if clear(c)]
    scores = [sum(pii_semicrf.score(weights, lattice[i][3]) for i in c) for c in every]
    total = sum(map(math.exp, scores))
    for i, p in enumerate(pii_semicrf.expected(lattice, weights)):
        assert p == pytest.approx(sum(math.exp(s) for s, c in zip(scores, every) if i in c) / total, abs=1e-6)
    top = max(s - pii_semicrf.MARGIN * len(c) for s, c in zip(scores, every))
    took = pii_semicrf.best(lattice, weights)
    assert sum(max(pii_semicrf.score(weights, x[3]) for x in lattice if (x[2], x[0], x[1]) == t) - pii_semicrf.MARGIN for t in took) == pytest.approx(top)


def test_personal_data(spark):
    df = docs(spark, "write a.b@c.de, call 555-123-4567 or +1 (212) 555-0100; born 2024-01-02", "é 10.0.0.1###4111 1111 1111 1111$$$", "0" * 6000 + ".1.1.1")
    weights = pii_semicrf.train(df)
    got = {r.doc_id: r for r in pii_semicrf.digests(df, weights).collect() if r.doc_id is not None}
    assert got[0].spans.split(",") == ["email:6:14", "phone:21:33", "phone:37:54"] and (got[0].n_email, got[0].n_phone) == (1, 1)
    assert got[1].spans == "ip:2:10,card:13:32" and got[1000].spans == "" and got[2].n_ip == 1
    masked = {r.doc_id: r.text for r in pii_semicrf.masked_rows(df, weights).collect()}
    assert masked[0] == "write [EMAIL], call [PHONE] or [PHONE]; born 2024-01-02" and masked[1] == "é [IP]###[CARD]$$$" and masked[1000] is None and masked[1004] == LONG
    assert pii_semicrf.digests(empty(spark), pii_semicrf.train(empty(spark))).count() == 0


def test_training_prefers_the_labelled_spans(spark):
    """After training the labelled segments are likelier than at the start, and the altered copies' spans are found."""
    texts = ["call +49 30 1234567 now", "card 4111 1111 1111 1111 ok", "host 10.0.0.1 up", "mail jo.do@ex.org please"]
    df = docs(spark, *texts)
    weights = pii_semicrf.train(df)
    groups = [g for t in texts for g in pii_semicrf.examples(t)]
    assert any(gold for g in groups for _, gold, _ in g)

    def likelihood(w):
        return sum(p if gold else 1 - p for g in groups for (_, gold, _), p in zip(g, pii_semicrf.marginals([u for u, _, _ in g], [pii_semicrf.score(w, n) for _, _, n in g])))

    assert likelihood(weights) >= likelihood(dict(pii_semicrf.START))
    for text in texts:
        for made, gold in pii_semicrf.altered(text):
            found = set(pii_semicrf.spans_of(made, weights)[1])
            assert gold <= found or not gold, (made, gold, found)


def test_digests_are_of_the_spans(spark):
    df = docs(spark, "a@b.co +1 212 555 0100", "4111-1111-1111-1111 and 10.0.0.1")
    weights = pii_semicrf.train(df)
    for r, t in ((r, x.text or "") for r in pii_semicrf.digests(df, weights).collect() for x in df.where(F.col("doc_id").eqNullSafe(r.doc_id)).limit(1).collect()):
        base, every = pii_semicrf.spans_of(t, weights)
        text = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest() and r.spans == text(every) and r.n_card == sum(k == "card" for k, _, _ in base)


def test_numbers_inside_runs():
    """Of several numbers in one run of digits each comes out with its own bounds and kind."""
    spans = lambda t: [(k, t[s:e]) for k, s, e in pii_semicrf.spans_of(t, dict(pii_semicrf.START))[1]]
    assert spans("4465758382889437 4465758382889437") == [("card", "4465758382889437")] * 2
    assert spans("a 7536784127813050 4845168114407329 b") == [("card", "7536784127813050"), ("card", "4845168114407329")]
    assert spans("4111 1111 1111 1111 5555 5555 5555 4444") == [("card", "4111 1111 1111 1111"), ("card", "5555 5555 5555 4444")]
    assert spans("+49 30 1234567 4111-1111-1111-1111") == [("phone", "+49 30 1234567"), ("card", "4111-1111-1111-1111")]
    assert spans("4465758382889437 4465758382889438") == [("card", "4465758382889437")]
    assert spans("300.10.0.0.1") == [("ip", "10.0.0.1")]
    assert spans("write john.doe (at) example (dot) com now") == [("email", "john.doe (at) example (dot) com")] and spans("mail bob @ x.co.uk.") == [("email", "bob @ x.co.uk")]
    assert spans("meet me @ home. Then sales at example.com") == []
    assert spans("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 2024-01-02 10:20 20240102 20240103 20240104") == []
    assert len(spans("4465758382889437 " * 200)) == 200


# op9


def groups_plain(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies(n, seed):
    """A cloud of copies with so many changes that some pairs are links and some aren't."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(120)]
    return [" ".join(rng.choice("abc") + w if rng.random() < rng.choice((0.005, 0.02, 0.04)) else w for w in base) for _ in range(n)]


@pytest.mark.parametrize(("width", "percent"), [(4, 80), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, width, percent):
    texts = near_copies(150, 1) + ["One two", "one TWO", "one two three", "é", "É", "a b c d e f g", "a b c d e f g h"]
    df = docs(spark, *texts)
    got = minhash.clusters(df, width, percent).collect()
    assert len(got) == df.count()
    want = groups_plain([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None], width, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    kept = minhash.kept_rows(df, width, percent)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in want.items() if i == c)


def test_rows_that_share_an_id(spark):
    same, other, twice = "a b c d e f", "totally other text here for once", "same same words in here ok"
    rows = spark.createDataFrame([(7, same, "x"), (7, other, "y"), (3, same, "z"), (9, twice, "p"), (9, twice, "p"), (None, same, "n"), (11, None, "q"), (11, "", "q")], "doc_id long, text string, set_key string")
    got = sorted((r.doc_id or 0, r.text or "") for r in minhash.kept_rows(rows).collect())
    assert got == [(0, same), (3, same), (7, other), (9, twice), (11, ""), (11, "")]


def test_hubs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "HUB_ROWS", 5)
    links = spark.createDataFrame([(1, i) for i in range(50, 90)] + [(89, 100 + i) for i in range(30)] + [(200, 201)], "a long, b long")
    got = {r.id: r.component for r in minhash.components(links).collect()}
    assert all(got[i] == 1 for i in (*range(50, 90), *range(100, 130))) and got[201] == 200


def test_large_buckets_take_the_prefix_join(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    df = docs(spark, *near_copies(120, 2))
    want = groups_plain([(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None], 4, 80)
    assert {r.doc_id: r.component_id for r in minhash.clusters(df, 4, 80).collect() if r.doc_id is not None} == {i: c for i, (_, c) in want.items()}


def test_prefix_pairs_lose_nothing(spark):
    texts = near_copies(60, 3)
    df = docs(spark, *texts)
    members = spark.createDataFrame([(i, i, True) for i in range(60)], "id long, component long, outside boolean")
    got = {tuple(r) for r in minhash.prefix_pairs(members, df, 4, 80).collect()}
    sets = [{tuple(t.split()[k : k + 4]) for k in range(117)} for t in texts]
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want <= got


def test_a_task_has_one_python_step(spark, monkeypatch):
    """Each further step in a task keeps a Python worker a core in the executor."""
    steps = []

    def counted(df, label, cleaned=False):
        steps.append((label, df._jdf.queryExecution().sparkPlan().toString().count("MapInArrow")))
        return written(df, label, cleaned)

    monkeypatch.setattr(minhash, "written", counted)
    members = spark.createDataFrame([(i, i, True) for i in range(6)], "id long, component long, outside boolean")
    minhash.prefix_pairs(members, docs(spark, *near_copies(6, 3)), 4, 80).collect()
    assert ("shingles", 1) in steps


def test_batches_for_python_are_bounded(spark):
    """Spark's own bound of 64 MB would be held by each task's JVM side and by its worker."""
    many = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("a"), 1 << 20).alias("text"))
    change_rows(many, "text", lambda: lambda texts: (None, None))
    sizes = many.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n bigint").collect()
    assert sum(r.n for r in sizes) >= 60 << 20 and max(r.n for r in sizes) < 10 << 20


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in minhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100
    assert minhash.components(links.limit(0)).count() == 0


def test_no_documents(spark):
    assert minhash.clusters(empty(spark), 4).count() == 0


# op10

RANKS = public_tokenizers.path(queries.RANKS_FILE)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab é", max_size=200)))
def test_merges_as_the_library_does(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = [i for piece in regex.findall(public_tokenizers.PATTERN, text) for i in bpe.merge_piece(piece.encode(), bpe.read_ranks(RANKS))]
    assert ids == LIBRARY.encode_ordinary(text)


def test_encode_and_decode(spark):
    df = docs(spark, "Hello, wörld! <|endoftext|>", "x" * 3000)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect())
    want = collections.Counter()
    for r in df.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.digests(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_is_one_python_step(spark):
    """Two in a task would keep two Python workers a core in the executor. What comes out is what ``decode`` gives of ``encode``."""
    df = docs(spark, "some words", "some other words", "\u00e4\u00f6 \U0001f600")
    assert bpe.digests(df, RANKS, public_tokenizers.PATTERN)._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    kept = ("doc_id", "lang")
    once = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN, keep=kept)
    twice = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN, keep=kept), RANKS, kept)
    assert once.schema == twice.schema and sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
