"""Personal data by fixed patterns and a semi-Markov conditional random field over whole spans.

The base patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers; what they find stays. The
semi-Markov field adds spans. Candidate segments are wide shapes around digits, all sub-spans between token edges of runs
of groups of digits that have as many digits as a kind of number may have, and around signs that stand for an @ all spans
from a token edge before to a label edge after; each gets features of the whole span (its shape, its digits and groups,
check sums, the words before it, what stands at its edges) and a score for each kind; text outside segments scores 0.
Dynamic programming over the candidates' ends chooses boundaries and kinds together: the best set of segments that don't
overlap. A segment is bounded (``LONGEST`` characters), so work grows with the text; base spans of any length stay.

Weights maximise a conditional likelihood, with a Gaussian prior around the starting weights that also holds where a corpus
has no such data; the likelihood's sum over all segmentations is a forward and backward pass over the same lattice. The
labelled rows are groups of segments that overlap, from a bounded sample of texts: in the texts themselves the base spans,
for the shapes that the base patterns can tell; and in altered copies of the base spans' surroundings spans that the base
patterns miss but whose bounds and kinds are known: numbers without their plus after a cue, two cards in one run, addresses
behind another group, spelled or spaced signs; and the same with a wrong digit or byte, which are none.

Null texts count as empty: no spans. Equal texts give equal spans, repeated rows stay repeated, other columns of the
input are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import change_rows, map_rows, sampled

KINDS = ("email", "ip", "card", "phone")
#: Longest segment that the field scores.
LONGEST = 80
#: Texts whose groups of segments train the field, and distinct groups of them.
SAMPLE, GROUPS = 2000, 20_000
#: Least margin over leaving a segment out for a span to be added.
MARGIN = 0.5
STEPS, RATE, PRIOR = 60, 0.5, 0.05

# The base patterns. Where a match of digits may start is written out, so that long runs take linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LABEL = ALNUM | {"-"}
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wide shapes of candidates for the field, and words that announce a kind.
WIDE_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-][0-9]{2,5}){1,5}(?![0-9A-Za-z]|[./-][0-9])")
WIDE_AT = re.compile(r"\x20?(?:@|\[at\]|\(at\))\x20?", re.IGNORECASE)
NAME_BEFORE = re.compile(r"[A-Za-z0-9]+")
LABELS_AFTER = re.compile(r"[A-Za-z0-9-]{1,80}+(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]{1,80}+){1,40}+", re.IGNORECASE)
LABEL_END = re.compile(r"(?<=[A-Za-z])(?![A-Za-z0-9-])")
CUES = {
    "phone": frozenset(("tel", "phone", "call", "mobile", "fax", "cell", "telefon", "handy", "téléphone", "teléfono", "móvil")),
    "card": frozenset(("card", "visa", "credit", "mastercard", "karte", "carte", "tarjeta")),
    "email": frozenset(("mail", "email", "contact", "correo")),
    "ip": frozenset(("ip", "host", "server", "address")),
}
#: Starting weights, and the centre of the prior.
START = {"email:bias": -1.0, "email:at": 4.0, "email:dot": 1.0, "email:spelled": 3.0, "email:cut": -2.0, "email:number": -1.0, "ip:bias": -1.0, "ip:bytes": 4.0, "ip:big": -8.0, "card:bias": -2.0, "card:luhn": 3.0, "card:length": 2.0, "card:noluhn": -5.0, "card:fours": 2.0, "phone:bias": -3.0, "phone:plus": 5.0, "phone:cue": 3.5, "phone:paren": 1.0, "phone:length": 1.0, "phone:groups": 0.5, "phone:date": -6.0, "phone:short": -4.0, "card:cue": 1.5, "email:cue": 0.5, "ip:cue": 0.5, "phone:bytes": -5.0, "card:part": -4.0, "card:amex": 2.0, "phone:part": -2.0, "ip:part": -2.0}
WORDS_BEFORE = re.compile(r"\w+")
#: Groups of digits with so little between them are one run.
GROUP = re.compile("[0-9]+")
BETWEEN = re.compile(r"[\x20()./-]{1,3}")
#: Digits of a card or phone number.
FEWEST, MOST = 9, 19


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, end := m.end()))
        at = text.find("@", max(end, at + 1))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the base patterns find, by kind."""
    found = [("email", *x) for x in emails(text)]
    for m in IP.finditer(text):
        if all(len(q) <= 3 and int(q or 0) <= 255 for q in (p.lstrip("0") for p in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    """Segments of bounded length that may be personal data, by start and end, each once."""
    found = set(emails(text)) if "@" in text else set()
    found.update(m.span() for m in IP.finditer(text))
    found.update(m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 9)
    if "+" in text:
        found.update(m.span() for m in PHONE.finditer(text))
    found.update(m.span() for m in WIDE_PHONE.finditer(text))
    found.update(addresses(text))
    return sorted(x for x in found if x[1] - x[0] <= LONGEST)


def addresses(text: str) -> list[tuple[int, int]]:
    """Spans around signs that stand for an @, from each token edge of the name before to each label edge of what is after."""
    found = []
    if "@" not in text and "at)" not in (low := text.lower()) and "at]" not in low:
        return found
    for m in WIDE_AT.finditer(text):
        first = m.start()
        while first > 0 and m.start() - first <= LONGEST and text[first - 1] in LOCAL:
            first -= 1
        after = LABELS_AFTER.match(text, m.end())
        if first == m.start() or not after:
            continue
        starts = {first + x.start() for x in NAME_BEFORE.finditer(text[first : m.start()])} | {first}
        if first > 0 and text[first - 1] in LOCAL:  # longer than any span: its middle is no start
            starts = {x for x in starts if text[x - 1 : x] not in ALNUM}
        ends = [x.start() for x in LABEL_END.finditer(text, m.end(), after.end()) if text[x.start() : x.start() + 1] not in (")", "]") and ("." in text[m.end() : x.start()] or "dot" in text[m.end() : x.start()].lower())]
        last = [after.end()] if text[after.end() : after.end() + 1] not in LABEL else []
        found += [(s, e) for s in starts for e in {*ends, *last} if e - s <= LONGEST]
    return found


def parts(text: str) -> list[tuple[int, int]]:
    """Of each run of two groups of digits or more, the sub-spans between edges of groups, with signs and brackets or
    without, that have as many digits as a card or phone number, or four groups between dots."""
    found: set[tuple[int, int]] = set()
    run: list[tuple[int, int]] = []

    def take() -> None:
        for i, (start, _) in enumerate(run):
            before = text[max(0, start - 2) : start]
            starts = [start, *[start - 1] * (before[-1:] in ("(", "+")), *[start - 2] * (before == "+(")]
            digits = 0
            for k in range(i, len(run)):
                end = run[k][1]
                digits += end - run[k][0]
                if digits > MOST or end - start > LONGEST:
                    break
                dotted = k == i + 3 and all(text[a:b] == "." for (_, a), (b, _) in zip(run[i:k], run[i + 1 : k + 1]))
                if digits < FEWEST and not dotted:
                    continue
                for s in starts:
                    for e in (end, end + 1) if text[end : end + 1] == ")" else (end,):
                        if e - s <= LONGEST and text.count("(", s, e) == text.count(")", s, e):
                            found.add((s, e))

    for m in GROUP.finditer(text):
        if run and not (m.start() - run[-1][1] <= 3 and BETWEEN.fullmatch(text, run[-1][1], m.start())):
            if len(run) > 1:
                take()
            run = []
        run.append(m.span())
    if len(run) > 1:
        take()
    return sorted(found)


def features(text: str, start: int, end: int) -> dict[str, list[str]]:
    """The whole span's features for each kind that it may be."""
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    before = {w.lower() for w in WORDS_BEFORE.findall(text[max(0, start - 24) : start])[-2:]}
    out: dict[str, list[str]] = {}
    if "@" in span or "at)" in span.lower() or "at]" in span.lower():
        cut = start > 0 and text[start - 1] in LOCAL or text[end : end + 1].isalnum() or text[end : end + 1] == "." and text[end + 1 : end + 2].isalnum()
        out["email"] = ["bias", "at" if "@" in span else "spelled", *["dot"] * ("." in span or "dot" in span.lower()), *["cut"] * cut, *["number"] * span[-1].isdigit()]
    parts = span.split(".")
    bytes_ = len(parts) == 4 and all(p.isdigit() for p in parts)
    if bytes_:
        out["ip"] = ["bias", "bytes" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "big"]
    if not out and digits:
        groups = re.findall("[0-9]+", span)
        if re.fullmatch(r"[0-9 -]+", span) and 12 <= len(digits) <= 19:
            out["card"] = ["bias", "luhn" if luhn(digits) else "noluhn", "length" if len(digits) in (15, 16) else "odd", *["fours"] * (len(groups) > 1 and {len(g) for g in groups[:-1]} == {4})]
    if digits and "email" not in out and re.fullmatch(r"[0-9+(). /-]+", span):
        groups = re.findall("[0-9]+", span)
        date = len(groups) in (2, 3) and (len(groups[0]) == 4 or len(groups[-1]) == 4) and len(digits) <= 8
        out["phone"] = ["bias", *["plus"] * (span[0] == "+"), *["paren"] * ("(" in span), "length" if 9 <= len(digits) <= 15 else "short", *["groups"] * (len(groups) >= 3), *["date"] * date, *["bytes"] * bytes_]
    for kind, names in out.items():
        if before & CUES[kind]:
            names.append("cue")
    return out


def lattice(text: str) -> list[tuple[int, int, str, list[str]]]:
    """Candidate segments with kind and features, by end."""
    whole = candidates(text)
    segments = [(s, e, kind, [f"{kind}:{n}" for n in names]) for s, e in whole for kind, names in features(text, s, e).items()]
    for s, e in sorted(set(parts(text)).difference(whole)):
        sizes = [len(g) for g in GROUP.findall(text[s:e])]
        mark = "part" if len(sizes) > 1 else "group"
        segments += [(s, e, kind, [f"{kind}:{n}" for n in (*names, mark, *["amex"] * (kind == "card" and sizes == [4, 6, 5]))]) for kind, names in features(text, s, e).items()]
    return sorted(segments, key=lambda x: (x[1], x[0], x[2]))


def score(weights: dict[str, float], names: list[str]) -> float:
    return sum(weights.get(n, 0.0) for n in names)


def best(segments: list, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The best set of segments that don't overlap, each worth its score less the margin."""
    ends = [s[1] for s in segments]
    value, took = [0.0], []
    for k, (start, _, _, names) in enumerate(segments):
        upto = bisect_right(ends, start, 0, k)
        worth = value[upto] + score(weights, names) - MARGIN
        took.append((worth > value[-1], upto))
        value.append(max(worth, value[-1]))
    found, k = [], len(segments)
    while k:
        took_it, upto = took[k - 1]
        if took_it:
            found.append((segments[k - 1][2], *segments[k - 1][:2]))
        k = upto if took_it else k - 1
    return found[::-1]


def log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def starts_after(segments: list) -> list[int]:
    """For each segment, by end, how many segments end where it starts or before."""
    ends = [s[1] for s in segments]
    return [bisect_right(ends, s[0], 0, k) for k, s in enumerate(segments)]


def expected(segments: list, weights: dict[str, float]) -> list[float]:
    """Each segment's probability over all segmentations."""
    return marginals(starts_after(segments), [score(weights, s[3]) for s in segments])


def marginals(upto: list[int], scores: list[float]) -> list[float]:
    """Forward sums by end, backward sums by start."""
    ahead = [0.0]
    for k in range(len(scores)):
        ahead.append(log_sum(ahead[-1], ahead[upto[k]] + scores[k]))
    back = [-math.inf] * len(scores) + [0.0]
    for k in range(len(scores) - 1, -1, -1):  # what is left after k segments by end flows to k-1 or, by taking one, to its start
        back[k] = log_sum(back[k], back[k + 1]) if back[k] > -math.inf else back[k + 1]
        j, v = upto[k], back[k + 1] + scores[k]
        back[j] = log_sum(back[j], v) if back[j] > -math.inf else v
    return [math.exp(min(0.0, ahead[upto[k]] + scores[k] + back[k + 1] - ahead[-1])) for k in range(len(scores))]


def split(segments: list) -> list[list]:
    """Groups of segments that overlap, one after another: they can be handled on their own."""
    groups: list[list] = []
    reach = -1
    for s in sorted(segments, key=lambda x: (x[0], x[1])):
        if s[0] >= reach:
            groups.append([])
        groups[-1].append(s)
        reach = max(reach, s[1])
    return [sorted(g, key=lambda x: (x[1], x[0], x[2])) for g in groups]


def altered(text: str) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Short texts made from the base spans and what stands around them, each with the spans that it holds."""
    out = []
    for kind, s, e in base_spans(text):
        before, after, span = re.sub(r"[0-9@+(]", "", text[max(0, s - 30) : s]), re.sub(r"[0-9@]", "", text[e : e + 10]), text[s:e]
        if before and not before[-1].isspace():
            before += " "
        if after and (after[0] in LOCAL or after[0] == ")"):
            after = " " + after

        def put(*parts: tuple[str, bool]) -> None:
            made, gold = before, set()
            for part, is_gold in parts:
                if is_gold:
                    gold.add((kind, len(made), len(made) + len(part)))
                made += part
            out.append((made + after, gold))

        if kind == "phone":
            rest = re.sub(r"^\+[0-9]+[\x20().-]*", "", span)
            if rest.count("(") == rest.count(")") and sum(c.isdigit() for c in rest) >= FEWEST:
                put(("tel ", False), (rest, True))
                put(("call ", False), (rest, True))
        elif kind == "card":
            wrong = span[:-1] + str((int(span[-1]) + 1) % 10)
            put((span, True), (" ", False), (span, True))
            put((span, True), (" ", False), (wrong, False))
            put((wrong, False))
        elif kind == "ip":
            put(("300.", False), (span, True))
            put((span.rsplit(".", 1)[0] + ".999", False))
        else:
            local, _, domain = span.partition("@")
            put((f"{local} (at) {domain.replace('.', ' (dot) ')}", True))
            put((f"{local} [at] {domain}", True))
            put((f"{local} @ {domain}", True))
    return out


def examples(text: str) -> list[list[tuple[int, bool, list[str]]]]:
    """Groups of the lattice of the text and of its altered copies: for each segment how many of the group end before it,
    whether it is a span, and its features. In the text itself, shapes that no base pattern can tell have no label, so they
    don't train; nor do parts of runs, which the base patterns only match whole."""
    gold = set(base_spans(text))
    told = [x for x in lattice(text) if "email:spelled" not in x[3] and "email:cut" not in x[3] and (x[2] != "phone" or "phone:plus" in x[3]) and f"{x[2]}:part" not in x[3] and f"{x[2]}:group" not in x[3]]
    out = []
    for segments, spans in [(told, gold), *((lattice(t), g) for t, g in altered(text))]:
        for g in split(segments):
            taken, end = [], -1
            for s, e, kind, _ in g:  # spans of two kinds may overlap: the first by end counts
                taken.append((kind, s, e) in spans and s >= end)
                end = e if taken[-1] else end
            out.append([(u, t, x[3]) for u, t, x in zip(starts_after(g), taken, g)])
    return out


def train(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Weights from the sample: the ``SAMPLE`` least hashes among texts with a digit run or an @ sign, and of their groups,
    equal ones counted as one, the ``GROUPS`` least hashes."""
    likely = sampled(docs.where(F.col(text).rlike(r"@|[0-9][0-9. ()-]{7}")).select("doc_id", F.col(text).alias("text")), SAMPLE, "doc_id", "text").select("text")
    rows = map_rows(likely, "g array<array<struct<upto: int, gold: boolean, names: array<string>>>>", lambda: lambda texts: [[[[{"upto": u, "gold": t, "names": n} for u, t, n in group] for group in examples(t)] for t in texts]])
    groups = rows.select(F.explode("g").alias("g")).groupBy("g").agg(F.count("*").alias("n")).orderBy(F.xxhash64("g"), "g").limit(GROUPS).collect()
    weights, total = dict(START), sum(r.n for r in groups)
    for _ in range(STEPS if groups else 0):
        gradient: dict[str, float] = {}
        for r in groups:
            for s, p in zip(r.g, marginals([s.upto for s in r.g], [score(weights, s.names) for s in r.g]), strict=True):
                for n in s.names:
                    gradient[n] = gradient.get(n, 0.0) + r.n * (s.gold - p)
        for n in gradient.keys() | START.keys():
            weights[n] = weights.get(n, 0.0) + RATE * (gradient.get(n, 0.0) / total - PRIOR * (weights.get(n, 0.0) - START.get(n, 0.0)))
    return weights


def spans_of(text: str | None, weights: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the base and those of the field that overlap no base span; by start, then kind."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    text = text or ""
    base = sorted(base_spans(text), key=order)
    more = best(lattice(text), weights)
    starts, reach = [s for _, s, _ in base], []
    for _, _, e in base:
        reach.append(max(e, reach[-1] if reach else 0))

    def clear(s: int, e: int) -> bool:
        k = bisect_right(starts, e - 1)
        return not k or reach[k - 1] <= s

    return base, sorted([*base, *(x for x in more if clear(x[1], x[2]))], key=order)


def find(docs: DataFrame, weights: dict[str, float], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``base`` and ``found``: arrays of (kind, start, end)."""

    def make():
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

        def run(*columns):
            got = [spans_of(t, weights) for t in columns[-1]]
            return [*columns[:-1], [as_rows(b) for b, _ in got], [as_rows(a) for _, a in got]]

        return run

    kinds = dict(docs.dtypes)
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return map_rows(docs.select(*keep, text), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", base {spans}, found {spans}", make)


def masked(text: str | None, weights: dict[str, float]) -> str | None:
    """The text with every span replaced by its kind in square brackets; of spans that overlap, their union by the first's kind."""
    out, end = [], 0
    for kind, s, e in spans_of(text, weights)[1] if text else ():
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join([*out, text[end:]]) if out else text


def masked_rows(docs: DataFrame, weights: dict[str, float], text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, their texts masked."""
    return change_rows(docs, text, lambda: lambda texts: ([masked(t, weights) for t in texts], None))


def digests(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    def joined(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return find(docs, weights).select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"))
