"""URL filter: rules first, then naive Bayes over segmented names.

Host labels and path parts are cut into names (runs of letters) and numbers. A unigram Viterbi splits each distinct name
into words: the words' shares come from the text of all pages, every counted word included. The names' substrings of up to
``LONGEST`` letters, and the names themselves, are joined with the words, so a name meets its own words only and neither
table passes through the driver. Letters that are in no word come out as pieces of their own. A multinomial naive Bayes
with add-one smoothing learns, from all urls that rules decide, the tokens of block and allow: each piece and number by
where it stands. A token's log odds are joined with the names that have it, a name's sum with the urls that have the name;
frequent names (``HEAD`` of all or more) are broadcast for that, as they stand in so many urls; nothing else is, as all other
tables grow with the pages and a broadcast passes through the driver (``shuffled``). It decides the urls that no rule fits. Log odds are whole numbers of 1/65536, so sums don't depend on their order.

Null urls, and urls without ``://``: empty host and path. No url decided by rules: everything else is allowed, score 0.5.
Equal odds: allow. Of rules that fit, the longest wins, then the first by text. Equal urls get equal results; repeated rows
come out, and are counted, each time. Other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_rows, shuffled, written

#: Longest word inside a longer name, in letters; a name itself is looked up at any length.
LONGEST = 24
#: Names with at least this share of all names' occurrences are broadcast: at most 1/HEAD of them.
HEAD = 1e-4
#: Odds are counted in so many parts of one.
UNIT = 65536
BLOCK, ALLOW = "block", "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"\p{L}+|\p{N}+"


def split_url(url: str) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.expr(f"case when instr(`{url}`, '://') > 0 then substring(`{url}`, instr(`{url}`, '://') + 3) else '' end")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def decide(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict for the columns host and path; null where none fits. A rule is its host with its path, and block or allow.
    A list of rules is program text, so it is short; each url is compared with all."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule and the rule's verdict."""
    host, path = split_url(url)
    rule, verdict = decide(rules)
    parts = pages.select(*keep, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    return parts.select(*keep, "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def lexicon(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n): the words of all pages' text, tags left out, with their counts."""
    text = F.lower(F.regexp_replace(html, r"<[^>]*>", " "))
    return pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def unknown(letters: int, total: int) -> float:
    """Log share of a piece that is no word: the longer the rarer."""
    return math.log(10 / max(total, 20)) - letters * math.log(10)


def segment(name: str, words: dict[str, float], total: int) -> list[str]:
    """The likeliest split of a name into words and pieces that are none."""
    n, whole = len(name), words.get(name)
    step, begin = math.log(10), math.log(10 / max(total, 20))
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    odd, since = -math.inf, 0  # the best split whose last piece is no word and ends here, and where that piece begins
    for end in range(1, n + 1):
        fresh = best[end - 1] + begin
        if fresh > odd:
            odd, since = fresh, end - 1
        odd -= step
        best[end], back[end] = odd, since
        for start in range(max(0, end - LONGEST), end):
            share = words.get(name[start:end])
            if share is not None and best[start] + share > best[end]:
                best[end], back[end] = best[start] + share, start
    if whole is not None and whole > best[n]:
        return [name]
    out: list[str] = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


def segments(names: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(name, pieces) of distinct names, by the words of the lexicon that occur in them. A name of L letters has at most
    LONGEST * L substrings."""
    inside = lambda x: list({x, *(x[i : i + k] for i in range(len(x)) for k in range(1, min(LONGEST, len(x) - i) + 1))})
    parts = map_rows(names.select("name"), "name string, parts array<string>", lambda: lambda n: [n, list(map(inside, n))]).select("name", F.explode("parts").alias("word"))
    share = F.log(F.col("n") / F.lit(float(max(total, 1))))
    known = parts.join(shuffled(words), "word").select("name", F.struct("word", share.alias("share")).alias("w"))
    held = names.join(shuffled(known.groupBy("name").agg(F.collect_list("w").alias("words"))), "name", "left")
    return map_rows(held.select("name", "words"), "name string, pieces array<string>", lambda: lambda n, w: [n, [segment(x, {y["word"]: y["share"] for y in ws or []}, total) for x, ws in zip(n, w)]])


def names_of(urls: DataFrame, *keep: str) -> DataFrame:
    """``keep``, at (h for hosts, p for paths) and name: a row for each name and number of each url."""
    found = lambda c, at: F.transform(F.regexp_extract_all(F.lower(c), F.lit(PARTS), F.lit(0)), lambda x: F.struct(F.lit(at).alias("at"), x.alias("name")))
    return urls.select(*keep, F.explode(F.concat(found("host", "h"), found("path", "p"))).alias("f")).select(*keep, "f.at", "f.name")


def odds(tokens: DataFrame, rows: dict[str, int]) -> tuple[DataFrame, int]:
    """(at, piece, o): the log odds of block against allow of each token, from (verdict, at, piece, n); and the classes' log
    odds, from their numbers of rows."""
    by = tokens.groupBy("at", "piece").agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in (BLOCK, ALLOW)])
    size = by.agg(F.count("*").alias("k"), *[F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in (BLOCK, ALLOW)]).first()
    share = lambda v: F.log((F.col(v) + 1) / F.lit(float(size[v] + size.k + 1)))
    prior = math.log((rows.get(BLOCK, 0) + 1) / (rows.get(ALLOW, 0) + 1)) if rows else 0.0
    return by.select("at", "piece", F.round((share(BLOCK) - share(ALLOW)) * UNIT).cast("long").alias("o")), round(prior * UNIT)


def filtered(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule, verdict and score, the method's share of block (also where a rule decides)."""
    words = written(lexicon(pages, html), "lexicon")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    decided = judged(pages, rules, url, keep)
    urls = written(decided.groupBy("host", "path").agg(F.first("verdict").alias("verdict"), F.count("*").alias("n")), "urls")  # equal urls are judged alike
    rows = {r.verdict: r.n for r in urls.where("verdict is not null").groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    names = written(names_of(urls, "host", "path", "verdict", "n"), "names")
    split = written(segments(names.select("name").distinct(), words, total), "segments")
    # the two classes' counts of each name, then of its pieces: a name that many urls have is one row for each class
    counted = names.where("verdict is not null").groupBy("verdict", "at", "name").agg(F.sum("n").alias("n"))
    tokens = counted.join(shuffled(split), "name").select("verdict", "at", "n", F.explode("pieces").alias("piece"))
    token_odds, prior = odds(tokens.groupBy("verdict", "at", "piece").agg(F.sum("n").alias("n")), rows)
    pieces = split.select("name", "pieces", F.explode(F.array(F.lit("h"), F.lit("p"))).alias("at")).select("at", "name", F.explode("pieces").alias("piece"))
    worth = written(pieces.join(shuffled(token_odds), ["at", "piece"]).groupBy("at", "name").agg(F.sum("o").alias("o")), "worth")
    most = names.count()
    frequent = names.groupBy("at", "name").count().where(F.col("count") >= max(HEAD * most, 1)).join(shuffled(worth), ["at", "name"]).select("at", "name", "o")
    frequent = written(frequent, "frequent")  # at most 1/HEAD
    told = names.select("host", "path", "at", "name").join(F.broadcast(frequent), ["at", "name"], "left")
    rare = told.where("o is null").drop("o").join(shuffled(worth), ["at", "name"])
    sums = told.where("o is not null").select("host", "path", "o").union(rare.select("host", "path", "o")).groupBy("host", "path").agg(F.sum("o").alias("o"))
    sums = written(sums, "sums")
    for t in (words, urls, names, split, worth, frequent):
        dropped(t)
    score = F.lit(1.0) / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), (F.coalesce("o", F.lit(0)) + prior) / F.lit(float(UNIT))))))
    both = decided.join(shuffled(sums), ["host", "path"], "left").withColumn("score", score)
    return both.select(*keep, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")
