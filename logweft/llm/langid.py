"""Language identification by words first, then by ever shorter character n-grams.

``train`` counts, over all labelled rows, the words of each language and the n-grams of those words (with ``^`` and
``$`` at the ends), and writes both as tables: every word and every n-gram counts, however rare, so the model grows with
the corpus and never passes through the driver. ``predict`` sums, over the words of the whole text, the log shares by
language: a word that any language has counts as a word; an unseen word counts by the mean over those of its n-grams that
are known, of the greatest length that has any. The score is the share of the best language by the mean log per word, so
it doesn't go to 1 merely because a text is long.

The most frequent words (``HEAD`` at most, at any size) are broadcast and summed where the text is; the other words of a
text leave the task as (text, word, count), are joined with the word table, and what that table doesn't have is joined with
the n-gram table. The split changes the way, not the result: log shares are whole
numbers of 1/65536, so sums don't depend on their order.

A run of more than ``LONGEST`` letters, as in scripts without blanks, is taken as windows of so many letters that overlap
by three, so that every n-gram of the run is in one; windows are counted and scored like words.

That score compares languages; it says nothing about texts of none. ``known_rows`` therefore also asks for evidence that
doesn't grow with the text, where the model was trained for it: the share of the text's n-grams of the greatest length
that are typical of its best language (``TYPICAL`` of that language's n-grams or more), against ``PART`` of that
language's own share over all training rows, less the chance error of a text so short.

Null texts and texts without a letter: ``und`` with score 0. Without any training row every text is ``und``. Ties go to
the first language by name. Null ids are not held out. Equal texts get equal results; repeated rows come out, and are
counted in training, each time. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import dropped, map_rows, text_key, written

#: Words that are broadcast, at most, and their log shares, at most.
HEAD, HEAD_LOGS = 200_000, 8_000_000
#: Least share of a language's n-grams of a length that makes one typical: at most 1/TYPICAL a language and length.
TYPICAL = 5e-5
LENGTHS = (4, 3, 2, 1)
#: Letters of a window of a long run.
LONGEST = 64
#: Bits that each language has in a sum of typical n-grams, which is one whole number for all languages.
LANE = 48
#: A text of a language has this part of the share of typical n-grams that the language's training rows have, less so many standard errors.
PART, ERRORS = 0.4, 2.0
#: Log shares are counted in so many parts of one.
UNIT = 65536
UND = "und"
#: The words of a text that aren't broadcast, with their counts.
REST = "rest array<struct<word: string, n: bigint>>"
LETTERS = r"\p{L}+"


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    #: (word, c) and (gram, c): counts by language; None without training rows.
    words: DataFrame | None = None
    grams: DataFrame | None = None
    #: All words by language, and all n-grams by length and language.
    word_totals: list[int] = field(default_factory=list)
    gram_totals: dict[int, list[int]] = field(default_factory=dict)
    #: The n-grams that coverage asks for and which are typical of a language, each with its place in ``lanes``; only with a gate.
    typical: dict[str, int] = field(default_factory=dict)
    #: Sets of languages, as sums that have one for each of them; the first is empty.
    lanes: list[int] = field(default_factory=list)
    #: By language, the share of typical n-grams over all training rows and the standard error of one n-gram.
    evidence: dict[str, tuple[float, float]] = field(default_factory=dict)


def words_of(text: str | None, find) -> list[str]:
    """The words of a text, in lower case; a long run as windows, marked by a bar and with the run's own ends."""
    words = find((text or "").lower())
    if not words or max(map(len, words)) <= LONGEST:
        return words
    out = []
    for w in words:
        if len(w) <= LONGEST:
            out.append(w)
        else:
            w = f"^{w}$"
            out += ["|" + w[k : k + LONGEST] for k in range(0, len(w) - LENGTHS[0] + 1, LONGEST - LENGTHS[0] + 1)]
    return out


def ended(word: str) -> str:
    return word[1:] if word[0] == "|" else f"^{word}$"


def word_counts(docs: DataFrame, where: Column, langs: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """(word, c): how often each language has each word. A task counts a slice's words before they leave it."""
    place = {x: i for i, x in enumerate(langs)}

    def make():
        find = regex.compile(LETTERS).findall

        def run(labels, texts):
            counts: dict[str, Counter] = {}
            for x, t in zip(labels, texts):
                counts.setdefault(x, Counter()).update(words_of(t, find))
            return [[w for c in counts.values() for w in c], [place[x] for x, c in counts.items() for _ in c], [n for c in counts.values() for n in c.values()]]

        return run

    rows = map_rows(docs.where(where & F.col(lang).isNotNull()).select(lang, text), "word string, l int, n bigint", make)
    return rows.groupBy("word").agg(F.array(*[F.sum(F.when(F.col("l") == i, F.col("n")).otherwise(0)) for i in range(len(langs))]).alias("c"))


def grams_of(words: DataFrame, *keep: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """``keep`` and gram: a row for each n-gram of these lengths of each word."""
    whole = words.select(*keep, F.expr("if(startswith(word, '|'), substring(word, 2), concat('^', word, '$'))").alias("w"))
    return whole.select(*keep, F.explode(F.expr(f"flatten(transform(filter(array({', '.join(map(str, lengths))}), k -> k <= length(w)), k -> transform(sequence(1, length(w) - k + 1), i -> substring(w, i, k))))")).alias("gram"))


def train(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", gate: bool = False) -> Model:
    """A model of the rows that ``where`` holds for and whose language isn't null; with ``gate``, also its evidence."""
    langs = sorted(r[0] for r in docs.where(where & F.col(lang).isNotNull()).select(lang).distinct().collect())
    if not langs:
        return Model()
    sums = [F.coalesce(F.sum(F.col("c")[i]), F.lit(0)).alias(f"s{i}") for i in range(len(langs))]
    words = written(word_counts(docs, where, langs, text, lang), "words", cleaned=True)
    word_totals = list(words.agg(*sums).first())
    if not sum(word_totals):
        return Model()
    grams = grams_of(words, "c").groupBy("gram").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(len(langs))]).alias("c"))
    grams = written(grams, "grams", cleaned=True)
    totals = {r[0]: list(r)[1:] for r in grams.groupBy(F.length("gram")).agg(*sums).collect()}
    model = Model(langs, words, grams, word_totals, {k: totals.get(k, [0] * len(langs)) for k in LENGTHS})
    if gate:
        least = F.array(*[F.element_at(F.create_map(*[F.lit(x) for k in LENGTHS for x in (k, max(1.0, TYPICAL * model.gram_totals[k][i]))]), F.length("gram")) for i in range(len(langs))])
        marks = F.zip_with("c", least, lambda n, m: n >= m)
        # coverage asks for n-grams of the greatest length, and for whole words of one letter
        asked = (F.length("gram") == LENGTHS[0]) | (F.col("gram").startswith("^") & F.col("gram").endswith("$"))
        found = grams.where(asked).select("gram", marks.alias("marks")).where(F.exists("marks", lambda x: x)).collect()
        sets: dict[tuple, int] = {(): 0}
        model.typical = {r.gram: sets.setdefault(tuple(i for i, x in enumerate(r.marks) if x), len(sets)) for r in found}
        model.lanes = [sum(1 << LANE * i for i in some) for some in sets]
        model.evidence = evidence(words, model)
    return model


def coverage(typical: dict[str, int], lanes: list[int], langs: int, word: str) -> int:
    """How many of a word's n-grams of the greatest length are typical of each language, and how many there are, as one sum."""
    w, get = ended(word), typical.get
    k = min(LENGTHS[0], len(w))
    many = len(w) - k + 1
    return sum([lanes[get(w[i : i + k], 0)] for i in range(many)]) + (many << LANE * langs)


def apart(total: int, langs: int) -> list[int]:
    """The counts in a sum of coverage: one for each language, and all."""
    return [total >> LANE * i & (1 << LANE) - 1 for i in range(langs + 1)]


def evidence(words: DataFrame, model: Model) -> dict[str, tuple[float, float]]:
    """The model's ``evidence`` from all counted words; one row comes to the driver."""
    shared, many = words.sparkSession.sparkContext.broadcast((model.typical, model.lanes)), len(model.langs)

    def make():
        typical, lanes = shared.value
        return lambda words, c: [c, [[float(x) for x in apart(coverage(typical, lanes, many, w), many)] for w in words]]

    rows = map_rows(words.select("word", "c"), "c array<bigint>, v array<double>", make)
    g = F.col("v")[many]
    parts = [F.sum(F.col("c")[i] * x) for i in range(many) for k in (F.col("v")[i],) for x in (k, g, k * k, k * g, g * g)]
    got = rows.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
    out = {}
    for i, lang in enumerate(model.langs):
        k, g, kk, kg, gg = got[5 * i : 5 * i + 5]
        share = k / g if g else 0.0
        out[lang] = (share, max(0.0, (kk - 2 * share * kg + share * share * gg) / g) ** 0.5 if g else 0.0)
    return out


def logs(counts: Column, totals: list) -> Column:
    """Log shares of an array of counts by language, in units. What a language doesn't have counts as half of one of all,
    for every language alike: below all that it may have."""
    floor = float(np.log(0.5 / max(1, sum(totals))))
    share = lambda n, t: F.when(n > 0, F.log(n / t)).otherwise(F.lit(floor))
    return F.zip_with(counts, F.array(*[F.lit(float(max(t, 1))) for t in totals]), lambda n, t: F.round(share(n, t) * UNIT).cast("long"))


def word_logs(model: Model, where: Column | None = None) -> DataFrame:
    """(word, v): log shares by language of every counted word, or of those that ``where`` holds for."""
    words = model.words if where is None else model.words.where(where)
    return words.select("word", logs(F.col("c"), model.word_totals).alias("v"))


def unseen_logs(model: Model, words: DataFrame) -> list[DataFrame]:
    """Tables (word, v) for distinct words that no language has: the mean over their known n-grams of the greatest length that has
    any; words without a known n-gram are left out. A length is only asked for by the words that no greater one told, so most
    words' shorter n-grams are never made."""
    many, found, left = len(model.langs), [], words
    for k in LENGTHS:
        grams = model.grams.where(F.length("gram") == k).select("gram", logs(F.col("c"), model.gram_totals[k]).alias("v"))
        known = grams_of(left, "word", lengths=(k,)).join(grams, "gram")
        found.append(written(known.groupBy("word").agg(F.array(*[F.round(F.sum(F.col("v")[i]) / F.count("*")).cast("long") for i in range(many)]).alias("v")), "backoff", cleaned=True))
        more = written(left.join(found[-1], "word", "left_anti"), "left", cleaned=True)
        if left is not words:
            dropped(left)
        left = more
        if left.isEmpty():
            break
    dropped(left)
    return found


def frequent(model: Model) -> Column:
    """Marks of the most frequent words: those above the least count that so many words reach at most, by a histogram."""
    n = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    bars = model.words.select(n.alias("n")).groupBy(F.floor(F.log2("n") * 8).alias("bar")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("bar")).collect()
    least, many = 2**62, 0
    for r in bars:
        if (many := many + r.k) > min(HEAD, HEAD_LOGS // len(model.langs)):
            break
        least = r.n
    return n >= least


def head_sums(docs: DataFrame, model: Model, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, n (the text's words), v (log shares of its frequent words), cover, and rest: its other words with counts."""
    head = word_logs(model, frequent(model)).toArrow()  # at most HEAD words
    place = {w: i for i, w in enumerate(head.column("word").to_pylist())}
    many, gate = len(model.langs), bool(model.evidence)
    table = np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy().astype(np.int32) for c in head.column("v").chunks)]).reshape(-1, many)
    covers = np.array([apart(coverage(model.typical, model.lanes, many, w), many) for w in place] if gate else [], np.int32).reshape(-1, many + 1)
    shared = docs.sparkSession.sparkContext.broadcast((place, table, covers, model.typical, model.lanes))
    kind = to_arrow_schema(StructType.fromDDL(REST)).field(0).type

    def make():
        place, table, covers, typical, lanes = shared.value
        find, get = regex.compile(LETTERS).findall, place.get

        def run(*columns):
            sizes, sums, covered, rest, counts, ends = [], [], [], [], [], [0]
            for t in columns[-1]:
                words = words_of(t, find)
                at, ns, cover = [], [], 0
                for w, n in Counter(words).items():
                    if (i := get(w)) is not None:
                        at.append(i)
                        ns.append(n)
                        continue
                    rest.append(w)
                    counts.append(n)
                    if gate:
                        cover += n * coverage(typical, lanes, many, w)
                ns = np.array(ns, np.int64)
                sizes.append(len(words))
                sums.append((ns @ table[at]).tolist())
                covered.append((ns @ covers[at] + apart(cover, many)).astype(float).tolist() if gate and words else None)
                ends.append(len(rest))
            pairs = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(counts, pa.int64())], fields=list(kind.value_type))
            return [*columns[:-1], sizes, sums, covered, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs, type=kind)]

        return run

    kinds = dict(docs.dtypes)
    return map_rows(docs.select(*keep, text), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n bigint, v array<bigint>, cover array<double>, " + REST, make)


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), made: list[DataFrame] | None = None) -> DataFrame:
    """``keep``, lang_pred, score and enough: whether the text has the evidence that the model asks for. The tables that
    the result still reads are added to ``made``."""
    many = len(model.langs)
    if not many:
        return docs.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("enough"))
    # rows get their number as they are written, so it stays
    first = written(head_sums(docs, model, text, tuple(keep)).withColumn("row_id", F.monotonically_increasing_id()), "texts", cleaned=True)
    rest = first.select("row_id", F.explode("rest").alias("r")).select("row_id", F.col("r.word").alias("word"), F.col("r.n").alias("m"))
    # each word is told once, then joined with the texts that have it; what all languages get alike is left out
    asked = written(rest.select("word").distinct(), "asked", cleaned=True)
    seen = word_logs(model).join(asked, "word", "left_semi")
    unseen = written(asked.join(model.words, "word", "left_anti").select("word"), "unseen", cleaned=True)
    backed = unseen_logs(model, unseen)
    # what a language has more than the one that has least; rare words are mostly of one language
    more = F.posexplode(F.transform("v", lambda x: x - F.array_min("v"))).alias("l", "d")
    told = written(reduce(DataFrame.union, backed, seen).select("word", more).where("d != 0"), "told", cleaned=True)
    # written, so that the shuffle by word is gone before the one by text begins
    pairs = written(rest.join(told, "word").select("row_id", "l", (F.col("d") * F.col("m")).alias("s")), "pairs", cleaned=True)
    for t in (asked, told, unseen, *backed):
        dropped(t)
    sums = pairs.groupBy("row_id", "l").agg(F.sum("s").alias("s"))
    sums = written(sums.groupBy("row_id").agg(F.array(*[F.sum(F.when(F.col("l") == i, F.col("s")).otherwise(0)) for i in range(many)]).alias("w")), "sums", cleaned=True)
    dropped(pairs)
    if made is not None:
        made += [first, sums]
    both = first.select(*keep, "row_id", "n", "v", "cover").join(sums, "row_id", "left")
    both = both.withColumn("v", F.when(F.col("w").isNull(), F.col("v")).otherwise(F.zip_with("v", "w", lambda a, b: a + b)))
    means = F.transform("v", lambda x: x / F.lit(float(UNIT)) / F.greatest("n", F.lit(1)))
    best = F.array_max("v")
    at = F.array_position("v", best)
    share = F.lit(1.0) / F.aggregate(means, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(means)))
    named = F.col("n") > 0
    out = both.select(*keep, "cover", named.alias("named"), at.cast("int").alias("at"), share.alias("share"))
    langs = F.array(*[F.lit(x) for x in model.langs])
    enough = F.lit(True)
    if model.evidence:
        told = [model.evidence.get(x, (0.0, 0.0)) for x in model.langs]
        held, all_grams = F.element_at("cover", F.col("at")), F.element_at("cover", F.lit(many + 1))
        least = PART * F.element_at(F.array(*[F.lit(s) for s, _ in told]), F.col("at")) - ERRORS * F.element_at(F.array(*[F.lit(e) for _, e in told]), F.col("at")) / F.sqrt(F.greatest(all_grams, F.lit(1.0)))
        enough = (held > 0) & (held >= least * all_grams)
    return out.select(*keep, F.when(F.col("named"), F.element_at(langs, F.col("at"))).otherwise(F.lit(UND)).alias("lang_pred"), F.when(F.col("named"), F.col("share")).otherwise(F.lit(0.0)).alias("score"), F.when(F.col("named"), enough).otherwise(F.lit(False)).alias("enough"))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score."""
    return scored(docs, model, text, tuple(keep)).select(*keep, "lang_pred", "score")


def known_rows(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language with a score of at least ``least``,
    and the evidence for it where the model has some. The texts that go are joined with the rows by their keys."""
    texts = docs.select(F.col(text).alias("_text")).withColumn("_key", text_key("_text"))
    made: list[DataFrame] = []
    told = scored(texts, model, "_text", ("_key",), made)
    gone = written(told.where((F.col("lang_pred") == UND) | (F.col("score") < least) | ~F.col("enough")).select("_key").distinct(), "gone", cleaned=True)
    for t in made:
        dropped(t)
    return docs.withColumn("_key", text_key(text)).join(gone, "_key", "left_anti").select(*docs.columns)


def discard(model: Model) -> None:
    """Deletes the model's tables once nothing reads them any more."""
    for df in (model.words, model.grams):
        if df is not None:
            dropped(df)
