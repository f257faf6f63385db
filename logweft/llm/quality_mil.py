"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, over its whole text. Every passage is encoded by itself (measures of
its letters, marks, words and repetitions, and how often each kind of character follows each other kind, through a tanh
layer), a gated attention gives each passage a weight, and a logistic unit scores the weighted sum of the encodings. All
weights are learned together from document labels alone.

Training takes a bounded sample of labelled rows, with all their passages: of the ``SAMPLE`` rows of least hash of their
id, the first ones that have at most ``PASSAGES`` passages together; so what reaches the driver is bounded. Scoring takes
every passage of every document.

Empty and null texts are one passage without words. Without any label every score is 0.5; with labels of one kind only,
the scores tend to that kind. Null ids are not held out. Several labels of one id: their mean, 0.5 counting as 1; null labels are left out. Repeated rows
are scored each time; other columns of the input are ignored.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, map_rows, sampled, written

PASSAGE = 60
SAMPLE = 4000
PASSAGES = 100_000
#: Passages of one training row; scoring takes all passages of a text.
ROW = 2_000
HIDDEN, ATTENTION = 16, 8
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4

UPPER, LOWER, DIGIT, STOP, SHOUT, BAR, MARK, SPACE, OTHER = range(9)
KINDS = 9
MEASURES = 19 + KINDS * KINDS
#: Code points whose kind is told one by one: all planes with scripts; those beyond count as other.
CODES = 0x32000


def _classes() -> np.ndarray:
    kinds = np.full(CODES, OTHER, np.int8)
    for code in range(CODES):
        c = chr(code)
        if c.isalpha():
            kinds[code] = UPPER if c.isupper() else LOWER
        elif code < 128 or not c.isprintable() or c.isdigit():
            kinds[code] = DIGIT if c.isdigit() else SPACE if c.isspace() else STOP if c in ".,;:'\"?-()" else SHOUT if c == "!" else BAR if c in "|/\\_<>{}[]=" else MARK if code < 128 else OTHER
    return kinds


CLASSES = _classes()


def measures(text: str | None) -> np.ndarray:
    """A row of measures for each passage."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, MEASURES), np.float32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    codes = np.frombuffer(" ".join(words).encode("utf-32-le", "replace"), np.uint32)
    kinds = CLASSES[np.minimum(codes, CODES - 1)]
    cut = np.arange(0, len(words), PASSAGE)
    edges = starts[cut]
    many = len(cut)
    passage = np.repeat(np.arange(many), np.diff(np.append(edges, len(kinds))))
    counts = np.bincount(passage * KINDS + kinds, minlength=many * KINDS).reshape(many, KINDS)
    pairs = np.bincount((passage[:-1] * KINDS + kinds[:-1]) * KINDS + kinds[1:], minlength=many * KINDS * KINDS).reshape(many, KINDS * KINDS)
    chars = np.maximum(counts.sum(axis=1) - counts[:, SPACE], 1)
    n = np.diff(np.append(cut, len(words)))
    first, last = kinds[starts], kinds[starts + sizes - 1]
    out = np.zeros((many, MEASURES), np.float32)
    out[:, :8] = counts[:, [UPPER, LOWER, DIGIT, STOP, SHOUT, BAR, MARK, OTHER]] / chars[:, None]
    out[:, 8] = np.add.reduceat(sizes, cut) / n / 10
    out[:, 9] = np.sqrt(np.maximum(np.add.reduceat(sizes * sizes, cut) / n - (out[:, 8] * 10) ** 2, 0)) / 10
    out[:, 10] = np.minimum(np.maximum.reduceat(sizes, cut), 100) / 20
    out[:, 11] = np.add.reduceat(first == UPPER, cut, dtype=np.int64) / n
    out[:, 12] = np.add.reduceat(last == STOP, cut, dtype=np.int64) / n
    out[:, 13] = np.add.reduceat(sizes == 1, cut, dtype=np.int64) / n
    out[:, 14] = np.add.reduceat((last == SHOUT) | (last == MARK) | (last == BAR), cut, dtype=np.int64) / n
    for i, k in enumerate(cut):
        part = words[k : k + PASSAGE]
        m = len(part)
        out[i, 15] = len(set(part)) / m
        out[i, 16] = sum(map(eq, part, part[1:])) / m
        out[i, 17] = len(set(zip(part, part[1:]))) / max(m - 1, 1)
    out[:, 18] = np.log1p(n) / 5
    out[:, 19:] = pairs / np.maximum(counts.sum(axis=1), 1)[:, None] * 2
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray):
    """Scores of bags: x has all their passages one below the other, ``at`` where each bag begins."""
    z = (x - p["mean"]) / p["scale"]
    h = np.tanh(z @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(x))))
    e = np.exp(e - np.maximum.reduceat(e, at)[bag])
    a = e / np.add.reduceat(e, at)[bag]
    m = np.add.reduceat(a[:, None] * h, at, axis=0)
    return sigmoid(m @ p["c"] + p["d"]), z, h, t, g, a, m, bag


def gradients(p: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Those of the mean log loss of bags."""
    y, z, h, t, g, a, m, bag = forward(p, x, at)
    dy = (y - labels) / len(labels)
    dm = dy[:, None] * p["c"]
    da = (dm[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, at)[bag])
    dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dm[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"W": z.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": m.T @ dy, "d": dy.sum(keepdims=True)}


def begin(every: np.ndarray) -> dict[str, np.ndarray]:
    """Starting weights from a fixed seed, and the measures' scale."""
    rng = np.random.default_rng(7)
    p = {"mean": every.mean(axis=0), "scale": every.std(axis=0) + 0.05}
    return p | {"W": rng.normal(0, MEASURES**-0.5, (MEASURES, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.1, ATTENTION), "c": rng.normal(0, 0.1, HIDDEN), "d": np.zeros(1)}


def fit(bags: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
    """Adam on the mean log loss; bags in an order from a fixed seed."""
    p = begin(np.concatenate(bags) if bags else np.zeros((1, MEASURES), np.float32))
    if not bags:
        return p | {"c": np.zeros(HIDDEN)}
    rng = np.random.default_rng(11)
    learned = [k for k in p if k not in ("mean", "scale")]
    first, second, step = {k: np.zeros_like(p[k]) for k in learned}, {k: np.zeros_like(p[k]) for k in learned}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            took = order[k : k + BATCH]
            at = np.cumsum([0, *(len(bags[i]) for i in took[:-1])])
            grads = gradients(p, np.concatenate([bags[i] for i in took]), at, labels[took])
            step += 1
            for n in learned:
                d = grads[n] + DECAY * p[n]
                first[n] = 0.9 * first[n] + 0.1 * d
                second[n] = 0.999 * second[n] + 0.001 * d * d
                p[n] = p[n] - RATE * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return p


def train(docs: DataFrame, labels: DataFrame, where: Column, text: str = "text", label: str = "quality") -> dict[str, np.ndarray]:
    """Weights from the sample of labelled rows that ``where``, on doc_id, holds for."""
    marked = labels.where(where & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    sample = sampled(marked, SAMPLE, "doc_id")
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "y", "text")  # at most SAMPLE rows

    def run(ids, ys, texts):
        bags = [thinned(measures(t)) for t in texts]
        return [ids, ys, list(map(len, bags)), [b.tobytes() for b in bags]]

    order = [F.xxhash64("doc_id"), "doc_id", "x"]
    bags = map_rows(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, n bigint, x binary", lambda: run).orderBy(*order).limit(SAMPLE)
    bags = written(bags.withColumn("k", F.row_number().over(Window.orderBy(*order))), "bags")  # at most SAMPLE rows
    chosen, total = [], 0
    for k, n in sorted((r.k, r.n) for r in bags.select("k", "n").collect()):
        if total + n <= PASSAGES:  # a row that doesn't fit is left out, and smaller ones after it may fit
            chosen, total = [*chosen, k], total + n
    found = bags.where(F.col("k").isin(chosen)).orderBy("k").select("y", "x").collect()
    dropped(bags)
    return fit([np.frombuffer(r.x, np.float32).reshape(-1, MEASURES) for r in found], np.array([r.y for r in found], float))


def thinned(bag: np.ndarray) -> np.ndarray:
    """A training row's passages: all, or ``ROW`` that lie evenly over a longer text."""
    return bag if len(bag) <= ROW else bag[np.linspace(0, len(bag) - 1, ROW).round().astype(int)]


def score(docs: DataFrame, weights: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score."""

    def make():
        def run(*columns):
            scores = []
            for t in columns[-1]:
                x = measures(t)
                scores.append(round(float(forward(weights, x, np.array([0]))[0][0]), 9))
            return [*columns[:-1], scores]

        return run

    kinds = dict(docs.dtypes)
    return map_rows(docs.select(*keep, text), ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", score double", make)
