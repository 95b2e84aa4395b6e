"""Toxicity: a logistic classifier over words and word beginnings, regularised by counterfactuals.

In labelled sentences that mention an identity group, the term is swapped for another of its kind; the loss penalises the
square of the change of score, so that a neutral mention of a group doesn't move the score whichever group it is.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE_ROWS, chosen by a hash of the id); features are
chosen by a test of their association with the label over the whole texts of the sample. Scoring reads every whole text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from .shared import column, forget, fresh, kept, mapped, written

#: What a model is fitted on, at most: labelled rows, and sentences of theirs before and after a swap; both chosen by a hash.
SAMPLE_ROWS, SAMPLE_PAIRS = 20_000, 60_000
#: Features of the model, at most; each must occur in so many texts and have so large a G statistic (about p = 1e-6).
MOST_FEATURES, LEAST_TEXTS, LEAST_G = 4096, 8, 24.0
#: Lengths of word beginnings that are features besides whole words, and how many different words of a text must share one.
BEGINNINGS, LEVELS = (4, 5, 6, 7), (1, 2, 3, 5)
#: Weights of the penalties: counterfactual score changes (per sentence), and squared weights (over all rows).
CF_WEIGHT, L2 = 5.0, 0.5
ROUNDS = 400
#: Words a worker remembers the features of before it starts afresh.
MOST_WORDS = 100_000

#: Identity terms by kind; a term is only swapped for another of its kind.
IDENTITY = {
    "gender": "woman man women men girl boy girls boys female male transgender".split(),
    "religion": "muslim christian jewish hindu buddhist atheist muslims christians jews hindus buddhists atheists".split(),
    "origin": (
        "black white asian african european latino mexican chinese arab indian immigrant immigrants refugee refugees".split()
    ),
    "orientation": "gay straight lesbian bisexual heterosexual homosexual queer".split(),
    "ability": "deaf blind disabled autistic".split(),
}
_KIND = {term: kind for kind, terms in IDENTITY.items() for term in terms}
_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits (everything beyond ASCII counts as a letter)."""
    return text.lower().encode("utf-8", "replace").translate(_SPACE).decode("utf-8", "replace").split()


def features(found: set[str]) -> set[str]:
    """Of a text's different words: each one (=word), and beginnings by the levels they reach (2begin: two words or more)."""
    out = {f"={w}" for w in found}
    for begin, n in Counter(w[:k] for w in found for k in BEGINNINGS if len(w) >= k).items():
        out.update(f"{level}{begin}" for level in LEVELS if level <= n)
    return out


def swapped(sentence: list[str], turn: int) -> list[str] | None:
    """The sentence with each identity term swapped for another of its kind; None if it has none."""
    if not any(w in _KIND for w in sentence):
        return None
    out = []
    for w in sentence:
        kind = IDENTITY.get(_KIND.get(w, ""))
        step = 1 + (zlib.crc32(w.encode()) + turn) % (len(kind) - 1) if kind else 0
        out.append(kind[(kind.index(w) + step) % len(kind)] if kind else w)
    return out


@dataclass(frozen=True)
class Model:
    """index: feature -> place in weights. Its size is bounded by MOST_FEATURES. informed: whether both labels were seen."""

    index: dict[str, int]
    weights: np.ndarray
    bias: float
    informed: bool = True

    def scorer(self):
        """text -> score; remembers words, so each worker makes its own."""
        memory: dict[str, tuple[int | None, tuple[str, ...]]] = {}
        watched = {f[1:] for f in self.index if f[0] != "="}
        index, weights = self.index, self.weights.tolist()

        def score(text: str | None) -> float:
            if len(memory) > MOST_WORDS:
                memory.clear()
            z, counts = self.bias, {}
            for w in sorted(set(words(text or ""))):  # in order, so that sums are the same everywhere
                known = memory.get(w)
                if known is None:
                    begins = tuple(w[:k] for k in BEGINNINGS if len(w) >= k and w[:k] in watched)
                    known = memory[w] = index.get(f"={w}"), begins
                if known[0] is not None:
                    z += weights[known[0]]
                for begin in known[1]:
                    counts[begin] = counts.get(begin, 0) + 1
            for begin, n in counts.items():
                for level in LEVELS:
                    if level > n:
                        break
                    at = index.get(f"{level}{begin}")
                    if at is not None:
                        z += weights[at]
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        return score


class Rows:
    """Sparse 0/1 rows: z() multiplies by weights, back() by the transpose."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], np.int64)

    def z(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.col], self.n) if self.n else np.zeros(0)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, values[self.row], self.width) if self.n else np.zeros(self.width)


def fit(
    rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], width: int,
    cf_weight: float = CF_WEIGHT, l2: float = L2, rounds: int = ROUNDS,
) -> tuple[np.ndarray, float]:
    """Weights and bias by Nesterov's accelerated gradient over all rows, from zero.

    pairs: features of sentences before and after a swap. Without rows of both labels the weights stay zero.
    """
    y = labels.astype(float)
    if not len(y) or y.min() == y.max():
        return np.zeros(width), 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    x, a, b = Rows(rows, width), Rows([p for p, _ in pairs], width), Rows([q for _, q in pairs], width)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    scale = 1 / np.sqrt(np.bincount(x.col, minlength=width) + 1.0)  # features that few texts have move as fast as others
    v, ahead, t, bias = np.zeros(width), np.zeros(width), 1.0, math.log(y.mean() / (1 - y.mean()))
    ahead_bias, step = bias, 1.0

    def loss(v, bias, slope=True):
        w = v * scale
        z = x.z(w) + bias
        p, pa_, pb = sigmoid(z), sigmoid(a.z(w) + bias), sigmoid(b.z(w) + bias)
        change = pa_ - pb
        value = np.logaddexp(0, z).sum() - (y * z).sum() + cf_weight * (change**2).sum() + l2 * (w**2).sum() / 2
        if not slope:
            return float(value)
        da, db = 2 * cf_weight * change * pa_ * (1 - pa_), -2 * cf_weight * change * pb * (1 - pb)
        back = x.back(p - y) + a.back(da) + b.back(db) + l2 * w
        return float(value), back * scale, float((p - y).sum() + da.sum() + db.sum()) / len(y)

    for _ in range(rounds):
        value, slope, bias_slope = loss(ahead, ahead_bias)
        while True:
            new, new_bias = ahead - step * slope, ahead_bias - step * bias_slope
            fall = step / 2 * ((slope**2).sum() + len(y) * bias_slope**2)
            if loss(new, new_bias, False) <= value - fall + 1e-9 * abs(value) or step < 1e-6:
                break
            step /= 2
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        by = (t - 1) / t_new
        if ((ahead - new) * (new - v)).sum() > 0:  # the momentum points uphill
            by, t_new = 0.0, 1.0
        ahead, ahead_bias = new + by * (new - v), new_bias + by * (new_bias - bias)
        v, bias, t, step = new, new_bias, t_new, step * 1.1
    return v * scale, bias


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, int]]:
    for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
        yield t.as_py() or "", y


def choose_features(sample: DataFrame) -> list[str]:
    """The features with the largest G statistic of association with the label, counted over whole texts."""

    def count(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                pos, neg = Counter(), Counter()
                for text, y in _texts(b.slice(at, 500)):
                    (pos if y else neg).update(features(set(words(text))))
                names = list(pos | neg)
                counts = (pa.array([c[n] for n in names], pa.int64()) for c in (pos, neg))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], ["feature", "pos", "neg"])

    sums = {bool(r["toxic"]): r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(sums.get(True, 0)), float(sums.get(False, 0))
    if not n1 or not n0:
        return []
    counts = sample.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature")
    counts = counts.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    pos, neg = F.col("pos"), F.col("neg")
    share = (pos + neg) / (n1 + n0)
    with_it = part(pos, share * n1) + part(neg, share * n0)
    without_it = part(n1 - pos, (1 - share) * n1) + part(n0 - neg, (1 - share) * n0)
    some = counts.where((pos + neg >= LEAST_TEXTS) & (pos + neg < n1 + n0))
    kept = some.withColumn("g", 2 * (with_it + without_it)).where(F.col("g") >= LEAST_G)
    return [r["feature"] for r in kept.orderBy(F.desc("g"), "feature").limit(MOST_FEATURES).select("feature").collect()]


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS, text: str = "text",
    id_col: str = "doc_id", sample_pairs: int = SAMPLE_PAIRS,
) -> Model:
    """Fits on at most sample_rows labelled rows of docs for whose doc_id usable holds, and on at most sample_pairs sentences
    of theirs before and after a swap.

    Rows of labels with a null id or label are passed over; of several labels of one id the larger counts. Without labels
    of both kinds the model scores every text alike and isn't informed.
    """
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = (known if usable is None else known.where(usable)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(column(id_col).alias("doc_id"), column(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(rows.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")), "toxicity-sample")
    index = {f: n for n, f in enumerate(choose_features(sample))}

    def featured(batches) -> Iterator[pa.RecordBatch]:
        kept("toxicity")  # nothing of the stage before
        ids = lambda ws: sorted(index[f] for f in features(set(ws)) if f in index)
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            out = []
            for text, y in _texts(b):
                out.append((y, ids(words(text)), None))
                for sentence in text.replace("!", ".").replace("?", ".").replace("\n", ".").split("."):
                    lower = sentence.lower()
                    if any(term in lower for term in _KIND):
                        plain = words(sentence)
                        others = filter(None, (swapped(plain, turn) for turn in range(2)))
                        out += [(None, ids(plain), ids(other)) for other in others]
            y, x, cf = zip(*out) if out else ((), (), ())
            lists = (pa.array(c, pa.list_(pa.int32())) for c in (x, cf))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), *lists], ["y", "x", "cf"])

    made = written(sample.mapInArrow(featured, "y int, x array<int>, cf array<int>"), "toxicity-features")
    some = made.where("y IS NULL AND x != cf").orderBy(F.xxhash64("x", "cf")).limit(sample_pairs).collect()
    got = made.where("y IS NOT NULL").collect()
    forget(sample)
    forget(made)
    labels_ = np.array([r["y"] for r in got])
    weights, bias = fit([r["x"] for r in got], labels_, [(r["x"], r["cf"]) for r in some], len(index))
    return Model(index, weights, bias, len(set(labels_.tolist())) == 2)


def scored(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df and the score of its text (0 to 1; null and empty texts have the score of no words). Rows and columns stay,
    whatever their names; if df has a column named as out, in any case, the score's name gets a number behind it."""
    place, (name,) = df.columns.index(text), fresh(df, out)

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept("toxicity")  # nothing of the stage before
        score = model.scorer()
        for b in batches:
            got = pa.array([score(t.as_py()) for t in b.column(place)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, name])

    return mapped(df, run, StructField(name, DoubleType()))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score below the threshold, with all their columns, whatever their names; a model that has not
    seen both labels rejects none. Nulls, empty texts and repeated rows are scored like any other."""
    if not model.informed:
        return docs
    place = docs.columns.index(text)

    def run(batches) -> Iterator[pa.RecordBatch]:
        kept("toxicity")  # nothing of the stage before
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t.as_py()) < threshold for t in b.column(place)], pa.bool_()))

    return mapped(docs, run)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows no label is learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted. Labels are learned from rows that aren't held out.

    A null doc_id isn't held out and has no label; repeated rows are scored alike; an empty table gives no rows.
    """
    model = train(docs, labels, ~held_out())
    rows = docs.select(F.col("doc_id"), held_out().alias("held_out"), F.col("text"))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored(rows, model).select("doc_id", "held_out", "score", predicted)
