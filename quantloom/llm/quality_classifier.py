"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text's n-grams are those of its words (1 and 2) and of its words' shapes (1 to 3), hashed. A shape
tells runs of lower case, upper case, digits and each punctuation mark apart, and a word that repeats the one
before has a shape of its own. Only whether an n-gram occurs counts. Indicators are scaled by the
log-count ratios of the two classes (naive Bayes), a text's vector is brought to length one, and a linear
model with hinge loss is fitted by dual coordinate descent, rarer classes weighing more. Margins become
scores by a logistic curve, fitted on margins of texts that their model hasn't seen.

The model is fitted on a bounded sample: ``per_class`` labelled documents of each class, those with the
smallest hashes of doc_id. Their ids are broadcast (that is their bound), so no text is shuffled; their
n-grams come to the driver, at most ``BUCKETS`` numbers a document. Every text is scored whole.

Defined cases: a null or empty text has no n-grams and gets the score of a zero vector; labels
that are null or neither 0 nor 1 and ids labelled both ways aren't learned from; of texts that share a
learned doc_id one is learned from; without labels of both classes every score is 0.5; a null doc_id is
neither learned from nor held out; repeated rows get equal scores; a word longer than a slice of
``SLICE`` bytes counts as several; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import small_batches
from quantloom.llm.language_id import held_out

BITS = 18
BUCKETS = 1 << BITS
PER_CLASS = 5_000
SLICE = 1 << 20
THRESHOLD = 0.3
_U = np.uint64
_POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, _U), dtype=_U)
_REPEATED = _U(0xD1B54A32D192ED03)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CLASS = np.arange(256, dtype=np.uint8)  # a punctuation mark is its own class
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")


def _slices(data: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches of bounded length, cut at white space where there is any."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data) and len(spaces := np.flatnonzero(_SPACE[data[at:end]])):
            end = at + int(spaces[-1]) + 1
        yield data[at:end]
        at = end


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of their shapes."""
    inside = ~_SPACE[data]
    data = data[inside]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]]) - np.cumsum(~inside)[inside & ~np.r_[False, inside[:-1]]]
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, _U)
    lengths = np.diff(np.r_[starts, len(data)])
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    words = np.add.reduceat((data.astype(_U) + _U(1)) * _POWERS[place & 0xFFFF], starts)
    kinds = _CLASS[data]
    new = np.r_[True, kinds[1:] != kinds[:-1]] | (place == 0)
    nth = np.cumsum(new)
    nth -= np.repeat(nth[starts], lengths)  # of the runs in a word
    shapes = np.add.reduceat(np.where(new, (kinds.astype(_U) + _U(1)) * _POWERS[nth & 0xFFFF], _U(0)), starts)
    return words, shapes


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def ngrams(text: str | None) -> np.ndarray:
    """Sorted bucket numbers of the n-grams that occur in a text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    parts = [_words(s) for s in _slices(data)]
    if not parts:
        return np.zeros(0, np.int32)
    words, shapes = (np.concatenate(x) for x in zip(*parts))
    if len(words):
        shapes = np.where(np.r_[False, words[1:] == words[:-1]], _REPEATED, shapes)
    out = []
    for kind, (h, longest) in enumerate(((words, 2), (shapes, 3))):
        own = h
        for n in range(1, longest + 1):
            if n > 1:
                own = _mixed(own[:-1]) * _U(0x94D049BB133111EB) + h[n - 1 :]
            out.append(_mixed(own + _U(2 * n + kind)) * _U(0x9E3779B97F4A7C15) >> _U(64 - BITS))
    return np.unique(np.concatenate(out)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """A score is the logistic of slope * margin + shift; a margin is bias + weights . (ratios on the n-grams, of length one)."""

    ratios: np.ndarray
    weights: np.ndarray  # times the ratios
    bias: float
    slope: float
    shift: float

    def margin(self, grams: np.ndarray) -> float:
        length = np.sqrt(np.square(self.ratios[grams]).sum())
        return self.bias + (float(self.weights[grams].sum()) / length if length else 0.0)

    def score(self, grams: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams) + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Of each bucket the log of its share among the n-grams of class 1 over that of class 0."""
    sides = []
    for side in (good, ~good):
        own = [rows[i] for i in np.flatnonzero(side)]
        counts = smoothing + np.bincount(np.concatenate(own) if own else np.zeros(0, np.int32), minlength=BUCKETS)
        sides.append(np.log(counts / counts.sum()))
    return sides[0] - sides[1]


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], good: np.ndarray, cost: float, epochs: int, tolerance: float = 0.01, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with hinge loss; ``values`` are those of the n-grams in ``rows``.

    One dual variable a row, from 0 to its cost; visits are in random order, and end once no gradient in an epoch exceeds the tolerance.
    """
    sign = np.where(good, 1.0, -1.0)
    costs = cost * len(good) / (2 * np.where(good, good.sum(), (~good).sum()))
    weights, bias, duals = np.zeros(BUCKETS), 0.0, np.zeros(len(good))
    squares = np.array([float(v @ v) for v in values]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(good)):
            gradient = sign[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            if not (duals[i] == 0 and gradient > 0 or duals[i] == costs[i] and gradient < 0):
                worst = max(worst, abs(gradient))
                step = min(max(duals[i] - gradient / squares[i], 0.0), costs[i]) - duals[i]
                if step:
                    duals[i] += step
                    weights[rows[i]] += step * sign[i] * values[i]
                    bias += step * sign[i]
        if worst < tolerance:
            break
    return weights, bias


def _logistic(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins and classes, by Newton's method; targets are a little inside 0 and 1."""
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))])
    found = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(found @ x, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2), x @ (target - p) - 1e-6 * found)
        found = found + np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(found[0]), 1e-3), float(found[1])


def train(rows: list[np.ndarray], good: np.ndarray, cost: float = 1.0, epochs: int = 20, folds: int = 3) -> Model:
    """A model from n-grams and classes; both classes must be there."""

    def linear(own: np.ndarray) -> Model:
        some = [rows[i] for i in own]
        ratios = log_count_ratios(some, good[own])
        values = []
        for grams in some:
            length = np.sqrt(np.square(ratios[grams]).sum())
            values.append(ratios[grams] / length if length else np.zeros(len(grams)))
        weights, bias = dual_coordinate_descent(some, values, good[own], cost, epochs)
        return Model(ratios, weights * ratios, bias, 1.0, 0.0)

    fold = np.empty(len(good), np.int64)  # each class is dealt out evenly
    for side in (good, ~good):
        fold[side] = np.arange(side.sum()) % folds
    margins = np.zeros(len(good))
    if min(good.sum(), (~good).sum()) >= 2 * folds:
        for f in range(folds):
            model = linear(np.flatnonzero(fold != f))
            margins[fold == f] = [model.margin(rows[i]) for i in np.flatnonzero(fold == f)]
        whole = linear(np.arange(len(good)))
    else:
        whole = linear(np.arange(len(good)))
        margins = np.array([whole.margin(g) for g in rows])
    return Model(whole.ratios, whole.weights, whole.bias, *_logistic(margins, good))


def learned_from(labels: DataFrame, label: str, may_learn, per_class: int) -> DataFrame:
    """doc_id and good of at most ``per_class`` labelled ids of each class."""
    sure = labels.where(may_learn).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    sure = sure.agg(F.min(label).alias("good"), F.max(label).alias("_other")).where("good = _other").select("doc_id", F.col("good").cast("int").alias("good"))
    first = [sure.where(F.col("good") == c).orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(per_class) for c in (0, 1)]
    return first[0].unionByName(first[1])


def fit(docs: DataFrame, labels: DataFrame, may_learn, label: str = "quality", per_class: int = PER_CLASS) -> Model | None:
    """Learn from the texts of rows of ``labels`` (doc_id and a column of 0 and 1) for which ``may_learn`` holds; None without both classes."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [ngrams(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("good"), pa.array(grams, pa.binary())], ["doc_id", "good", "grams"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(learned_from(labels, label, may_learn, per_class)), "doc_id").select("doc_id", "good", "text")
    found = sample.mapInArrow(run, "doc_id long, good int, grams binary").groupBy("doc_id", "good").agg(F.min("grams").alias("grams")).toArrow().sort_by("doc_id")
    good = found.column("good").to_numpy().astype(bool)
    if good.all() or not good.any():
        return None
    return train([np.frombuffer(g.as_py(), np.int32) for g in found.column("grams")], good)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on) of every row."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value
            scores = [own.score(ngrams(t.as_py())) if own else 0.5 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Scores of all documents, learned from the labelled ones that aren't held out."""
    return score(docs, fit(docs, labels, ~held_out(), label))
