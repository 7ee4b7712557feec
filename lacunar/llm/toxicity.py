"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade > k) is the logistic function of w.x - t_k, with the weights w shared across the ordered
thresholds t_0 < t_1; the expected severity is the sum of these probabilities. Labels say whether a
text is toxic. Grade 0 is not toxic; toxic rows are grade 2 if they hold more distinct words that lean
to toxic rows than the median toxic row does, else grade 1. The weights are fitted by proximal
gradient steps with an L1 penalty, so words without evidence get exactly none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacunar.llm._labels import labelled_sample, remainder
from lacunar.llm._text import lean, slices, word_hashes

#: At most so many labelled rows are learned from.
SAMPLE_ROWS = 12_288
BUCKETS = 1 << 18
LEAST_DOCS = 4
#: This and LEAST_P gave the best F1 in three folds of sf0.1's labelled rows that aren't held out.
PENALTY = 3e-4
STEPS = 600
GRADES = 3
LEANING = 2.0
#: A text counts as toxic from this probability of a grade over 0.
LEAST_P = 0.2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, distinct word buckets, their rows, number of rows) for runs of rows; punctuation parts words."""
    for i, data, at in slices(texts):
        h, rows = word_hashes(data, at, letters=True)
        code = np.unique(rows * BUCKETS + (h >> np.uint64(20)).astype(np.int64) % BUCKETS)
        yield i, code % BUCKETS, code // BUCKETS, len(at) - 1


class Model:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights.astype(np.float32), cuts

    def above(self, words: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) of each row for each k."""
        s = np.bincount(rows, weights=self.weights[words], minlength=n)
        return sigmoid(s[:, None] - self.cuts[None, :])


def grades(words: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    n, t = len(toxic), int(toxic.sum())
    in_toxic = np.bincount(words, weights=toxic[rows], minlength=BUCKETS)
    in_all = np.bincount(words, minlength=BUCKETS)
    lean = np.log((in_toxic + 0.5) / (t + 1)) - np.log((in_all - in_toxic + 0.5) / (n - t + 1))
    leaning = (lean > LEANING) & (in_toxic >= LEAST_DOCS)
    held = np.bincount(rows, weights=leaning[words], minlength=n)
    middle = np.median(held[toxic]) if toxic.any() else 0
    return np.where(toxic, 1 + (held > middle), 0).astype(np.int64)


def loss_and_gradient(w: np.ndarray, cuts: np.ndarray, words: np.ndarray, rows: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of the grades y, and its gradients by the weights and the thresholds."""
    n = len(y)
    s = np.bincount(rows, weights=w[words], minlength=n)
    up = sigmoid(s[:, None] - cuts[None, :])  # P(y > k)
    full = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], 1)
    a, b = full[np.arange(n), y], full[np.arange(n), y + 1]  # P(y > y-1), P(y > y)
    p = np.maximum(a - b, 1e-9)
    ga, gb = a * (1 - a) / p, b * (1 - b) / p
    gs = -(ga - gb) / n
    gc = np.array([((y == k + 1) * ga - (y == k) * gb).sum() for k in range(len(cuts))]) / n
    return float(-np.log(p).mean()), np.bincount(words, weights=gs[rows], minlength=len(w)), gc


def fit_arrays(words: np.ndarray, rows: np.ndarray, toxic: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> Model:
    n = len(toxic)
    y = grades(words, rows, toxic)
    share = np.array([(y > k).mean() if n else 0 for k in range(GRADES - 1)])
    cuts = -np.log((share + 1e-3) / (1 - share + 1e-3)) + np.arange(GRADES - 1) * 1e-3
    weights = np.zeros(BUCKETS)
    if not toxic.any() or toxic.all():
        return Model(weights, cuts)
    common = np.bincount(words, minlength=BUCKETS)
    use = common[words] >= LEAST_DOCS
    ids, j = np.unique(words[use], return_inverse=True)
    r = rows[use]
    scale = 1 / np.sqrt(common[ids] / n)  # rarer words move as fast as common ones
    w, v = np.zeros(len(ids)), np.zeros(len(ids))
    tick = 1.0
    rate = 1.0 / max(1.0, 0.25 * float(np.bincount(r, weights=scale[j] ** 2, minlength=n).max()) / 24)
    for _ in range(steps):
        _, g, gc = loss_and_gradient(v * scale, cuts, j, r, y)
        new = v - rate * g * scale
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty * scale, 0)
        nxt = (1 + np.sqrt(1 + 4 * tick * tick)) / 2
        v, w, tick = new + (tick - 1) / nxt * (new - w), new, nxt
        cuts = np.maximum.accumulate(cuts - 2.0 * np.clip(gc, -0.5, 0.5)) + np.arange(GRADES - 1) * 1e-9
    weights[ids] = w * scale
    return Model(weights, cuts)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Learns from at most `most` labelled rows, by their distinct words."""

    @lean
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, words, rows, n in words_of(b.column(0)):
                cut = np.searchsorted(rows, np.arange(n + 1))
                values = [words[x:z].astype("<i4").tobytes() for x, z in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, n), b.column(2).slice(i, n), pa.array(values, pa.binary())], ["doc_id", "y", "words"])

    sample = labelled_sample(docs, labels, "toxic", most).select("text", F.col("doc_id").cast("long"), "y")
    got = sorted(sample.mapInArrow(sparse, "doc_id long, y double, words binary").collect(), key=lambda r: (r["doc_id"], r["words"]))
    each = [np.frombuffer(r["words"], "<i4") for r in got]
    words = np.concatenate([np.zeros(0, np.int64), *each]).astype(np.int64)
    rows = np.repeat(np.arange(len(each)), [len(x) for x in each]).astype(np.int64)
    return fit_arrays(words, rows, np.array([r["y"] >= 0.5 for r in got], bool))


def grade(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, severity (expected grade), p_toxic, grade (likeliest), toxic (0 or 1) of every document.

    Whole texts count; a null or empty text has no words and gets the thresholds' own probabilities. Without
    toxic rows among the labels nothing is toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))

    @lean
    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, words, rows, n in words_of(b.column(1)):
                up = shared.value.above(words, rows, n)
                each = -np.diff(np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], 1), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), pa.array(up.sum(1)), pa.array(up[:, 0]), pa.array(each.argmax(1).astype(np.int32)), pa.array((up[:, 0] >= LEAST_P).astype(np.int32))], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(graded, "doc_id long, severity double, p_toxic double, grade int, toxic int")
    return out.select("doc_id", (remainder() == 0).alias("held_out"), "severity", "p_toxic", "grade", "toxic")
