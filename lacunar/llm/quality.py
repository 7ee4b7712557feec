"""Quality by nearest-neighbour voting in a latent-semantic space.

Documents are counted as hashed byte trigrams and a few pseudo-terms for their make-up, weighted by
inverse document frequencies over the whole corpus, and projected on the leading singular vectors
of a bounded sample of labelled rows. The sample's vectors and labels are broadcast; each document's
cosines with all of them are computed exactly, a block at a time, and its nearest neighbours vote
with their similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lacunar.llm._dist import row_of
from lacunar.llm._labels import labelled_sample, remainder
from lacunar.llm._text import lean, lowered, slices, word_hashes

#: At most so many labelled rows are learned from.
SAMPLE_ROWS = 4096
HASHED = 2048
BINS = 16
RANK = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
PSEUDO_WEIGHT = 4.0
FEATURES = HASHED + 3 * BINS


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of log counts) for runs of rows; the last 3 * BINS columns are pseudo-terms."""
    for i, data, at in slices(texts, 1 << 19):
        n = len(at) - 1
        for r in range(0, n, 512):
            part = at[r : r + 513]
            yield i + r, _features(data[part[0] : part[-1]], part - part[0])


def _features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(n, dtype=np.int64), size)
    low = lowered(data).astype(np.uint32)
    x = np.zeros((n, FEATURES), np.float32)
    if len(data) >= 3:
        code = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA6B)) ^ (low[2:] * np.uint32(0xC2B2AE35))
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        inside = row[:-2] == row[2:]
        where = row[:-2] * HASHED + ((code >> np.uint32(8)) % np.uint32(HASHED)).astype(np.int64)
        counts = np.bincount(where[inside], minlength=n * HASHED)
        x[:, :HASHED] = np.log1p(counts.reshape(n, HASHED))
    h, rows = word_hashes(data, at)
    words = np.maximum(np.bincount(rows, minlength=n), 1)
    again = np.zeros(len(h), bool)
    again[1:] |= (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    again[2:] |= (h[2:] == h[:-2]) & (rows[2:] == rows[:-2])
    letters = np.bincount(row, weights=(low >= 97) & (low <= 122) | (low >= 128), minlength=n)
    blank = np.bincount(row, weights=low <= 32, minlength=n)
    for j, share in enumerate((np.bincount(rows, weights=again, minlength=n) / words, letters / np.maximum(size - blank, 1), np.minimum((size - blank) / words / 16, 1))):
        x[np.arange(n), HASHED + j * BINS + np.minimum((share * BINS).astype(np.int64), BINS - 1)] = 1
    return x


def leading(gram: np.ndarray, rank: int, rounds: int = 60) -> np.ndarray:
    """The leading eigenvectors of a Gram matrix by subspace iteration, which needs little memory besides it."""
    basis = np.random.default_rng(7).standard_normal((len(gram), rank + rank // 2)).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(gram @ basis)
    _, turn = np.linalg.eigh((basis.T @ (gram @ basis)).astype(np.float64))
    return np.ascontiguousarray(basis @ turn[:, ::-1][:, :rank].astype(np.float32))


class Model:
    """Everything that scoring needs, of a size that doesn't depend on the corpus."""

    def __init__(self, idf: np.ndarray, blocks: Callable[[], Iterator[np.ndarray]], y: np.ndarray, rank: int = RANK, k: int = NEIGHBOURS):
        """blocks gives the sample's rows from the first, a few at a time, so that they are never dense all at once."""
        self.idf, self.k, self.y = idf, k, y.astype(np.float32)
        gram = np.zeros((FEATURES, FEATURES), np.float32)
        for x in blocks():
            a = self._weighted(x)
            gram += a.T @ a
        self.basis = leading(gram, rank)
        self.known = np.concatenate([np.zeros((0, rank), np.float32), *(self._latent(self._weighted(x)) for x in blocks())])

    def _weighted(self, x: np.ndarray) -> np.ndarray:
        a = x * self.idf
        terms, made = a[:, :HASHED], a[:, HASHED:]
        terms /= np.maximum(np.sqrt(np.einsum("ij,ij->i", terms, terms)), 1e-9)[:, None]
        made *= PSEUDO_WEIGHT / max(1e-9, float(self.idf.max()) * 3)
        return a

    def _latent(self, a: np.ndarray) -> np.ndarray:
        v = a @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(x), 0.5)
        cosines = self._latent(self._weighted(x)) @ self.known.T
        k = min(self.k, len(self.y))
        best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, best, 1), 1e-6).astype(np.float64)
        return (weight * self.y[best]).sum(1) / weight.sum(1)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each feature is, over all documents; FEATURES rows reach the driver."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, n = np.zeros(FEATURES, np.int64), 0
            for _, x in features(b.column(0)):
                total += (x > 0).sum(0)
                n += len(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(FEATURES), -1)), pa.array(np.append(total, n))], ["j", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(counted, "j long, n long").groupBy("j").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(FEATURES), 0
    for r in rows:
        if r["j"] < 0:
            n = r["n"]
        else:
            out[r["j"]] = r["n"]
    return out, n


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Learns from at most `most` labelled rows; document frequencies are over all documents."""
    df, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)

    @lean
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in features(b.column(0)):
                at = [np.flatnonzero(v) for v in x]
                where, value = ([v.tobytes() for v in c] for c in ([j.astype(np.uint16) for j in at], [v[j] for v, j in zip(x, at)]))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, len(x)), b.column(2).slice(i, len(x)), pa.array(where, pa.binary()), pa.array(value, pa.binary())], ["doc_id", "y", "j", "x"])

    sample = labelled_sample(docs, labels, "quality", most).select("text", F.col("doc_id").cast("long"), "y")
    rows = sample.mapInArrow(vectors, "doc_id long, y double, j binary, x binary").toArrow()
    order = pc.sort_indices(rows, [("doc_id", "ascending"), ("j", "ascending"), ("x", "ascending")]).to_numpy()
    where, value = rows.column("j"), rows.column("x")

    def blocks() -> Iterator[np.ndarray]:
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            x = np.zeros((len(part), FEATURES), np.float32)
            for i, r in enumerate(part.tolist()):
                x[i, np.frombuffer(where[r].as_py(), np.uint16)] = np.frombuffer(value[r].as_py(), np.float32)
            yield x

    return Model(idf, blocks, rows.column("y").to_numpy()[order].astype(np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of docs, as a struct) and score from 0 to 1 of each row's whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(row_of(docs))
    schema = StructType([rows.schema["row"], StructField("score", DoubleType())])

    @lean
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            parts = [shared.value.score(x) for _, x in features(row.field("text").cast(pa.string()))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([row, pa.array(np.clip(score, 0, 1))], ["row", "score"])

    return rows.mapInArrow(scores, schema)


def classify(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null text is empty, and an empty one is scored like any other; without any labels each score is 0.5. Repeated
    rows get one score, as equal texts do; of neighbours that are equally near any may vote, the same ones at each
    rerun. An empty table gives no rows. Long texts are counted whole.
    """
    out = scored(docs.select("doc_id", "text"), fit(docs, labels, most)).select(F.col("row.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
