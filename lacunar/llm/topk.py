"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Rows and queries are dealt to blocks; each pair of blocks is one task, whose index holds for each
dimension the block's rows in segments of like value. For a query all segments are processed by
descending impact. A row's score so far is a lower bound, and the next segments' impacts bound what
is still to come from above; processing stops only when few enough rows can still be among the k
best, and those are scored exactly. Local results meet by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BLOCK = 8192
QUERIES_A_BLOCK = 16_384
LEVELS = 32
#: Sums of products below this are exact in floating point.
EXACT = 2.0**53
ROUNDS = 8

SCORED = "query_id long, which long, vec_id long, score long"


class ImpactIndex:
    """Segments of one block of integer vectors, whose numbers are held as floating point."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.v, self.levels = ids, vectors, levels
        n, d = vectors.shape
        self.low, self.high = vectors.min(0), vectors.max(0)
        self.largest = float(np.abs(vectors).max()) if vectors.size else 0.0
        width = np.maximum(1, np.ceil((self.high - self.low + 1) / levels))
        level = np.clip((vectors - self.low) // width, 0, levels - 1).astype(np.int64)
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        self.at = np.stack([np.searchsorted(np.sort(level[:, j]), np.arange(levels + 1)) for j in range(d)])
        edges = self.low[:, None] + width[:, None] * np.arange(levels + 1)
        self.floor, self.top = edges[:, :-1], np.minimum(edges[:, 1:] - 1, self.high[:, None])

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and exact scores of the k best rows whose id isn't own, ties to the smaller id."""
        n, d = self.v.shape
        if self.largest * float(np.abs(query).max(initial=0)) * max(1, d) >= EXACT:  # bounds would be rounded: no row is ruled out
            return self._best(np.flatnonzero(self.ids != own), query, k)
        up = query > 0
        mag = np.abs(query).astype(np.float64)
        # contributions are counted from the dimension's worst value in the block, so none is negative
        least = np.where(up[:, None], self.floor - self.low[:, None], self.high[:, None] - self.top) * mag[:, None]
        most = np.where(up[:, None], self.top - self.low[:, None], self.high[:, None] - self.floor) * mag[:, None]
        least, most = np.maximum(least, 0), np.maximum(most, 0)
        sizes = np.diff(self.at, axis=1)
        dims, levels = np.nonzero((sizes > 0) & (mag[:, None] > 0))
        by = np.argsort(-most[dims, levels], kind="stable")
        dims, levels = dims[by], levels[by]
        done = np.zeros(n)
        own_row = self.ids == own
        others = n - int(own_row.sum())
        k = min(k, others)
        if not k:
            return np.zeros(0, np.int64), np.zeros(0)
        slack = np.zeros(d)
        possible = np.flatnonzero(~own_row)
        cuts = np.linspace(0, len(dims), ROUNDS + 1).astype(int)
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                s_d, s_l = dims[a:b], levels[a:b]
                rows = np.concatenate([self.order[i, self.at[i, j] : self.at[i, j + 1]] for i, j in zip(s_d, s_l)])
                done += np.bincount(rows, weights=np.repeat(least[s_d, s_l], sizes[s_d, s_l]), minlength=n)
                np.maximum.at(slack, s_d, (most - least)[s_d, s_l])
            to_come = np.zeros(d)
            np.maximum.at(to_come, dims[b:], most[dims[b:], levels[b:]])
            # a row's dimension is either processed, with its segment's slack, or still to come
            rest = np.maximum(slack, to_come).sum()
            lower = np.where(own_row, -1.0, done)
            threshold = np.partition(lower, n - k)[n - k]
            possible = np.flatnonzero(lower + rest >= threshold - 0.5)
            possible = possible[~own_row[possible]]
            if len(possible) <= max(4 * k, n // 32):
                break
        return self._best(possible, query, k)

    def _best(self, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        score = exact_scores(self.v[rows], query)
        best = np.lexsort((self.ids[rows], ~score))[:k]  # ~x is -x - 1, without overflow
        return rows[best], score[best]


def exact_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; one that a long can't hold is the nearest long."""
    if not v.size:
        return np.zeros(len(v), np.int64)
    if float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < EXACT:
        return (v @ q).astype(np.int64)
    whole = [[int(x) for x in row] for row in v]
    mine = [int(x) for x in q]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(row, mine)))) for row in whole], np.int64)


def integer_vectors(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """id, vector of floor(scale * x), whole numbers of any size held as doubles.

    Vectors or ids that are null are left out, and so are vectors without components or with one that is null or not
    finite, or that isn't finite once scaled.
    """
    x = F.col(column).cast("array<double>")
    sound = F.col(id_column).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e * scale) == float("inf")))
    # doubles from 2**53 on are whole already
    whole = F.transform(x, lambda e: F.when(F.abs(e * scale) < EXACT, F.floor(e * scale).cast("double")).otherwise(e * scale))
    return table.where(sound).select(F.col(id_column).cast("long").alias("id"), whole.alias("vector"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, rows_a_block: int = ROWS_A_BLOCK, queries_a_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for queries (id, vector) against rows (id, vector) but those of the query's own id.

    Ties go to the smaller id. Vectors of another length than the query's don't take part. A query without
    other rows has no result. Rows repeated with one id are each scored. Queries alike in id and vector are one; of
    queries with one id and different vectors each has its own k results. A score that a long can't hold is the nearest
    long. A block has about rows_a_block rows.
    """
    queries = queries.select("id", "vector").distinct().withColumn("which", F.xxhash64("vector"))
    n_r = max(1, -(-rows.count() // rows_a_block))
    n_q = max(1, -(-queries.count() // queries_a_block))
    left = rows.select(F.pmod(F.xxhash64("id", "vector"), F.lit(n_r)).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), "id", "vector")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_r - 1).cast("long"))).alias("rb"), F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int").alias("qb"), "id", "which", "vector")

    def matrix(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        ids = t.column("id").to_numpy()
        which = t.column("which").to_numpy() if "which" in t.column_names else ids
        flat = t.column("vector").combine_chunks()
        lengths = np.diff(flat.offsets.to_numpy())
        values, starts = flat.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
        out = {}
        for d in np.unique(lengths):
            at = np.flatnonzero(lengths == d)
            out[int(d)] = (ids[at], values[starts[at][:, None] + np.arange(d)], which[at])
        return out

    def searched(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if a.num_rows and b.num_rows:
            mine = matrix(a)
            for d, (q_ids, qs, which) in matrix(b).items():
                if d in mine:
                    index = ImpactIndex(*mine[d][:2])
                    for q_id, q, w in zip(q_ids, qs, which):
                        at, score = index.search(q, q_id, k)
                        for column, values in zip(found, ([q_id] * len(at), [w] * len(at), index.ids[at], score)):
                            column.extend(values)
        return pa.table([pa.array(x, pa.int64()) for x in found], ["query_id", "which", "vec_id", "score"])

    local = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(searched, SCORED)
    order = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
