"""K-nearest-column imputation of a matrix with any number of columns.

Targets and candidates are dealt to blocks of columns; each pair of blocks is one task that keeps
the k best candidates of each of its targets. The k best overall meet by target, and only then are
their values joined. No task ever sees more than two blocks, and no pair of columns is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacunar.functions.stats import check_finite, misses, stop_on_inf
from lacunar.operators.kernels import combine, distances, weights
from lacunar.operators.mean import filled, subset_filter
from lacunar.operators.result import ImputeResult, InfeasibleError
from lacunar.plans.params import KNN, check
from lacunar.sources.matrix import Matrix, dense, lists
from lacunar.sources.store import stored

#: Values in a block of candidates (64 MB of them), and targets in a block at most.
BLOCK_VALUES = 1 << 23
BLOCK_TARGETS = 2048


def roles(m: Matrix, subset: list | None = None, colmax: float = 0.9) -> DataFrame:
    """Eligible columns with role 0 (complete), 1 (to complete) or 2 (missing, not asked for)."""
    share = misses() / F.lit(m.n)
    asked = F.lit(True)
    known = m.vectors
    if subset is not None:
        known = known.join(subset_filter(m, subset).withColumn("_in", F.lit(True)), "col_idx", "left")
        asked = F.col("_in").isNotNull()
    role = F.when(misses() == 0, 0).when(asked, 1).otherwise(2)
    return known.where(share < min(colmax, 1)).select("col_idx", "feature", "vals", role.alias("role"))


def neighbours(m: Matrix, k: int, subset: list | None = None, colmax: float = 0.9, method: str = "euclidean") -> DataFrame:
    """target, col_idx, dist, rank: each target's k nearest columns; ties go to complete columns, then to those to complete, then by position."""
    known = roles(m, subset, colmax)
    sizes = known.agg(F.count("*").alias("n"), F.count_if(F.col("role") == 1).alias("t")).first()
    if k > sizes["n"] - 1:
        raise InfeasibleError("too few eligible columns for k")
    if not sizes["t"]:
        raise InfeasibleError("no eligible column has missing values")
    cb = -(-sizes["n"] * m.n // BLOCK_VALUES)
    tb = -(-sizes["t"] // max(1, min(BLOCK_TARGETS, BLOCK_VALUES // max(1, m.n))))
    others = known.select(F.pmod(F.xxhash64("col_idx"), F.lit(cb)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(tb - 1))).alias("t"), "col_idx", "role", "vals")
    targets = known.where("role = 1").select(F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("c"), F.pmod(F.xxhash64("col_idx"), F.lit(tb)).cast("int").alias("t"), F.col("col_idx").alias("target"), F.col("vals").alias("target_vals"))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        if a.num_rows and b.num_rows:
            a = a.sort_by([("role", "ascending"), ("col_idx", "ascending")])
            ids, role = a.column("col_idx").to_numpy(), a.column("role").to_numpy()
            x, y = dense(a.column("vals")), dense(b.column("target_vals"))
            for t, mine in zip(b.column("target").to_pylist(), y):
                d = distances(mine, x.T, method)
                d[ids == t] = np.nan  # sorts last
                at = np.argsort(d, kind="stable")[: min(k, len(d) - int((ids == t).any()))]
                found.append(np.stack([np.full(len(at), t), ids[at], d[at], role[at]], 1))
        rows = np.concatenate(found) if found else np.zeros((0, 4))
        return pa.table([pa.array(c.astype(kind)) for c, kind in zip(rows.T, (np.int32, np.int32, float, np.int32))], ["target", "col_idx", "dist", "role"])

    best = others.groupBy("c", "t").cogroup(targets.groupBy("c", "t")).applyInArrow(nearest, "target int, col_idx int, dist double, role int")
    order = Window.partitionBy("target").orderBy("dist", "role", "col_idx")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("target", "col_idx", "dist", "rank")


def knn_impute(m: Matrix, k: int, colmax: float = 0.9, method: str = "euclidean", post_imp: bool = True, subset: list | None = None, dist_pow: float = 0.0) -> ImputeResult:
    """Missing values by the weighted mean of the nearest columns' original values; then, if asked, by column means."""
    check("knn", {**KNN, "k": k, "colmax": colmax, "method": method, "dist_pow": dist_pow})
    if k > m.vectors.count() - 1:
        raise ValueError("k must be below the number of columns")
    check_finite(m)
    stop_on_inf(m)
    wanted = subset_filter(m, subset).withColumn("_in", F.lit(True))
    if m.vectors.join(wanted, "col_idx", "left_semi").where(misses() > 0).isEmpty():
        return ImputeResult(m.vectors, "none")
    near = neighbours(m, k, subset, colmax, method)
    met = near.join(m.vectors.select("col_idx", "vals"), "col_idx").groupBy("target").agg(F.array_sort(F.collect_list(F.struct("rank", "dist", "vals"))).alias("near"))
    both = m.vectors.select("col_idx", "vals").join(met, F.col("col_idx") == F.col("target")).select("target", "vals", F.col("near.dist").alias("dist"), F.flatten("near.vals").alias("near"))
    n = m.n

    def completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                mine, d = dense(b.column(1).slice(i, 1))[0], b.column(2)[i].values.to_numpy()
                near = dense(b.column(3).slice(i, 1)).reshape(-1, n)
                gone = np.isnan(mine)
                mine[gone] = combine(near[:, gone].T, weights(d, dist_pow))
                out.append(mine)
            yield pa.RecordBatch.from_arrays([b.column(0), lists(np.stack(out) if out else np.zeros((0, n)))], ["target", "new"])

    new = both.mapInArrow(completed, "target int, new array<double>")
    out = m.vectors.join(new, F.col("col_idx") == F.col("target"), "left").withColumn("vals", F.coalesce("new", "vals"))
    if post_imp:
        out = out.join(wanted, "col_idx", "left").withColumn("vals", F.when(F.col("_in"), filled(F.col("vals"))).otherwise(F.col("vals")))
    return ImputeResult(stored(out.select(*m.vectors.columns), "completed"), "knn", post_imp)
