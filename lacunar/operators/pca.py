"""Principal-component imputation of one matrix.

A matrix of up to ONE_TASK cells is one task's work. A larger one, which has few samples and many
features, is worked on by feature: what a round needs of all features is the sum of their samples x
samples products, which the driver decomposes; each feature then gets its next values from the left
vectors alone. A round's state is stored, so no lineage grows and lost executors cost one round.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacunar.functions.stats import check_finite, misses, stop_on_inf
from lacunar.operators.kernels import EPS, SMALL_SD, shrunk, signed
from lacunar.operators.mean import filled
from lacunar.operators.partitioned import _run
from lacunar.operators.result import ImputeResult, InfeasibleError
from lacunar.plans.params import dumped, resolve
from lacunar.sources.matrix import Matrix, dense, lists
from lacunar.sources.store import discard, fresh_path, stored

ONE_TASK = 1 << 23
STATE = "col_idx int, vals array<double>, z array<double>, mu double, sd double"
PARTS = "gram array<double>, missed double, observed double, cells long"


def pca_impute(m: Matrix, ncp: int = 2, **parameters) -> ImputeResult:
    """Missing values by iterated regularised or EM principal components."""
    name, p = resolve({"ncp": ncp, **parameters})
    columns = m.vectors.count()
    if ncp > columns - 1:
        raise ValueError("ncp must be below the number of columns")
    check_finite(m)
    stop_on_inf(m)
    if m.vectors.where(misses() > 0).isEmpty():
        return ImputeResult(m.vectors, "none")
    if columns * m.n > ONE_TASK and columns > m.n:
        made, report = by_feature(m, **p)
    else:
        made = _run(m.vectors.select(F.lit("all").alias("part"), "col_idx", F.lit(True).alias("is_target"), F.lit(dumped(name, p)).alias("parameters"), "vals"), "error")
        report = {k: v for k, v in made.select(F.from_json("report", "n_iter int, converged boolean, solver string").alias("r")).first()["r"].asDict().items()}
        if not report["converged"]:
            warnings.warn(f"no convergence within {p['maxiter']} rounds", stacklevel=2)
    out = m.vectors.join(made.select("col_idx", "new"), "col_idx", "left").withColumn("vals", F.coalesce("new", "vals")).select(*m.vectors.columns)
    return ImputeResult(out, "pca", p["post_imp"], report)


def standardised(full: np.ndarray, w: np.ndarray, scale: bool, gone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (features) centred and scaled by their weighted mean and deviation over what isn't gone; these two."""
    each = np.broadcast_to(w, full.shape) if gone is None else w * ~gone
    total = each.sum(1)
    mu = np.nansum(each * full, axis=1) / total
    sd = np.maximum(np.sqrt(np.nansum(each * (full - mu[:, None]) ** 2, axis=1) / total), SMALL_SD) if scale else np.ones(len(full))
    return (full - mu[:, None]) / sd[:, None], mu, sd


def by_feature(m: Matrix, ncp: int, scale: bool, method: str, coeff_ridge: float, row_w, threshold: float, seed, nb_init: int, maxiter: int, miniter: int, colmax: float, post_imp: bool, clamp, solver: str, eigen) -> tuple[DataFrame, dict]:
    """(col_idx, new) of all features and a report; what kernels.pca gives, a round being one job over the features."""
    spark, n = m.vectors.sparkSession, m.n
    usable = (misses() / F.lit(n) <= min(colmax, 1)) & (F.col("var") >= EPS)
    there = F.filter("vals", lambda v: v.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.size(there)
    spread = F.when(F.size(there) > 1, F.aggregate(there, F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / (F.size(there) - 1))
    marked = m.vectors.withColumn("m", mean).withColumn("var", spread).withColumn("ok", F.coalesce(usable, F.lit(False))).select("col_idx", "vals", "ok")
    p, incomplete = marked.where("ok").agg(F.count("*"), F.count_if(misses() > 0)).first()
    if min(n - 2, p - 1) < max(1, ncp) or not incomplete:
        raise InfeasibleError("too few eligible columns or rows for ncp, or none with missing values")
    if isinstance(row_w, str):
        missing = np.zeros(n)
        for r in m.vectors.select(F.posexplode("vals").alias("p", "v")).groupBy("p").agg(F.avg(F.col("v").isNull().cast("double")).alias("s")).collect():  # one row a sample
            missing[r["p"]] = r["s"]
        w = np.maximum(1 - missing, 1e-10)
    else:
        w = np.ones(n) if row_w is None else np.asarray(row_w, float)
        if len(w) != n:
            raise ValueError("row_w must have one weight a row")
    w = w / w.sum()
    root = np.sqrt(w)
    eligible = marked.where("ok").select("col_idx", "vals")

    def started(start: int):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = dense(b.column(1))
                gone = np.isnan(x)
                z, mu, sd = standardised(x, w, scale, gone)
                if start == 1:
                    z[gone] = 0
                else:
                    for i, c in enumerate(b.column(0).to_pylist()):
                        draws = np.random.default_rng([abs(seed or 0) * (start - 1), start, c]).standard_normal(n)
                        z[i, gone[i]] = draws[gone[i]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(z), pa.array(mu), pa.array(sd)], ["col_idx", "vals", "z", "mu", "sd"])

        return make

    def fitted(z: np.ndarray, left: np.ndarray) -> np.ndarray:
        # the fit is U diag(lam / s) U' W z of each feature, with U un-weighted on the left
        return z @ left

    def moved(left):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, z = dense(b.column(1)), dense(b.column(2))
                mu, sd = (b.column(i).to_numpy()[:, None] for i in (3, 4))
                gone = np.isnan(x)
                new, mu, sd = standardised(np.where(gone, fitted(z, left.value), z) * sd + mu, w, scale)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(new), pa.array(mu), pa.array(sd)], ["col_idx", "vals", "z", "mu", "sd"])

        return make

    def summed(left):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gram, missed, observed, cells = np.zeros((n, n)), 0.0, 0.0, 0
            for b in batches:
                x, z = dense(b.column(1)), dense(b.column(2))
                gone = np.isnan(x)
                if left is None:
                    a = z * root
                    gram += a.T @ a
                else:
                    rest = z - fitted(z, left.value)
                    missed += float((w * rest**2)[gone].sum())
                    observed += float(((rest * b.column(4).to_numpy()[:, None]) ** 2)[~gone].sum())
                    cells += int((~gone).sum())
            yield pa.RecordBatch.from_arrays([pa.array([gram.ravel()], pa.list_(pa.float64())), pa.array([missed]), pa.array([observed]), pa.array([cells])], ["gram", "missed", "observed", "cells"])

        return make

    def total(state: DataFrame, left=None):
        """Sums over all features: one row a partition reaches the driver, of samples x samples values."""
        t = state.mapInArrow(summed(left), PARTS).toArrow()
        return dense(t.column("gram")).sum(0).reshape(n, n), *(float(np.sum(t.column(c).to_numpy())) for c in ("missed", "observed", "cells"))

    best = None
    for start in range(1, nb_init + 1):
        path = fresh_path(spark, "state")
        state = stored(eligible.mapInArrow(started(start), STATE), "state", path)
        old, done, crit, it = np.inf, False, np.inf, 0
        for it in range(1, maxiter + 1):
            if it > 1:
                nxt = fresh_path(spark, "state")
                state = stored(state.mapInArrow(moved(shared), STATE), "state", nxt)
                discard(spark, path)
                path = nxt
            gram = total(state)[0]
            values, vectors = np.linalg.eigh(gram)
            k = min(ncp + 1 if method == "regularized" else ncp, n)
            s, vectors = np.sqrt(np.maximum(values[::-1][:k], 0)), signed(vectors[:, ::-1][:, :k])
            lam, tail, main = shrunk(s, float(np.trace(gram)), n, p, ncp, method, coeff_ridge)
            ratio = np.where(main > SMALL_SD, lam / np.maximum(main, SMALL_SD), 0.0)
            u = vectors[:, :ncp]
            shared = spark.sparkContext.broadcast((root[:, None] * u * ratio) @ (u / root[:, None]).T)
            _, missed, observed, cells = total(state, shared)
            objective = max(0.0, tail + ((main - lam) ** 2).sum() - missed)
            crit = abs(1 - objective / old) if old > 0 else 0.0
            old = objective
            if it >= miniter and (crit < threshold or objective < threshold):
                done = True
                break
        error = observed / cells
        if best is None or error < best[0]:
            best = (error, state, {"n_iter": it, "converged": done, "solver": "exact"})
    _, state, report = best
    if not report["converged"]:
        warnings.warn(f"no convergence within {maxiter} rounds", stacklevel=3)
    value = F.transform("z", lambda z: z * F.col("sd") + F.col("mu"))
    if clamp is not None:
        value = F.transform(value, lambda v: F.least(F.greatest(v, F.lit(float(clamp[0]))), F.lit(float(clamp[1]))))
    new = state.select("col_idx", F.zip_with("vals", value, lambda a, b: F.coalesce(a, b)).alias("_new"))
    out = marked.join(new, "col_idx", "left").withColumn("new", F.coalesce("_new", "vals"))
    return out.select("col_idx", (filled(F.col("new")) if post_imp else F.col("new")).alias("new")), report
