"""Imputation by group of features or by window, each a task of its own."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacunar.functions.stats import check_finite
from lacunar.operators import groups as grouping
from lacunar.operators import windows as windowing
from lacunar.operators.kernels import fill_means, impute
from lacunar.operators.mean import subset_filter
from lacunar.operators.result import ImputeResult, InfeasibleError
from lacunar.plans.params import capped, dumped, loaded, resolve
from lacunar.sources.matrix import Matrix, dense, lists
from lacunar.sources.store import stored

OUT = "part string, col_idx int, new array<double>, status string, report string"


def _run(members: DataFrame, on_infeasible: str, targets_first: bool = True) -> DataFrame:
    """members (part, col_idx, is_target, parameters as dumped, vals) -> part, col_idx, new, status, report of the targets.

    Columns are in order of col_idx, those to complete before the others if targets_first; equal distances
    go to the earlier one.
    """
    if on_infeasible not in ("error", "skip", "mean"):
        raise ValueError("on_infeasible must be error, skip or mean")
    order = [("is_target", "descending")] * targets_first + [("col_idx", "ascending")]

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by(order).combine_chunks()
        x = dense(t.column("vals")).T
        name, given = loaded(t.column("parameters")[0].as_py())
        wanted, status, report = np.flatnonzero(t.column("is_target").to_numpy(zero_copy_only=False)), "ok", {}
        if not len(wanted):
            return pa.table([pa.array([], k) for k in (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.string())], ["part", "col_idx", "new", "status", "report"])
        try:
            if given["k" if name == "knn" else "ncp"] > x.shape[1] - 1:
                raise InfeasibleError("too few columns")
            out, report = impute(name, x, given, wanted)
        except InfeasibleError as e:
            if on_infeasible == "error":
                raise InfeasibleError(f"{t.column('part')[0].as_py()}: {e}") from e
            status = on_infeasible
            out = fill_means(x, wanted) if on_infeasible == "mean" else x
        said = json.dumps(report, default=float) if report else None
        return pa.table([t.column("part").combine_chunks().take(pa.array(wanted)), t.column("col_idx").combine_chunks().take(pa.array(wanted)), lists(out[:, wanted].T), pa.array([status] * len(wanted)), pa.array([said] * len(wanted), pa.string())], ["part", "col_idx", "new", "status", "report"])

    return stored(members.groupBy("part").applyInArrow(one, OUT), "parts")


def group_impute(m: Matrix, group: DataFrame | str, subset: list[str] | None = None, allow_unmapped: bool = False, min_group_size: int = 0, seed: int = 0, on_infeasible: str = "error", **parameters) -> ImputeResult:
    """Each group's features by the group's own parameters, which go before those given here."""
    check_finite(m)
    table = grouping.prepare(m.vectors, group, subset, min_group_size, allow_unmapped, seed)
    rows, methods = [], set()
    # one row of parameters per group
    for r in table.select("grp", "parameters", (F.size("feature") + F.size("aux")).alias("n")).collect():
        own = json.loads(r["parameters"])
        shared = {k: v for k, v in parameters.items() if not (k in ("k", "ncp") and ({"k", "ncp"} & set(own)))}
        name, p = resolve({**shared, **own})
        methods.add(name)
        rows.append((r["grp"], dumped(name, capped(name, p, r["n"], m.n))))
    if len(methods) > 1:
        raise ValueError("all groups must use one method")
    known = m.vectors.sparkSession.createDataFrame(rows, "part string, parameters string")
    parts = table.select(F.col("grp").alias("part"), F.explode(F.concat(F.transform("feature", lambda f: F.struct(f.alias("feature"), F.lit(True).alias("is_target"))), F.transform("aux", lambda f: F.struct(f.alias("feature"), F.lit(False).alias("is_target"))))).alias("x")).select("part", "x.*")
    members = parts.join(m.vectors.select("feature", "col_idx", "vals"), "feature").join(known, "part").select("part", "col_idx", "is_target", "parameters", "vals")
    made = _run(members, on_infeasible)
    out = m.vectors.join(made.select("col_idx", "new"), "col_idx", "left").withColumn("vals", F.coalesce("new", "vals")).select(*m.vectors.columns)
    post = {loaded(r[1])[1]["post_imp"] for r in rows} != {False}
    return ImputeResult(out, methods.pop(), post, {"partitions": "groups"}, made.select("part", "status", "report").distinct(), made.select("col_idx").distinct())


def slide_windows(m: Matrix, window_size: float, overlap_size: float = 0.0, flank: bool = False, min_window_n: int | None = None, subset: list | None = None) -> DataFrame:
    """The window table that slide_impute uses."""
    if min_window_n is not None and min_window_n < 2:
        raise ValueError("min_window_n must be at least 2")
    features = m.vectors.select("col_idx", "location")
    targets = subset_filter(m, subset) if subset is not None else None
    if flank:
        if targets is None:
            raise ValueError("flank needs a subset")
        return windowing.pruned(windowing.flanking(features, targets, window_size), min_window_n, None)
    return windowing.pruned(windowing.sliding(features, window_size, overlap_size), min_window_n, targets)


def slide_impute(m: Matrix, window_size: float, overlap_size: float = 0.0, flank: bool = False, min_window_n: int | None = None, subset: list | None = None, on_infeasible: str = "skip", **parameters) -> ImputeResult:
    """Each window on its own; a feature in several gets the mean of what they give, or null if one gives null there.

    Skipped windows don't count; where no window is left the original stays.
    """
    name, p = resolve(parameters)
    key, size = ("k", p.get("k")) if name == "knn" else ("ncp", p.get("ncp"))
    if min_window_n is not None and size > min_window_n - 1:
        raise ValueError(f"{key} must be below min_window_n")
    windows = slide_windows(m, window_size, overlap_size, flank, min_window_n, subset)
    if name == "pca" and size > min(m.n, m.vectors.count()) - 1:
        raise ValueError("ncp must be below the number of rows and of columns")
    spec = F.lit(dumped(name, p))
    parts = windowing.members(windows)
    if flank:
        parts = parts.join(windows.select("window_id", "target"), "window_id").withColumn("is_target", F.col("col_idx") == F.col("target"))
    else:
        wanted = subset_filter(m, subset).withColumn("is_target", F.lit(True))
        parts = parts.join(wanted, "col_idx", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    members = parts.join(m.vectors.select("col_idx", "vals"), "col_idx").select(F.col("window_id").cast("string").alias("part"), "col_idx", "is_target", spec.alias("parameters"), "vals")
    made = _run(members, on_infeasible, targets_first=False)
    cells = made.where("status <> 'skip'").select("col_idx", F.posexplode("new").alias("p", "v"))
    mean = F.when(F.count("*") == F.count("v"), F.avg("v"))
    new = cells.groupBy("col_idx", "p").agg(mean.alias("v")).groupBy("col_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("new"))
    out = m.vectors.join(new, "col_idx", "left").withColumn("vals", F.coalesce("new", "vals")).select(*m.vectors.columns)
    return ImputeResult(out, name, p["post_imp"], {"partitions": "windows", "flank": flank}, made.select("part", "status", "report").distinct(), made.select("col_idx").distinct())
