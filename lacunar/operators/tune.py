"""Masked-cell cross-validation: where to mask, the grid of runs, and error metrics."""

from __future__ import annotations

import inspect
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacunar.functions.stats import INF, misses
from lacunar.operators.knn import knn_impute
from lacunar.operators.mean import subset_filter
from lacunar.operators.partitioned import slide_impute
from lacunar.operators.pca import pca_impute
from lacunar.plans.params import KNN, PCA, WINDOWS
from lacunar.sources.matrix import Matrix, dense, lists
from lacunar.sources.store import stored

#: The function, its parameters, and of which ones at least one must be given.
METHODS: dict[str, tuple[Callable, set, list]] = {
    "knn_imp": (knn_impute, set(KNN), [("k",)]),
    "pca_imp": (pca_impute, set(PCA), [("ncp",)]),
    "slide_imp": (slide_impute, set(KNN) | set(PCA) | set(WINDOWS), [("window_size",), ("k", "ncp")]),
}
LOCATIONS = "rep_id int, ord int, row_idx int, col_idx int"


def per_column(num_na: int, n_rows: int) -> list[int]:
    """How many cells each column loses: num_na spread evenly over num_na // n_rows columns, ascending."""
    columns = max(1, num_na // n_rows)
    base, more = divmod(num_na, columns)
    return [base] * (columns - more) + [base + 1] * more


def sample_cells(x: np.ndarray, needed: list[int], rng: np.random.Generator, row_room: np.ndarray, colmax: float = 0.9, attempts: int = 100) -> list[tuple[int, int]] | None:
    """Zero-based cells to mask, or None: per column, observed ones, so that no row or column loses too much and two distinct values stay."""
    n, p = x.shape
    gone = np.isnan(x)
    col_room = min(np.floor(n * colmax), n - 2) - gone.sum(0)
    for _ in range(attempts):
        room, out = row_room.copy(), []
        columns = list(rng.permutation(p))
        for need in sorted(needed, reverse=True):
            rows = None
            while columns and rows is None:
                j = columns.pop()
                if col_room[j] < need:
                    continue
                seen = np.flatnonzero(~gone[:, j])
                first = rng.choice(seen)
                second = rng.choice(seen[x[seen, j] != x[first, j]])
                free = seen[(seen != first) & (seen != second) & (room[seen] > 0)]
                if len(free) >= need:
                    rows = rng.choice(free, need, replace=False)
            if rows is None:
                break
            room[rows] -= 1
            out += [(int(i), int(j)) for i in rows]
        else:
            return out
    return None


def sample_na_loc(m: Matrix, n_cols: int | None = None, n_rows: int = 2, num_na: int | None = None, n_reps: int = 1, rowmax: float = 0.9, colmax: float = 0.9, subset: list[str] | None = None, max_attempts: int = 100, seed: int = 0) -> DataFrame:
    """rep_id, ord, row_idx, col_idx (from 1) of cells to mask; one task per repetition.

    A repetition's task gets a few times the columns that it needs, the first ones of a hash order of its own, and
    more only if these don't do; the driver holds one count a sample.
    """
    n, p = m.n, m.vectors.count()
    if num_na is None and n_cols is None:
        num_na = min(500, max(n_rows, round(0.05 * n * p)))
    needed = per_column(num_na, n_rows) if num_na is not None else [n_rows] * n_cols
    gone, several = misses(), F.size(F.array_distinct(F.array_compact("vals"))) > 1
    bad = m.vectors.agg(F.count_if(gone > int(np.floor(n * colmax))), F.count_if(~several)).first()
    in_row = np.zeros(n)
    for r in m.vectors.select(F.posexplode("vals").alias("p", "v")).where("v is null").groupBy("p").count().collect():  # one row a sample
        in_row[r["p"]] = r["count"]
    if bad[0] or (in_row > np.floor(p * rowmax)).any():
        raise ValueError("a row or column already misses more than rowmax or colmax allow")
    if bad[1]:
        raise ValueError("a column has no variance")
    room = np.floor(p * rowmax) - in_row
    pool = m.vectors if subset is None else m.vectors.join(subset_filter(m, subset), "col_idx", "left_semi")
    pool = pool.where(gone <= min(int(np.floor(n * colmax)), n - 2) - min(needed)).select("col_idx", "vals", F.explode(F.sequence(F.lit(1), F.lit(n_reps))).alias("rep_id"))
    ranked = pool.withColumn("_r", F.row_number().over(Window.partitionBy("rep_id").orderBy(F.xxhash64(F.lit(seed), "rep_id", "col_idx"), "col_idx")))

    def sampled(t: pa.Table) -> pa.Table:
        rep = t.column("rep_id")[0].as_py()
        cells = sample_cells(dense(t.column("vals")).T, needed, np.random.default_rng([seed, rep]), room, colmax, max_attempts)
        ids = t.column("col_idx").to_numpy()
        rows = np.array([(rep, o, i + 1, ids[j]) for o, (i, j) in enumerate(sorted(cells or [], key=lambda c: (ids[c[1]], c[0])), 1)], np.int32).reshape(-1, 4)
        return pa.table([pa.array(c) for c in rows.T], ["rep_id", "ord", "row_idx", "col_idx"])

    most = 4 * len(needed) + 16
    while True:
        cells = stored(ranked.where(F.col("_r") <= most).groupBy("rep_id").applyInArrow(sampled, LOCATIONS), "na")
        if cells.select("rep_id").distinct().count() == n_reps:
            return cells
        if most >= p:
            raise ValueError("no set of cells was found")
        most *= 4


def locations(m: Matrix, na_loc, n_cols: int) -> DataFrame:
    """Given locations (a DataFrame; or per repetition linear positions or (row, col) pairs, from 1) in one form, checked."""
    if isinstance(na_loc, DataFrame):
        outside = ~(F.col("row_idx").between(1, m.n) & F.col("col_idx").between(1, n_cols))
        reps = na_loc.groupBy("rep_id").agg(F.count("*").alias("n"), F.count_if(F.coalesce(outside, F.lit(True))).alias("bad"))
        seen = reps.agg(F.sum("bad").alias("bad"), F.min("n").alias("least"), F.max("n").alias("most")).first()
        if not seen["most"]:
            raise ValueError("no cells are given")
        if seen["bad"]:
            raise ValueError(f"{seen['bad']} cells are outside the matrix")
        if seen["least"] != seen["most"]:
            raise ValueError("repetitions differ in size")
        return na_loc
    pair = lambda c: isinstance(c, (list, tuple))
    # one repetition: positions, or tuples; several: lists of these
    several = bool(na_loc) and isinstance(na_loc[0], list)
    reps = na_loc if several else [na_loc]
    rows = []
    for rep, cells in enumerate(reps, 1):
        for o, c in enumerate(cells, 1):
            i, j = c if pair(c) else ((c - 1) % m.n + 1, (c - 1) // m.n + 1)
            if not (1 <= i <= m.n and 1 <= j <= n_cols):
                raise ValueError(f"cell {c} is outside the matrix")
            rows.append((rep, o, i, j))
    if len({len(c) for c in reps}) > 1:
        raise ValueError("repetitions differ in size")
    return m.vectors.sparkSession.createDataFrame(rows, LOCATIONS)


def masked(m: Matrix, cells: DataFrame) -> Matrix:
    """The matrix without the cells (row_idx, col_idx)."""
    gone = cells.groupBy("col_idx").agg(F.collect_set("row_idx").alias("_gone"))
    rest = [c for c in m.vectors.columns if c != "vals"]

    def emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, at = dense(b.column(len(rest))), b.column(len(rest) + 1)
                x[np.repeat(np.arange(len(x)), at.fill_null([]).value_lengths().to_numpy()), at.flatten().to_numpy() - 1] = np.nan
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], lists(x)], [*rest, "vals"])

    both = m.vectors.join(gone, "col_idx", "left").select(*rest, "vals", "_gone")
    return m.with_vectors(both.mapInArrow(emptied, both.drop("_gone").schema).select(*m.vectors.columns))


def at_cells(m: Matrix, vectors: DataFrame, cells: DataFrame) -> DataFrame:
    """ord, truth, estimate at the cells. A column's cells meet its vectors in one row."""
    asked = cells.groupBy("col_idx").agg(F.collect_list(F.struct("ord", "row_idx")).alias("_cells"))
    both = asked.join(m.vectors.select("col_idx", F.col("vals").alias("t")), "col_idx").join(vectors.select("col_idx", F.col("vals").alias("e")), "col_idx")
    found = F.transform("_cells", lambda c: F.struct(c["ord"].alias("ord"), F.try_element_at("t", c["row_idx"]).alias("truth"), F.try_element_at("e", c["row_idx"]).alias("estimate")))
    return both.select(F.inline(found))


def _column(values: list) -> tuple[str, list]:
    """A column type for the values that one parameter takes, and the values in it; what has no type of its own becomes JSON."""
    there = [v for v in values if v is not None]
    if all(isinstance(v, bool) for v in there):
        return "boolean", values
    if all(isinstance(v, int) and not isinstance(v, bool) for v in there):
        return "long", values
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in there):
        return "double", [v if v is None else float(v) for v in values]
    if all(isinstance(v, str) for v in there):
        return "string", values
    if all(isinstance(v, (list, tuple)) and all(isinstance(x, (int, float)) for x in v) for v in there):
        return "array<double>", [v if v is None else [float(x) for x in v] for v in values]
    return "string", [v if v is None else json.dumps(v, default=str, sort_keys=True) for v in values]


def probed(m: Matrix, method: Callable, p: dict) -> None:
    """Raises if a custom function can't take the parameters, or gives another shape or infinite values."""
    try:
        inspect.signature(method).bind(m, **p)
    except TypeError as e:
        raise ValueError(f"the function can't be called with {sorted(p)}: {e}") from e
    made = method(m, **p)
    if not isinstance(made, Matrix) or made.samples != m.samples:
        raise ValueError("the function must give a Matrix of the same samples")
    length = F.size("vals") != m.n
    odd = made.vectors.agg(F.count("*").alias("n"), F.count_if(length).alias("short"), F.count_if(F.exists("vals", lambda v: F.abs(v) == INF)).alias("inf")).first()
    if odd["n"] != m.vectors.count() or odd["short"] or not made.vectors.join(m.vectors, "col_idx", "left_anti").isEmpty():
        raise ValueError("the function must give the same features")
    if odd["inf"]:
        raise ValueError("the function gives infinite values")


def tune(m: Matrix, parameters: list[dict], method: str | Callable, na_loc=None, **sampling) -> DataFrame:
    """One row for each distinct parameter set and repetition: the parameters, param_set, rep_id, result, error.

    method: a name of METHODS, or a function of a Matrix and parameters that gives a Matrix, which is tried once
    first. A run's error is kept and leaves its result empty. For the named neighbour methods only columns with
    masked cells are completed. Parameters may be lists.
    """
    spark = m.vectors.sparkSession
    cells = locations(m, na_loc, m.vectors.count()) if na_loc is not None else sample_na_loc(m, **sampling)
    cells = stored(cells.select("rep_id", "ord", "row_idx", "col_idx"), "cells")
    reps = sorted(r["rep_id"] for r in cells.select("rep_id").distinct().collect())
    sets = list({json.dumps(p, sort_keys=True, default=str): p for p in parameters or [{}]}.values())
    names = list(dict.fromkeys(k for p in sets for k in p))
    if clash := {"param_set", "rep_id", "result", "error"} & set(names):
        raise ValueError(f"parameters can't be named {sorted(clash)}")
    if isinstance(method, str):
        function, allowed, required = METHODS[method]
        for p in sets:
            if unknown := set(p) - allowed:
                raise ValueError(f"unknown parameters: {sorted(unknown)}")
            if "subset" in p:
                raise ValueError("subset follows from the masked cells")
            if lacking := [r for r in required if not any(p.get(k) is not None for k in r)]:
                raise ValueError(f"lacking parameters: {lacking}")
    else:
        probed(masked(m, cells.where(F.col("rep_id") == reps[0])), method, sets[0])
    typed = {k: _column([p.get(k) for p in sets]) for k in names}
    schema = ", ".join([f"`{k}` {t}" for k, (t, _) in typed.items()] + ["param_set int, rep_id int, error string"])
    out = None
    for rep, (i, p) in itertools.product(reps, enumerate(sets, 1)):
        mine = cells.where(F.col("rep_id") == rep)
        hidden = masked(m, mine)
        said, pairs = None, None
        try:
            if isinstance(method, str):
                extra = {"subset": sorted(r[0] for r in mine.select("col_idx").distinct().collect())} if "subset" in inspect.signature(function).parameters else {}
                vectors = function(hidden, **p, **extra).df
            else:
                vectors = method(hidden, **p).vectors
            each = F.struct("ord", "truth", "estimate")
            pairs = stored(at_cells(m, vectors, mine).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: F.struct(x["truth"].alias("truth"), x["estimate"].alias("estimate"))).alias("result")), "run")
        except Exception as e:  # noqa: BLE001  each run's failure is part of the result
            said = str(e)[:500]
        row = spark.createDataFrame([(*(v[i - 1] for _, v in typed.values()), i, rep, said)], schema)
        kind = "array<struct<truth:double,estimate:double>>"
        row = row.withColumn("result", F.array().cast(kind)) if pairs is None else row.crossJoin(pairs.select(F.col("result").cast(kind)))  # one row each
        row = row.select(*[F.col(f"`{k}`") for k in names], "param_set", "rep_id", "result", "error")
        out = row if out is None else out.unionByName(row)
    return out


def _whole(t: Column, e: Column) -> Column:
    return t.isNotNull() & e.isNotNull()


def _metric(name: str) -> Column:
    t, e = F.col("truth"), F.col("estimate")
    both, n = _whole(t, e), F.count(F.when(_whole(t, e), 1))
    if name == "mae":
        return F.avg(F.abs(t - e))
    if name == "rmse":
        return F.sqrt(F.avg((t - e) * (t - e)))
    if name == "bias":
        return F.avg(e - t)
    if name == "mape":
        each = F.when(t != 0, F.abs((t - e) / F.when(t != 0, t))).when(both & (e != 0), F.lit(float("inf")))
        return 100 * F.avg(each)
    tt, ee = F.when(both, t), F.when(both, e)
    if name == "rsq":
        return F.when(n >= 2, F.pow(F.corr(tt, ee), 2))
    if name == "rsq_trad":
        total = F.var_pop(tt) * n
        return F.when((n >= 2) & (total >= 2.220446049250313e-16), 1 - F.sum((tt - ee) * (tt - ee)) / F.when(total > 0, total))
    raise ValueError(f"unknown metric {name}")


METRICS = ("mae", "rmse", "bias", "mape", "rsq", "rsq_trad")


def compute_metrics(pairs: DataFrame, metrics: tuple[str, ...] = ("mae", "rmse"), keys: tuple[str, ...] = ("param_set", "rep_id")) -> DataFrame:
    """keys, n, n_miss, metric, estimator, estimate; from (keys, truth, estimate) rows or tune()'s result."""
    if "result" in pairs.columns:
        pairs = pairs.select(*keys, F.inline("result"))
    wide = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(~_whole(F.col("truth"), F.col("estimate")), 1)).alias("n_miss"), *[_metric(m).alias(m) for m in metrics])
    return wide.unpivot([*keys, "n", "n_miss"], list(metrics), "metric", "estimate").withColumn("estimator", F.lit("standard"))
