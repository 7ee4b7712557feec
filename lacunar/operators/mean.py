"""Mean imputation of columns."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacunar.operators.result import ImputeResult
from lacunar.sources.matrix import Matrix


def filled(vals):
    """An array with its nulls replaced by the mean of the rest; without any value, as it is."""
    there = F.filter(vals, lambda v: v.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.when(F.size(there) > 0, F.size(there))
    return F.transform(vals, lambda v: F.coalesce(v, mean))


def subset_filter(m: Matrix, subset: list | None) -> DataFrame:
    """(col_idx) of the features asked for by name or position.

    Unknown names are dropped with a warning; positions out of range and repeated entries are errors.
    """
    if subset is None:
        return m.vectors.select("col_idx")
    if len(set(subset)) != len(subset):
        raise ValueError("subset has repeated entries")
    key = "feature" if subset and isinstance(subset[0], str) else "col_idx"
    wanted = m.vectors.sparkSession.createDataFrame([(s,) for s in subset], f"{key} {'string' if key == 'feature' else 'int'}")
    found = m.vectors.join(wanted, key, "left_semi").select("col_idx")
    if missing := len(subset) - found.count():
        if key == "col_idx":
            raise ValueError("subset has positions that the matrix lacks")
        warnings.warn(f"{missing} names of the subset are not in the matrix", stacklevel=3)
    return found


def mean_impute(m: Matrix, subset: list | None = None) -> ImputeResult:
    """Missing values of the subset's columns by column means; an infinite value there is an error."""
    wanted = subset_filter(m, subset).withColumn("_in", F.lit(True))
    made = m.vectors.join(wanted, "col_idx", "left")
    if not made.where(F.col("_in") & F.exists("vals", lambda v: F.abs(v) == float("inf"))).isEmpty():
        raise ValueError("infinite value in a column to complete")
    made = made.withColumn("vals", F.when(F.col("_in"), filled(F.col("vals"))).otherwise(F.col("vals"))).select(*m.vectors.columns)
    return ImputeResult(made, "mean")
