"""Column and row statistics of an incomplete matrix, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacunar.sources.matrix import Matrix

INF = float("inf")


def misses(vals: Column = None) -> Column:
    vals = F.col("vals") if vals is None else vals
    return F.size(F.filter(vals, lambda v: v.isNull()))


def missing_by_column(m: Matrix, prop: bool = False) -> DataFrame:
    """feature, col_idx, n_missing (or its share). Infinite values are not missing."""
    count = misses().cast("long")
    return m.vectors.select("feature", "col_idx", (count / m.n if prop else count).alias("prop_missing" if prop else "n_missing"))


def missing_by_row(m: Matrix, prop: bool = False) -> DataFrame:
    """sample, n_missing (or its share)."""
    value = F.avg(F.col("value").isNull().cast("double")) if prop else F.sum(F.col("value").isNull().cast("long"))
    by_row = m.vectors.select(F.posexplode("vals").alias("p", "value")).groupBy("p").agg(value.alias("prop_missing" if prop else "n_missing"))
    return by_row.withColumn("row_idx", F.col("p") + 1).join(m.labels(), "row_idx").drop("p", "row_idx")


def column_variances(m: Matrix) -> DataFrame:
    """feature, col_idx, variance (n - 1); null below two values, NaN with an infinite one."""
    cells = m.vectors.select("feature", "col_idx", F.explode("vals").alias("value"))
    return cells.groupBy("feature", "col_idx").agg(F.var_samp("value").alias("variance"))


def column_ranges(m: Matrix) -> DataFrame:
    return m.vectors.select("feature", "col_idx", F.array_min("vals").alias("min_value"), F.array_max("vals").alias("max_value"))


def check_finite(m: Matrix) -> None:
    """Raises if a column has no finite value."""
    none = m.vectors.where(~F.exists("vals", lambda v: v.isNotNull() & (F.abs(v) != INF))).select("feature").limit(1).collect()
    if none:
        raise ValueError(f"feature {none[0]['feature']} has no finite value")


def stop_on_inf(m: Matrix) -> None:
    """Raises at an infinite value."""
    bad = m.vectors.where(F.exists("vals", lambda v: F.abs(v) == INF)).agg(F.min(F.struct("col_idx", F.array_position(F.transform("vals", lambda v: F.abs(v) == INF), True).alias("row_idx"))).alias("x")).first()["x"]
    if bad:
        raise ValueError(f"infinite value in row {bad['row_idx']}, column {bad['col_idx']}")
