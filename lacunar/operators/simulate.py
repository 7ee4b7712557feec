"""Correlated random matrices with missing values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacunar.sources.matrix import Matrix


@dataclass
class Simulation:
    matrix: Matrix
    col_group: DataFrame
    row_group: DataFrame

    def summary(self, n: int = 6) -> str:
        """Size, share of missing values, numbers of groups, and the first features."""
        missing, p = self.matrix.vectors.agg(F.sum(F.size(F.filter("vals", lambda v: v.isNull()))), F.count("*")).first()
        groups = [t.select("grp").distinct().count() for t in (self.col_group, self.row_group)]
        head = [f"{self.matrix.n} samples, {p} features, {missing / max(1, self.matrix.n * p):.1%} missing", f"{groups[0]} groups of features, {groups[1]} of samples"]
        rows = self.matrix.vectors.orderBy("col_idx").limit(n).collect()
        return "\n".join(head + [f"{r['feature']}: {r['vals'][:n]}" for r in rows])


def simulate(spark: SparkSession, n: int = 100, p: int = 100, rho: float = 0.5, n_col_groups: int = 2, n_row_groups: int = 1, perc_total_na: float = 0.1, perc_col_na: float = 0.5, beta: bool = True, seed: int = 1) -> Simulation:
    """Compound-symmetric normal columns, scaled to 0..1 if beta; missing cells spread evenly over some of the columns."""
    columns = max(1, math.floor(perc_col_na * p))
    total = math.ceil(perc_total_na * n * p)
    if -(-total // columns) > n - 1:
        raise ValueError("too many missing cells for the columns that may have them")
    normal = lambda *c: F.sqrt(-2 * F.log((F.pmod(F.xxhash64(F.lit(seed), F.lit(1), *c), F.lit(1 << 40)) + 1) / float((1 << 40) + 1))) * F.cos(2 * math.pi * F.pmod(F.xxhash64(F.lit(seed), F.lit(2), *c), F.lit(1 << 40)) / float(1 << 40))
    common = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: normal(i, F.lit(-1)))
    made = spark.range(1, p + 1).select(F.col("id").cast("int").alias("col_idx"), common.alias("c"))
    vals = F.transform("c", lambda c, i: math.sqrt(rho) * c + math.sqrt(1 - rho) * normal(i + 1, F.col("col_idx")))
    made = made.withColumn("vals", vals).drop("c")
    if beta:
        low, high = F.array_min("vals"), F.array_max("vals")
        made = made.withColumn("l", low).withColumn("h", high).withColumn("vals", F.transform("vals", lambda v: (v - F.col("l")) / (F.col("h") - F.col("l")))).drop("l", "h")
    order = F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), F.lit(3), "col_idx"))) - 1
    base, more = divmod(total, columns)
    count = F.when(order >= columns, 0).otherwise(F.lit(base) + (order < more).cast("int"))
    made = made.withColumn("k", count)
    rows = F.transform(F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.xxhash64(F.lit(seed), F.lit(4), F.col("col_idx"), i).alias("h"), i.alias("i")))), lambda s: s["i"])
    made = made.withColumn("gone", F.slice(rows, F.lit(1), F.col("k")))
    made = made.withColumn("vals", F.transform("vals", lambda v, i: F.when(~F.array_contains("gone", i + 1), v)))
    vectors = made.select("col_idx", F.concat(F.lit("feature"), F.col("col_idx")).alias("feature"), F.lit(None).cast("double").alias("location"), "vals")
    group = lambda c, k, s: F.concat(F.lit("group"), F.pmod(F.xxhash64(F.lit(seed), F.lit(s), c), F.lit(k)) + 1)
    col_group = vectors.select("feature", group(F.col("col_idx"), n_col_groups, 5).alias("grp"))
    row_group = spark.range(1, n + 1).select(F.concat(F.lit("sample"), F.col("id")).alias("sample"), group(F.col("id"), n_row_groups, 6).alias("grp"))
    return Simulation(Matrix(vectors, [f"sample{i}" for i in range(1, n + 1)]), col_group, row_group)
