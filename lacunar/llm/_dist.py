"""Distributed building blocks that hold under skew and when executors are lost."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacunar.sources.store import discard, fresh_path, stored


def row_of(docs: DataFrame, name: str = "row") -> Column:
    """All columns of docs as one struct, so that no name that an operator adds can meet one of theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)


def unrolled(columns: list[str], name: str = "row", **replaced: Column) -> list[Column]:
    """The columns of row_of again, some replaced."""
    return [replaced.get(c, F.col(name)[c]).alias(c) for c in columns]


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks_of(rows: int) -> int:
    """How many chunks to rank or sum `rows` rows by: as many as a chunk has rows, so that neither grows with the input alone."""
    return 1 + int(rows**0.5)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that are no longer used, now that their result is stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def salt(n: int | Column, *columns: str) -> Column:
    """A number from 0 to n - 1 that depends on the columns alone, the same at each rerun."""
    return F.pmod(F.xxhash64(*columns), F.lit(max(1, n)) if isinstance(n, int) else n)


def running_total(df: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before this one in its keys' group, in the order (chunk, order).

    A group of any size is summed by chunk first, so that no task sees more than one chunk's rows; only one
    row per chunk meets in a group's window.
    """
    df = df.withColumn("_v", value)
    before = (
        df.groupBy(*keys, chunk)
        .agg(F.sum("_v").alias("_s"))
        .withColumn("_b", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_s")
    )
    within = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_w", F.coalesce(F.sum("_v").over(within), F.lit(0))).join(before, [*keys, chunk])
    return out.withColumn(name, F.col("_b") + F.col("_w")).drop("_v", "_w", "_b")


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of the edges reaches.

    Alternates large-star and small-star steps; each step shuffles about as many rows as there are edges,
    and a hub's neighbours are pre-aggregated, never gathered. The lineage is cut at each round.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    pairs = stored(pairs, "edges", path)
    last = None
    for _ in range(most):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = fresh_path(spark, "edges")
        pairs = stored(small, "edges", nxt)
        discard(spark, path)
        path = nxt
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    up = pairs.groupBy("u").agg(F.min("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node")).distinct().join(up.select(F.col("u").alias("node")), "node", "left_anti")
    return up.select(F.col("u").alias("node"), "component").unionByName(roots.select("node", F.col("node").alias("component")))
