"""Sliding and flanking windows along the features' locations."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = "start int, end int"


def greedy(x: list[float], size: float, overlap: float = 0.0) -> list[tuple[int, int]]:
    """1-based inclusive windows over sorted locations: [x, x + size), the next one from `overlap` before that end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below the window size")
    out, i, n = [], 0, len(x)
    while i < n:
        j = bisect.bisect_left(x, x[i] + size) - 1
        j = max(j, i)
        out.append((i + 1, j + 1))
        if j == n - 1:
            break
        nxt = bisect.bisect_left(x, x[i] + size - overlap, i + 1, j + 1)
        i = nxt if nxt <= j else j + 1
    return out


def sliding(features: DataFrame, size: float, overlap: float = 0.0) -> DataFrame:
    """window_id, start, end, window_n from features (col_idx, location); one task walks the axis of (location) alone."""
    greedy([], size, overlap)

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by("col_idx")
        found = greedy(t.column("location").to_pylist(), size, overlap)
        return pa.table([pa.array([w[0] for w in found], pa.int32()), pa.array([w[1] for w in found], pa.int32())], ["start", "end"])

    made = features.select("col_idx", "location", F.lit(0).alias("g")).groupBy("g").applyInArrow(walk, WINDOW)
    return made.select(F.row_number().over(Window.orderBy("start")).alias("window_id"), "start", "end", (F.col("end") - F.col("start") + 1).alias("window_n"))


def flanking(features: DataFrame, targets: DataFrame, size: float) -> DataFrame:
    """One window per target (col_idx): the features from size before to size after it; with target and its place in the window."""
    t = features.join(targets, "col_idx", "left_semi").select(F.col("col_idx").alias("target"), F.col("location").alias("at"))
    bucket = F.floor(F.col("location") / size)
    near = t.withColumn("b", F.explode(F.sequence(F.floor((F.col("at") - size) / size), F.floor((F.col("at") + size) / size))))
    met = near.join(features.withColumn("b", bucket), "b").where((F.col("location") >= F.col("at") - size) & (F.col("location") <= F.col("at") + size))
    out = met.groupBy("target").agg(F.min("col_idx").alias("start"), F.max("col_idx").alias("end"))
    return out.select(F.row_number().over(Window.orderBy("target")).alias("window_id"), "start", "end", (F.col("end") - F.col("start") + 1).alias("window_n"), "target", (F.col("target") - F.col("start") + 1).alias("subset_local"))


def members(windows: DataFrame) -> DataFrame:
    """window_id, col_idx, by sequence and explode, so that it joins by equality."""
    return windows.select("window_id", F.explode(F.sequence("start", "end")).alias("col_idx"))


def pruned(windows: DataFrame, least: int | None, targets: DataFrame | None) -> DataFrame:
    """Windows of at least `least` features that hold a target; ValueError if none is left."""
    out = windows if least is None else windows.where(F.col("window_n") >= least)
    if targets is not None:
        out = out.join(members(out).join(targets, "col_idx", "left_semi").select("window_id").distinct(), "window_id", "left_semi")
    if out.isEmpty():
        raise ValueError("no window is left")
    return out


def coverage(windows: DataFrame) -> DataFrame:
    """col_idx, windows that cover it."""
    return members(windows).groupBy("col_idx").agg(F.count("*").alias("n_windows"))


def overlap_regions(windows: DataFrame) -> DataFrame:
    """start, end of the maximal runs of features that more than one window covers."""
    more = coverage(windows).where("n_windows > 1")
    runs = more.withColumn("run", F.col("col_idx") - F.row_number().over(Window.orderBy("col_idx")))
    return runs.groupBy("run").agg(F.min("col_idx").alias("start"), F.max("col_idx").alias("end")).drop("run")
