"""Incomplete matrices as DataFrames: long cells, one vector per feature, or wide tables.

Rows are samples (few), columns are features (any number). Missing is null; NaN is read as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacunar.sources.store import stored

VECTORS = "col_idx int, feature string, location double, vals array<double>"


def clean(value: Column) -> Column:
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


@dataclass
class Matrix:
    """vectors (col_idx from 1, feature, location, vals in the order of samples) and the samples' labels."""

    vectors: DataFrame
    samples: list

    @property
    def n(self) -> int:
        return len(self.samples)

    def labels(self) -> DataFrame:
        """row_idx (from 1), sample; a local table, which Spark broadcasts only while it is small."""
        return self.vectors.sparkSession.createDataFrame([(i, s) for i, s in enumerate(self.samples, 1)] or [(0, "")], ["row_idx", "sample"]).withColumn("row_idx", F.col("row_idx").cast("int"))

    def cells(self) -> DataFrame:
        """sample, row_idx, feature, col_idx, location, value."""
        at = self.vectors.select("col_idx", "feature", "location", F.posexplode("vals").alias("p", "value")).withColumn("row_idx", F.col("p") + 1)
        return at.join(self.labels(), "row_idx").select("sample", "row_idx", "feature", "col_idx", "location", "value")

    def with_vectors(self, vectors: DataFrame) -> Matrix:
        return Matrix(vectors, self.samples)

    def kept(self) -> Matrix:
        """The same with its vectors computed once and stored."""
        return self.with_vectors(stored(self.vectors, "vectors"))

    def wide(self) -> DataFrame:
        """One row per sample, one column per feature; for few features."""
        return self.cells().groupBy("row_idx", "sample").pivot("feature").agg(F.first("value")).orderBy("row_idx").drop("row_idx")

    def to_numpy(self) -> np.ndarray:
        """samples x features, in driver memory."""
        t = self.vectors.orderBy("col_idx").select("vals").toArrow()
        return dense(t.column("vals")).T.reshape(self.n, -1)


def dense(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of a matrix, null as NaN."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists, NaN as null."""
    flat = pa.array(x.ravel(), pa.float64(), from_pandas=True)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)


def from_cells(cells: DataFrame, sample: str = "sample", feature: str = "feature", value: str = "value", location: str | None = None) -> Matrix:
    """From long cells; absent cells are missing. Features are in order of location, then name; of repeated cells the largest value is used.

    Each feature's cells are gathered once and put in their samples' places; the vectors are stored, so
    that everything after reads them instead of the cells.
    """
    place = F.min(F.col("l")) if location else F.lit(None).cast("double")
    cells = cells.select(F.col(sample).alias("s"), F.col(feature).alias("f"), clean(F.col(value)).alias("v"), (F.col(location).cast("double") if location else F.lit(None).cast("double")).alias("l")).where("s is not null and f is not null")
    spark = cells.sparkSession
    samples = [r["s"] for r in cells.select("s").distinct().collect()]
    samples.sort()
    if not samples:
        return Matrix(spark.createDataFrame([], VECTORS), [])
    ids = spark.createDataFrame([(s, i) for i, s in enumerate(samples)], cells.select(F.col("s").alias("s2"), F.lit(0).alias("i")).schema)
    held = cells.join(ids, F.col("s") == F.col("s2")).groupBy("f").agg(F.collect_list(F.struct("i", "v")).alias("c"), place.alias("location"))
    held = held.select(F.col("f").cast("string").alias("feature"), "location", F.col("c.i").alias("i"), F.col("c.v").alias("v"))
    n = len(samples)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, values = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy(zero_copy_only=False).astype(float)
                x = np.full(b.num_rows * n, np.nan)
                np.fmax.at(x, np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy()) * n + at, values)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(x.reshape(-1, n))], ["feature", "location", "vals"])

    held = stored(held.mapInArrow(placed, "feature string, location double, vals array<double>"), "cells")
    return Matrix(_numbered(held), samples)


def _numbered(held: DataFrame) -> DataFrame:
    """Adds col_idx; only the names meet in one task."""
    order = Window.orderBy(F.col("location").asc_nulls_last(), "feature")
    names = held.select("feature", "location").withColumn("col_idx", F.row_number().over(order)).select(F.col("feature").alias("_f"), "col_idx")
    return held.join(names, F.col("feature") == F.col("_f")).select("col_idx", "feature", "location", "vals")


def from_wide(table: DataFrame, sample: str) -> Matrix:
    """From one row per sample; features keep the table's column order."""
    names = [c for c in table.columns if c != sample]
    long = table.select(F.col(sample).alias("sample"), *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["sample"], names, "feature", "value")
    made = from_cells(long)
    order = table.sparkSession.createDataFrame([(c, i) for i, c in enumerate(names, 1)], "feature string, place int")
    return made.with_vectors(made.vectors.join(order, "feature").select(F.col("place").alias("col_idx"), "feature", "location", "vals"))


def from_numpy(spark: SparkSession, x: np.ndarray, names: list[str] | None = None, location: list[float] | None = None) -> Matrix:
    p = x.shape[1]
    rows = [(j + 1, names[j] if names else f"feature{j + 1}", float(location[j]) if location is not None else None, [None if np.isnan(v) else float(v) for v in x[:, j]]) for j in range(p)]
    return Matrix(spark.createDataFrame(rows, VECTORS), [f"sample{i + 1}" for i in range(x.shape[0])])


def read(spark: SparkSession, path: str, kind: str = "parquet", **columns) -> Matrix:
    """Long cells from parquet, csv, json or orc files."""
    reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
    return from_cells(reader.format(kind).load(path), **columns)


def write(m: Matrix, path: str, kind: str = "parquet", mode: str = "error") -> None:
    m.cells().write.format(kind).mode(mode).save(path)
