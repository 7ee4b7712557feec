"""Completing a matrix again as new cells arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lacunar.operators.result import ImputeResult
from lacunar.sources.matrix import Matrix, from_cells


def impute_stream(cells: DataFrame, table: str, out: str, method: Callable[[Matrix], ImputeResult], checkpoint: str, **columns) -> StreamingQuery:
    """Adds each micro-batch of cells to the parquet folder `table` and writes the whole matrix, completed, to `out`.

    A batch has a folder of its own, so one that is replayed replaces itself. Any new cell may change any
    completed value, so all of them are written again. Of a cell that comes again the largest value is used.
    """

    def batch(new: DataFrame, number: int) -> None:
        spark = new.sparkSession
        new.write.mode("overwrite").parquet(f"{table}/batch={number}")
        result = method(from_cells(spark.read.parquet(table), **columns))
        result.df.write.mode("overwrite").parquet(out)

    return cells.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
