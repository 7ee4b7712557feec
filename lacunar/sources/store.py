"""Tables in the folder that the driver and all executors share.

A table written there cuts the lineage, is computed once and outlives any executor.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ours: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder of this machine, which only a local master may use."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="lacunar-")
        spark.conf.set("spark.checkpoint.dir", place)
        _ours[place] = spark
    return place


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own below a folder of this application."""
    root = f"{shared_dir(spark).rstrip('/')}/lacunar-{spark.sparkContext.applicationId}"
    _ours.setdefault(root, spark)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read again."""
    path = path or fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear() -> None:
    """Results may be read until the end, so what they rest on goes with the application."""
    for place, spark in _ours.items():
        try:
            discard(spark, place)
        except Exception:  # noqa: BLE001  the session has ended: its own cleaner or the folder's owner deletes them
            return
