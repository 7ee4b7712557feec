"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD_OUT_OF = 5


def remainder(of: int = HELD_OUT_OF) -> Column:
    """crc32 of doc_id as text, modulo `of`; -1 where doc_id is null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, of: int = HELD_OUT_OF) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows whose remainder isn't 0, chosen by a hash of doc_id.

    Several labels of one doc_id are averaged and null labels left out. The choice is made on ids alone, at most
    `most` of them. Of rows repeated under one doc_id the one with the least text hash is used, the same at each rerun;
    they are narrowed down where they are read, so no id's rows meet anywhere.
    """
    known = labels.where(F.col(label).isNotNull() & (remainder(of) != 0)).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
