"""A corpus pipeline: documents go through STAGES, each stage's result being the next one's input.

Every stage but the last returns the columns of its docs, whatever they are called, takes an empty table and
gives an empty one, and takes whole texts of any length. Repeated rows, nulls and ties are settled as each says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.llm import lines, mixing, near, packing, quality
from lacunar.llm._dist import row_of, unrolled
from lacunar.llm.queries import table, tokenizer_files
from lacunar.sources.store import stored

#: No stage but line dedup can be expressed in SQL.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good.

    Rows are judged by their text alone, so repeated rows stay or go together, and a null text is judged as an empty
    one; a score at the threshold is good.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    good = quality.scored(docs, model).where(F.col("score") >= quality.THRESHOLD)
    return good.select(*unrolled(docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of larger doc_id keeps.

    Every row stays, with what is left of its text. Rows of one doc_id count as one document; a null doc_id or text is
    left alone.
    """
    out = lines.dedup_rows(docs)
    return out.select(*unrolled(docs.columns, **counted(docs, F.col("text"), F.col("n_dropped") > 0)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links (five words, 0.8) join, the one of smallest doc_id: see near.one_of_each."""
    return near.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: see mixing.mixed_texts."""
    out = mixing.mixed_texts(docs)
    return out.select(row_of(out)).select(*unrolled(docs.columns, **counted(docs, F.col("row")["text"], F.lit(True))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences: see packing.pack_documents."""
    return packing.pack_documents(docs, *tokenizer_files())


def counted(docs: DataFrame, text: Column, changed: Column) -> dict[str, Column]:
    """The new text and, if docs have n_chars, its length where it changed; for unrolled()."""
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(changed, F.length(text)).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over sf_dir's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
