"""Line deduplication with levelled sorted runs of line hashes. DataFrame functions only.

The documents come in batches, the largest doc_id first. A batch's line keys are hashed and
counted; those that no run holds yet (an anti-join on the sorted hashes) belong to this batch's
largest document that has them. The batch's own hashes, sorted, become a run of level 0; when a
level has `fanout` runs they are merged into one of the next level. In the end the runs tell for
each key in how many documents it is and which of them keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.llm._dist import bound, row_of, unrolled
from lacunar.sources.store import discard, fresh_path, stored

LEAST_CHARS = 20
LEAST_DOCS = 3
BATCHES = 4
#: A task that merges runs holds about so many keys.
KEYS_A_TASK = 1 << 17
FANOUT = 3
_BLANK = "' \t\n\x0b\x0c\r'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, docs long, owner long"


def line_keys(text: Column) -> Column:
    """Each line's key: blanks stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "\n"), lambda x: F.call_function("btrim", x, F.lit(" \t\n\x0b\x0c\r")))


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


class LineRuns:
    """Sorted runs of (h1, h2, docs, owner) by level, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, parts: int = 1):
        """parts: among how many tasks the merging of all runs is dealt out."""
        self.spark, self.fanout, self.parts = spark, fanout, parts
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        path = fresh_path(self.spark, f"run{level}")
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*paths)

    def rows(self) -> DataFrame:
        """All runs' rows; a key may be in several."""
        return self._read([p for level in self.levels for p in level])

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("owner").alias("owner"))

    def add(self, hashes: DataFrame) -> None:
        """hashes (doc_id, h1, h2): a batch's distinct keys by document, all of smaller doc_id than those before."""
        own = hashes.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("owner"))
        if any(self.levels):
            held = self.rows().select("h1", "h2")
            new = own.join(held, ["h1", "h2"], "left_anti")
            old = own.join(held, ["h1", "h2"], "left_semi").withColumn("owner", F.lit(None).cast("long"))
            own = new.unionByName(old)
        self._write(own, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            paths, self.levels[level] = self.levels[level], []
            self._write(self.merged(self._read(paths).repartition(self.parts, "h1", "h2")), level + 1)
            discard(self.spark, *paths)
            level += 1


def repeated_lines(hashes: DataFrame, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(h1, h2, owner) of the keys found in at least `least_docs` documents, from (doc_id, h1, h2)."""
    spark = hashes.sparkSession
    runs = LineRuns(spark, fanout, 1 + hashes.count() // KEYS_A_TASK)
    cuts = hashes.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        part = hashes
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        runs.add(part)
    return runs.merged(runs.rows().repartition(runs.parts, "h1", "h2")).where(F.col("docs") >= least_docs).select("h1", "h2", "owner")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """docs with text replaced by the lines that stay, then n_lines, n_dropped, whatever docs' own columns are called.

    A null or empty text is one empty line, and an untouched null stays null. Rows of one doc_id are
    one document: each counts it once. A null doc_id takes no part in the counts and loses no line.
    Long texts are handled whole. An empty table gives no rows.
    """
    out = dedup_rows(docs, least_chars, least_docs, batches, fanout)
    return out.select(*unrolled(docs.columns, text=F.col("text")), "n_lines", "n_dropped")


def dedup_rows(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """row (all columns of docs as they were, as a struct), and as dedup_lines has them text, n_lines, n_dropped."""
    keys = line_keys(F.col("text"))
    long_ = F.array_distinct(F.transform(F.filter(keys, lambda k: F.length(k) >= least_chars), key_hash))
    hashes = docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(long_).alias("h")).select("doc_id", "h.h1", "h.h2").distinct()
    hashes = stored(hashes, "lines")
    # stored, so that the join's both sides are dealt alike and Spark may split a line that very many documents have
    repeated = stored(repeated_lines(hashes, least_docs, batches, fanout), "repeated")
    gone = hashes.join(repeated, ["h1", "h2"]).where("doc_id < owner").groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    held = docs.select(row_of(docs), F.col("doc_id").alias("id")).join(gone, F.col("id") == F.col("gone_id"), "left")
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    key = lambda x: F.when(F.length(x) >= least_chars, key_hash(F.call_function("btrim", F.translate(x, _UPPER, _LOWER), F.lit(" \t\n\x0b\x0c\r"))))

    def kept(lines: Column, gone: Column) -> Column:
        """The lines whose key isn't gone; looked up in about as many buckets as the root of their number."""
        n = F.ceil(F.sqrt(F.size(gone))).cast("long")
        buckets = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda b: F.filter(gone, lambda g: F.pmod(g["h1"], n) == b))
        both = F.struct(buckets.alias("buckets"), F.transform(lines, key).alias("keys"))
        return bound(both, lambda s: F.filter(lines, lambda x, i: F.coalesce(~F.array_contains(F.element_at(s["buckets"], (F.pmod(F.get(s["keys"], i)["h1"], n) + 1).cast("int")), F.get(s["keys"], i)), F.lit(True))))

    # texts without such lines, most of them, are not taken apart
    held = held.withColumn("kept", F.when(F.col("gone").isNotNull(), bound(F.split(text, "\n"), lambda lines: kept(lines, F.col("gone")))))
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    dropped = F.when(F.col("kept").isNull(), F.lit(0).cast("long")).otherwise(n_lines - F.size("kept"))
    return held.select("row", F.when(dropped > 0, F.array_join("kept", "\n")).otherwise(F.col("row")["text"]).alias("text"), n_lines.alias("n_lines"), dropped.alias("n_dropped"))
