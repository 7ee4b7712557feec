"""Mixing sources to target weights.

Each source's words form a stream, cut into blocks of `block` words, and has as many slots in the mix
as its target needs. A multinomial draw for each source says how many of its slots each output shard
has; so a shard's counts vary as draws with the target weights as odds do, and a source's counts over
all shards are its target at every size. A source's slots are numbered over the shards; slot k reads
the block that a pseudorandom permutation of the source's block numbers, another at each round
through them, gives for k. Slots and documents are joined by (source, block).

Streams are laid out chunk by chunk, so a source that holds a third of all rows is cut by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lacunar.llm._dist import chunks_of, row_of, running_total, salt, unrolled
from lacunar.llm._text import lean, mix, word_counts, words
from lacunar.sources.store import stored

BLOCK = 32
SHARD_SLOTS = 8192
#: A task draws the counts of so many shards.
SHARD_CHUNK = 1024
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """total shared by weight; what goes beyond most * size is shared again among the others."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w >= most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where x goes under a pseudorandom permutation of 0 .. n-1 chosen by key: a Feistel network, walked until it is inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        v, h, m, k = out[todo], half[todo], low[todo], key[todo]
        left, right = v >> h, v & m
        for r in range(4):
            left, right = right, left ^ (mix(right * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r * 0x51ED27)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_counts(n: int, shards: int, chunk: int, seed: list[int], width: int = SHARD_CHUNK) -> tuple[int, np.ndarray]:
    """Of a multinomial draw of n over all shards, equally likely: what comes before the chunk of `width` shards, and the chunk's counts.

    Halving the shards again and again, with a binomial draw for each half, draws the same for every chunk without
    going through the others.
    """
    a, b, before = 0, -(-shards // width), 0
    while b - a > 1:
        middle = (a + b) // 2
        share = (middle - a) * width / (min(shards, b * width) - a * width)
        left = int(np.random.default_rng([*seed, a, b]).binomial(n, share))
        if chunk < middle:
            n, b = left, middle
        else:
            before, n, a = before + left, n - left, middle
    m = min(shards, b * width) - a * width
    return before, np.random.default_rng([*seed, a]).multinomial(n, np.full(m, 1 / m))


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (a hash of the text), size (number of words) of each row."""

    @lean
    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(word_counts(b.column(3)))], ["doc_id", "source", "key", "size"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(sized, "doc_id long, source string, key long, size long")


def mixture(sizes: DataFrame, seed: int = 17, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with source_size, target, taken; the slots (shard, sid, slot, block) that make up the mix; and
    the parts of documents that it reads (doc_id, key, first word, words, reads).

    Rows without words take part with size 0 and are never taken. A null source is a source of its own,
    the last. Repeated rows are documents of their own. The driver holds one row per source.
    """
    spark = sizes.sparkSession
    sizes = stored(sizes, "sizes")
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
    per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    n = [r["n"] for r in per_source]
    goal = targets(n, [weights[i % len(weights)] for i in range(len(n))], share * sum(n), most)
    blocks = [-(-x // block) for x in n]
    wanted = [min(round(g * b / x), int(most * b)) if x else 0 for g, b, x in zip(goal, blocks, n)]
    table = [(r["source"], i, n[i], goal[i], blocks[i], chunks_of(r["rows"])) for i, r in enumerate(per_source)]
    known = spark.createDataFrame(table, "_source string, sid int, source_size long, target double, n_blocks long, chunks int")
    shards = max(1, -(-sum(wanted) // shard_slots))

    @lean
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk in b.column(0).to_pylist():
                for sid, slots in enumerate(wanted):
                    before, counts = shard_counts(slots, shards, chunk, [seed, sid])
                    first = before + np.cumsum(counts) - counts
                    has = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(has + chunk * SHARD_CHUNK), pa.array(np.full(len(has), sid, np.int32)), pa.array(first[has]), pa.array(counts[has])], ["shard", "sid", "first", "count"])

    n_chunks = -(-shards // SHARD_CHUNK)
    counts = spark.range(0, n_chunks, 1, min(n_chunks, 10_000)).mapInArrow(drawn, "shard long, sid int, first long, count long")
    # the shards of a small mix are few and in one task: dealt out before their slots are made
    counts = counts.repartition("shard", "sid")
    slots = counts.join(known.select("sid", "n_blocks"), "sid").select("shard", "sid", "n_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"))

    @lean
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, sid, size, slot = (np.asarray(c) for c in b.columns)
            key = mix(sid.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + (slot // np.maximum(size, 1)).astype(np.uint64) + np.uint64(seed))
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(sid), pa.array(slot), pa.array(permuted(slot % np.maximum(size, 1), size, key))], ["shard", "sid", "slot", "block"])

    slots = slots.mapInArrow(mapped, "shard long, sid int, slot long, block long")

    docs = sizes.join(known, sizes["source"].eqNullSafe(known["_source"])).drop("_source")
    laid = running_total(docs.withColumn("_c", salt(F.col("chunks"), "doc_id")), ["sid"], "_c", ["doc_id", "key"], F.col("size"), "begin")
    laid = stored(laid.withColumn("_row", F.monotonically_increasing_id()).drop("_c", "chunks"), "laid")
    parts = laid.where("size > 0").select("_row", "doc_id", "key", "sid", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"))
    first_word = F.greatest(F.col("begin"), F.col("block") * block) - F.col("begin")
    parts = parts.select("_row", "doc_id", "key", "sid", "block", first_word.alias("first"), (F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("begin"), F.col("block") * block)).alias("words"))
    reads = slots.groupBy("sid", "block").agg(F.count("*").alias("reads"))
    parts = parts.join(reads, ["sid", "block"])
    taken = parts.groupBy("_row").agg(F.sum(F.col("words") * F.col("reads")).alias("taken"))
    out = laid.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken"), slots, parts.select("doc_id", "key", "first", "words", "reads")


def mix_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    A null or wordless text has size 0 and nothing taken; a null doc_id stays; repeated rows are rows of their own,
    each with what is taken of it. A null source is the last one. An empty table gives no rows.
    """
    return mixture(sizes_of(docs), seed, **options)[0].select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: docs with text replaced by the words that the mix takes, parts that it reads again after a line break.

    A document of which nothing is taken is left out: so is one without words, or with a null text. Rows alike in
    doc_id and text are one, with all that is taken of them and one row's other columns, the same one at each rerun.
    A null doc_id is an id like others. Long texts are cut by block like all. An empty table gives an empty mix.
    """
    parts = mixture(sizes_of(docs), seed, **options)[2]
    # as many entries as the document has blocks
    lists = parts.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("first", "words", "reads"))).alias("parts"))
    whole = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("row_id"), F.xxhash64(F.col("text").cast("string")).alias("row_key"))
    met = whole.join(lists, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("key")))
    met = met.groupBy("doc_id", "key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"), F.first("parts").alias("parts"))
    names = docs.columns
    out = met.select("row", *[F.col("parts")[c].alias(c) for c in ("first", "words", "reads")])
    schema = StructType([out.schema["row"], StructField("text", StringType())])

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, firsts, counts, reads in zip(b.column(0).field("text").cast(pa.string()).to_pylist(), *(c.to_pylist() for c in b.columns[1:])):
                raw = text.encode()
                starts = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
                starts = np.append(starts, len(raw))
                rounds = []
                for r in range(1, max(reads) + 1):
                    spans = [raw[starts[f] : starts[min(f + n, len(starts) - 1)]] for f, n, m in zip(firsts, counts, reads) if m >= r]
                    # of rows alike a text's end may come before another's part
                    rounds.append(b"".join(x if x[-1:].isspace() else x + b"\n" for x in spans).rstrip())
                texts.append(b"\n".join(rounds).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return out.mapInArrow(cut, schema).select(*unrolled(names, text=F.col("text")))
