"""Threshold-scaled sketches of documents. DataFrame functions only.

A sketch holds every hash of a document's word shingles that lies below a fixed fraction of the
hash range. Sketches of any two documents, however unequal, sample the same part of the range,
so overlap and containment are read off directly, and the sketch of a union is the union of the
sketches. A small set is held whole; against a larger one it counts by what lies below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacunar.llm._dist import bound

WORDS = 5
#: One in SCALE shingle hashes is retained.
SCALE = 8
#: Of a text with at most so many distinct shingles all are retained, as a fixed fraction of few says little.
DENSE = 64


def limit_of(scale: int) -> Column:
    return F.lit(-(1 << 63) + (1 << 64) // scale)


def _made(hashes: Column, limit: Column) -> Column:
    """The sketch of distinct hashes."""
    few = F.size(hashes) <= DENSE
    return F.struct(few.alias("whole"), F.array_sort(F.when(few, hashes).otherwise(F.filter(hashes, lambda x: x < limit))).alias("hashes"))


def sketch(text: Column, k: int = WORDS, scale: int = SCALE) -> Column:
    """struct(whole, hashes): the sorted distinct shingle hashes below 1/scale of the range; all of them (whole) where there are at most DENSE.

    Fewer than k words are one shingle; a text without words, or null, has an empty whole sketch.
    """
    limit = limit_of(scale)
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(many)

    def below(h: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < limit)))
        # more than DENSE below the limit: no need to look at the others
        return bound(kept, lambda x: F.when(F.size(x) > DENSE, F.struct(F.lit(False).alias("whole"), x.alias("hashes"))).otherwise(bound(F.array_distinct(h), lambda d: _made(d, limit))))

    return bound(bound(found, hashes), below)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the union of two sets of shingles, from their sketches alone."""
    limit = limit_of(scale)
    both = F.array_union(a["hashes"], b["hashes"])
    below = F.struct(F.lit(False).alias("whole"), F.array_sort(F.filter(both, lambda x: x < limit)).alias("hashes"))
    return F.when(a["whole"] & b["whole"], bound(both, lambda x: _made(x, limit))).otherwise(below)


def common(a: Column, b: Column, scale: int = SCALE) -> Column:
    """struct(a, b): the hashes of two sketches in the part of the range that both retain."""
    limit = limit_of(scale)
    part = lambda x: F.when(a["whole"] & b["whole"], x["hashes"]).otherwise(F.filter(x["hashes"], lambda h: h < limit))
    return F.struct(part(a).alias("a"), part(b).alias("b"))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated Jaccard similarity, exact for two whole sketches; two empty sets are alike.

    Where neither retains anything in the part of the range that both cover, at most DENSE shingles stand against
    more, of which none is known to be shared: 0.
    """

    def of(c: Column) -> Column:
        union = F.size(F.array_union(c["a"], c["b"]))
        return F.when(union > 0, F.size(F.array_intersect(c["a"], c["b"])) / union).otherwise((a["whole"] & b["whole"]).cast("double"))

    return bound(common(a, b, scale), of)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of a's shingles that b has, exact for two whole sketches; an empty set is contained in any.

    Null where a has shingles but retains none in the part of the range that both cover.
    """

    def of(c: Column) -> Column:
        n = F.size(c["a"])
        return F.when(n > 0, F.size(F.array_intersect(c["a"], c["b"])) / n).when(F.size(a["hashes"]) == 0, F.lit(1.0))

    return bound(common(a, b, scale), of)


def as_text(a: Column) -> Column:
    """w or s, for whole or scaled, and 16 lowercase hex digits per hash, in order."""
    return F.concat(F.when(a["whole"], "w").otherwise("s"), F.array_join(F.transform(a["hashes"], lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ""))


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """docs (doc_id, ...) with next_<column>: the columns of the row that follows in descending doc_id; after the last, the first's.

    Rows are dealt to buckets of consecutive doc_id by quantiles; the first row of a bucket is also sent to the
    bucket that ends just before it, so a single shuffle suffices and no task sees more than its bucket.
    Of rows with one doc_id, that with the smaller text hash comes first. A null doc_id counts as the smallest.
    """
    docs = docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    cuts = docs.agg(F.percentile_approx("_id", [i / buckets for i in range(1, buckets)] or [0.5], 10_000).alias("c")).first()["c"]
    if cuts is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("_id")
    cuts = sorted(set(cuts))
    step = max(1, int(len(cuts) ** 0.5))
    coarse, all_cuts = F.lit(cuts[::step]), F.lit(cuts)
    coarse_at = F.size(F.filter(coarse, lambda x: x < F.col("_id")))
    start = F.greatest(coarse_at - 1, F.lit(0)) * step
    docs = docs.withColumn("_b", start + F.size(F.filter(F.slice(all_cuts, start + 1, step + 1), lambda x: x < F.col("_id"))))
    # at most `buckets` rows, whatever the input
    tops = sorted((r["_b"], r["m"]) for r in docs.groupBy("_b").agg(F.max("_id").alias("m")).collect())
    after = dict(zip([b for b, _ in tops], [b for b, _ in tops[1:]] + [tops[0][0]]))
    size = tops[-1][0] + 1
    highest, target = [None] * size, [None] * size
    for b, m in tops:
        highest[b], target[b] = m, after[b]
    at = F.col("_b") + 1
    is_top = F.col("_id") == F.element_at(F.lit(highest), at)
    places = F.when(is_top, F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("ghost")), F.struct(F.element_at(F.lit(target), at).alias("b"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("ghost"))))
    dealt = docs.withColumn("_p", F.explode(places)).drop("_b")
    window = Window.partitionBy("_p.b").orderBy(F.col("_p.ghost"), F.col("_id").desc(), F.xxhash64("text"))
    out = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return out.where(~F.col("_p.ghost")).drop("_p", "_id")


def edited_fingerprints(docs: DataFrame, k: int = WORDS, scale: int = SCALE, buckets: int | None = None) -> DataFrame:
    """Each document's sketch, that of its text with the second half replaced by the next document's start, and likenesses.

    doc_id, text, edited, sketch, edited_sketch, near_edited, near_next, in_next (containment of the sketch in the next
    document's). A null text is empty. Rows repeated under one doc_id are documents of their own, in the order of
    their texts' hashes; rows without doc_id come last. A single row follows itself; an empty table gives no rows.
    """
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = with_next(docs.withColumn("sketch", sketch(F.col("text"), k, scale)), ["text", "sketch"], buckets)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    docs = docs.withColumn("edited_sketch", sketch(F.col("edited"), k, scale))
    return docs.select("doc_id", "text", "edited", "sketch", "edited_sketch", likeness(F.col("sketch"), F.col("edited_sketch"), scale).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch"), scale).alias("near_next"), containment(F.col("sketch"), F.col("next_sketch"), scale).alias("in_next"))
