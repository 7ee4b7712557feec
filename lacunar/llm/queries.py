"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacunar.llm import fingerprints, lines, lm, mixing, near, packing, quality, suffix, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "in_next",
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix.without_repeats(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(rows, rows.where("id % 100 = 0"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = lines.dedup_lines(docs)
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"), k=3, share=0.9)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer_files())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_fingerprints": op2_fingerprints,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality": op4_quality,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_exact_topk": op6_exact_topk,
        "op7_line_dedup": op7_line_dedup,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_mixing": op9_mixing,
        "op10_packing": op10_packing,
    }


SQL = {
    "op6_exact_topk": """
with sound as (
  select vec_id, embedding from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0),
x as (select vec_id, unnest(embedding)::double as v, unnest(range(len(embedding))) as d from sound),
bad as (select distinct vec_id from x where v is null or not isfinite(v)),
e as (select vec_id, d, floor(1024 * v)::bigint as v from x where vec_id not in (select vec_id from bad)),
s as (
  select q.vec_id as query_id, r.vec_id as vec_id, sum(q.v * r.v)::bigint as score
  from e q join e r on q.d = r.d and q.vec_id <> r.vec_id
  where q.vec_id % 100 = 0 group by 1, 2),
k as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
select query_id, rank, vec_id, score from k where rank <= 10""",
    "op7_line_dedup": r"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos
  from documents),
k as (
  select doc_id, pos, line,
         trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
  from l),
c as (select key, max(doc_id) as owner from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, k.pos, k.line, c.owner is not null and k.doc_id < c.owner as gone from k left join c on k.key = c.key)
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
