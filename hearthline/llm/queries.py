"""The corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import dealt, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.sharding import shard_by_bytes

    placed = shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.toxicity import THRESHOLD, fit, held_out, score

    docs = dealt(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.url_filter import judge

    return judge(dealt(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.sentencepiece_codec import encode

    docs = dealt(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, verify=True).drop("text")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.pii import replace_pii

    return replace_pii(dealt(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.secret_scan import digest, find_secrets

    return digest(find_secrets(dealt(spark, sf_dir, "documents")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(dealt(spark, sf_dir, "embeddings"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.minhash_dedup import near_duplicates

    return near_duplicates(dealt(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hearthline.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).drop("repeats", "text_hash")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_url_filter": op4_url_filter,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_pii": op6_pii,
        "op7_secret_scan": op7_secret_scan,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_minhash_dedup": op9_minhash_dedup,
        "op10_mixing": op10_mixing,
        "pipeline": pipeline,
    }


NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

#: The directory's splits are repeated by counting the distinct keys under every prefix: a bucket is the shortest prefix that fits.
OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, {NORM} AS norm FROM documents
), e AS (
  SELECT *, sha256(norm) AS sha, ('0x' || substr(sha256(norm), 1, 15))::BIGINT AS h FROM d
), k AS (
  SELECT norm, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) AS keep_id, count(*) AS group_size FROM e GROUP BY norm
), f AS (
  SELECT depth, h >> (60 - depth) AS prefix, count(DISTINCT h) <= 4096 OR depth = 16 AS fits
  FROM e, (SELECT unnest(range(17)) AS depth) GROUP BY depth, h >> (60 - depth)
), g AS (
  SELECT e.h, min(f.depth) AS depth FROM (SELECT DISTINCT h FROM e) e JOIN f ON f.prefix = e.h >> (60 - f.depth) AND f.fits GROUP BY e.h
)
SELECT e.doc_id, k.keep_id, k.group_size, e.doc_id = k.keep_id AS kept, e.sha AS text_sha256,
  CAST((h >> (60 - depth)) << (16 - depth) AS INTEGER) AS bucket, CAST(depth AS INTEGER) AS depth
FROM e JOIN k USING (norm) JOIN g USING (h)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL}
