"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from confluo.llm.bpe import documents_digest, encode_documents
from confluo.llm.common import documents
from confluo.llm.exact_dedup import exact_dedup
from confluo.llm.language import identify_languages
from confluo.llm.near_dedup import near_dedup
from confluo.llm.packing import pack, pieces_digest
from confluo.llm.pii import personal_data
from confluo.llm.prefix_trie import SQL as TRIE_SQL
from confluo.llm.prefix_trie import prefix_trie
from confluo.llm.quality import quality_scores
from confluo.llm.registry import ORACLES, QUERIES, query
from confluo.llm.secrets import secret_scan
from confluo.llm.sharding import kd_shards
from confluo.llm.syncmers import fingerprints
from confluo.llm.toxicity import toxicity_scores
from confluo.llm.vector_codes import compress_vectors
from confluo.llm.vector_codes import sql as vector_codes_sql

__all__ = ["ORACLES", "QUERIES"]


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


@query(
    "op6_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id,
           first_value(doc_id) OVER best AS keep_id,
           count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER best = 1 AS kept,
           text_sha256
    FROM d
    WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
    """,
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir))


@query("op10_syncmers")
def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_digest(encode_documents(documents(spark, sf_dir)))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_digest(pack(documents(spark, sf_dir)))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


@query("op7_kd_shards")
def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir))


@query("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))


@query("op11_vector_codes", vector_codes_sql())
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
