"""The corpus queries: every operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from millrace.llm import decontamination, embedding_dedup, language_id, license_digest, packing, secret_scan, simhash, token_files, url_filters, warc

Query = Callable[[SparkSession, str], DataFrame]


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(spark, _table(spark, sf_dir, "documents"), _tokenizer())


def op2_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan(spark, _table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), _tokenizer())


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(spark, _table(spark, sf_dir, "embeddings"))


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(spark, _table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(spark, _table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    ops = (op1_token_files, op2_license_digest, op3_best_fit_packing, op4_embedding_dedup, op5_warc_zstd, op6_url_filters, op7_language_id, op8_secret_scan, op9_decontamination, op10_simhash_gray)
    return {**{f.__name__: f for f in ops}, "pipeline": corpus_pipeline.run}


_WARC_SQL = """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END record_type, CASE WHEN again THEN largest END refers_to
FROM (SELECT *, payload_bytes >= 1000 AND page_id <> largest again
    FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) payload_bytes, sha1(coalesce(html, '')) payload_digest,
        max(page_id) OVER (PARTITION BY coalesce(html, '')) largest FROM pages))"""


def oracle_sql() -> dict[str, str]:
    sql = {"op2_license_digest": license_digest.sql(), "op5_warc_zstd": _WARC_SQL, "op6_url_filters": url_filters.sql()}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
