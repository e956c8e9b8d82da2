"""One query per operator of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import chat, crossparse, exactdedup, langid, media, mixing, neardup, packing, pii, secrets
from tessera.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprints(media.render_wav(table(spark, sf_dir, "embeddings")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op5_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.cross_parse_scores(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("path", "row")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_media_fingerprints": op2_media_fingerprints,
        "op3_source_mixing": op3_source_mixing,
        "op4_pii_spans": op4_pii_spans,
        "op5_cross_parse": op5_cross_parse,
        "op6_secret_scan": op6_secret_scan,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_chat_format": op8_chat_format,
        "op9_simhash_golay": op9_simhash_golay,
        "op10_language_id": op10_language_id,
    }


OP7_SQL = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
       text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id, source, lang, n_chars) > 1 AS is_duplicate,
       sha256(text) AS digest
FROM documents
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": OP7_SQL, "op8_chat_format": chat.FORMAT_SQL}
