"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exactdedup, langid, mixing, neardup, packing
from tessera.session import fresh_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that resemble a language of the corpus.

    Null, empty and letterless texts leave; of repeated rows and ties all are judged alike; texts are
    read whole; columns beyond the five of documents are left out. An empty table gives no rows.
    """
    return langid.keep_known_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text, that of the smallest doc_id, of equal ones the first by place.

    A null text is never a duplicate, empty texts are equal, texts of any length are compared whole,
    and columns beyond the five are left out. An empty table gives no rows.
    """
    return exactdedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest doc_id, then of the smallest text hash.

    Null, empty and tokenless texts are near to none and stay; rows repeated with doc_id and text are
    one document and stay or go together; whole texts are compared; columns beyond the five are left
    out. An empty table gives no rows.
    """
    return neardup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws blocks of each source by the square root of its tokens; rows are the documents' parts in the drawn blocks.

    Null and empty texts have no part; a null source is "unknown"; repeated rows are as many
    documents, in the order of the rows, so there are no ties; long texts are parts of several blocks;
    columns beyond the five are left out. An empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places each part, with its end token, in a bin of 2048 tokens by best fit: (doc_id, chunk, start, length, bin, offset).

    Null and empty texts take no slot; repeated rows are placed each; parts of one length are alike
    and take its slots by a hash; longer ones are cut; other columns are left out. An empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: Language profiles, SimHash and the draw of blocks aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
