"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_FIELDS = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
]
DOCUMENT_COLUMNS = [f.name for f in DOCUMENT_FIELDS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_columns(docs: DataFrame) -> list[Column]:
    have = set(docs.columns)
    return [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in DOCUMENT_FIELDS]


def documents_only(docs: DataFrame) -> DataFrame:
    """The five columns of documents, in order and type; columns that are missing are null, others are left out."""
    return docs.select(*document_columns(docs))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that few texts are Python strings at a time; what they took is given back after the last."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
