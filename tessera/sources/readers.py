"""Readers with explicit schemas: nothing is inferred, and only the columns asked for are parsed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW = "user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, state string, categories string"
USER_ITEM = "user_id string, business_id string"


def json_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """One JSON object a line; keys outside the schema are ignored, missing ones null. ``partitions`` spreads the rows."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def csv_with_header(spark: SparkSession, path: str, schema: str = USER_ITEM) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(point_id, features) of headerless lines "id,x1,..,xd"."""
    cells = F.split("value", ",")
    rest = F.slice(cells, 2, F.size(cells) - 1)
    return spark.read.text(path).filter("trim(value) <> ''").select(
        cells[0].cast("double").cast("long").alias("point_id"), F.transform(rest, lambda x: F.trim(x).cast("double")).alias("features")
    )


def chunk_files(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder in order of their names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def folders(spark: SparkSession, folder: str) -> list[str]:
    """The folders in a folder, none where it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def mixed_records(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a file of JSON lines of several kinds: by key, the records that have it, in the key's schema.

    A record with several of the keys is in several tables, one with none in none. A key whose value is null counts as absent.
    """
    every = spark.read.text(path).filter("trim(value) <> ''")
    out = {}
    for key, schema in schemas.items():
        parsed = every.select(F.from_json("value", schema).alias("r")).select("r.*")
        out[key] = parsed.filter(F.col(key).isNotNull())
    return out


def point_chunks(spark: SparkSession, folder: str) -> Iterator[DataFrame]:
    for path in chunk_files(spark, folder):
        yield points(spark, path)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a list with one word a line, and the empty word."""
    return spark.read.text(path).select(F.col("value").alias("word")).union(spark.createDataFrame([("",)], "word string")).distinct()


def pair_model(spark: SparkSession, path: str, left: str = "b1", right: str = "b2") -> DataFrame:
    """(id1, id2, sim) of JSON lines that hold a pair's similarity, the smaller id first."""
    df = spark.read.schema(f"{left} string, {right} string, sim double").json(path)
    return df.select(F.least(left, right).alias("id1"), F.greatest(left, right).alias("id2"), "sim")


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, label) of a file that is one JSON object from point to label."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("k", "label")).select(F.col("k").cast("long").alias("point_id"), "label")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """A content model written by :func:`tessera.sources.writers.parquet`."""
    return spark.read.parquet(path)
