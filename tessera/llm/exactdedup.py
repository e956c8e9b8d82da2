"""Exact deduplication as a stateful stream.

The stream carries digests and content locators, never texts. Its state, kept in RocksDB on disk
and never expired, holds for each digest the stable identifier and the locator of the content seen
first, and how often it was seen. A row whose digest was seen before is a hit: the content that came
first is fetched by its locator, be it of this call or an earlier one, and the full bytes of the two
are compared, so that a collision of digests never makes two contents one. Contents that collide with
another's digest are noted beside the state with their own locators.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import DOCUMENT_COLUMNS, document_columns, documents_only
from tessera.session import cut, fresh_path, settled

#: Rows of locators up to which they are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 100_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _located(docs: DataFrame) -> DataFrame:
    """The columns of documents with ``__loc``, where the content lies: file and row. Rows that aren't read from files are written first."""
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))

    def placed(df: DataFrame) -> DataFrame:
        return df.select(*document_columns(df), place.alias("__loc"))

    if "_metadata" not in docs.columns:
        try:
            return placed(docs)
        except AnalysisException:
            pass  # not read from Parquet files
    return placed(settled(documents_only(docs), "contents"))


def seen_digests(keys: DataFrame, at: str) -> DataFrame:
    """(digest, first, n) of the digests of ``keys`` (digest, doc_id, loc), as the stream's state has them after these keys.

    ``first`` is the struct (at, doc_id, loc) of the row that holds the digest: of the earliest
    micro-batch, there of the smallest doc_id, then of the smallest locator. ``at`` is a folder
    that keeps the stream's keys, checkpoint and output from one call to the next; a further call
    with the same folder goes on from the digests that it knows. All rows of a call form one
    micro-batch.
    """
    spark, batches = keys.sparkSession, []
    keys.write.mode("append").parquet(f"{at}/keys")
    own = spark.newSession()  # the state store's settings concern this query alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "128")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.compactOnCommit", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = own.readStream.schema(keys.schema).parquet(f"{at}/keys")
    held = (
        stream.withColumn("at", F.current_timestamp())
        .groupBy("digest")
        .agg(F.min(F.struct("at", "doc_id", "loc")).alias("first"), F.count(F.lit(1)).alias("n"))
    )

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure overwrites what it wrote before.
        batch.write.mode("overwrite").parquet(f"{at}/held/batch={number}")
        batches.append(number)

    query = (
        held.writeStream.outputMode("update")
        .option("checkpointLocation", f"{at}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = "digest binary, first struct<at: timestamp, doc_id: bigint, loc: struct<path: string, row: bigint>>, n bigint"
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{at}/held/batch={max(batches)}")


def _exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _fetched(places: DataFrame) -> DataFrame:
    """``places`` (digest, doc_id, loc) with ``there``, the text that lies at each locator."""
    spark = places.sparkSession
    files = [unquote(r["path"]) for r in places.select("loc.path").distinct().collect()]  # a row per file
    if not files:
        return places.withColumn("there", F.lit(None).cast("string"))
    texts = spark.read.schema("text string").parquet(*files).select(
        F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row")).alias("loc"), F.col("text").alias("there")
    )
    return texts.join(_small(places), "loc")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _judged(located: DataFrame, digest: Callable[[Column], Column], state: str | None) -> DataFrame:
    """(loc, doc_id, keep_id, is_duplicate, digest) of the rows that have a text, each verified by bytes."""
    spark = located.sparkSession
    at = state or fresh_path(spark, "seen")
    rows = located.filter(F.col("text").isNotNull()).withColumn("digest", digest(F.col("text")).cast("binary"))
    keys = rows.select("digest", "doc_id", F.col("__loc").alias("loc"))
    seen = seen_digests(keys, at)
    several = seen.filter("n > 1").select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.loc").alias("first_loc"))
    # Digest and locator decide; what the bytes say otherwise is put right below.
    told = keys.join(seen.select("digest", "first"), "digest").select(
        "loc", "doc_id", F.col("first.doc_id").alias("keep_id"), (F.col("loc") != F.col("first.loc")).alias("is_duplicate"), "digest"
    )
    hits = settled(rows.join(_small(several), "digest").select("digest", "doc_id", F.col("__loc").alias("loc"), "first_id", "first_loc", "text"), "hits")
    here = hits.filter(F.col("loc") == F.col("first_loc")).select("digest", F.col("text").alias("there"))
    # What came first in an earlier call is fetched by its locator.
    away = cut(several.join(hits.filter(F.col("loc") == F.col("first_loc")).select("digest"), "digest", "left_anti"))
    firsts = here.unionByName(_fetched(away.select("digest", F.col("first_id").alias("doc_id"), F.col("first_loc").alias("loc"))).select("digest", "there"))
    # Copies of a hot text may be a third of all rows: one row of it meets them in as many tasks as the join splits them into.
    odd = settled(hits.filter(F.col("loc") != F.col("first_loc")).join(firsts, "digest").filter(F.col("text") != F.col("there")).drop("there"), "odd")
    if odd.isEmpty():
        return told
    # Digests of several contents. Those of earlier calls are noted with their locators.
    noted = spark.createDataFrame([], "digest binary, doc_id long, loc struct<path: string, row: bigint>")
    if _exists(spark, f"{at}/others"):
        noted = spark.read.schema(noted.schema).parquet(f"{at}/others").join(odd.select("digest").distinct(), "digest", "left_semi")
    known = _fetched(cut(noted)).select("digest", F.col("there").alias("text"), F.col("doc_id").alias("known_id"), F.col("loc").alias("known_loc"))
    same = Window.partitionBy("digest", "text").orderBy("doc_id", "loc")
    ranked = odd.join(known, ["digest", "text"], "left").withColumn("rank", F.row_number().over(same)).withColumn("new_id", F.first("doc_id").over(same))
    new = F.col("known_loc").isNull()
    right = settled(
        ranked.select("loc", "digest", "doc_id", F.when(new, F.col("new_id")).otherwise(F.col("known_id")).alias("right_id"), F.when(new, F.col("rank") > 1).otherwise(F.col("known_loc") != F.col("loc")).alias("right_dup"), new.alias("new")),
        "right",
    )
    right.filter("new and not right_dup").select("digest", "doc_id", "loc").write.mode("append").parquet(f"{at}/others")
    joined = told.join(_small(right.select("loc", "right_id", "right_dup")), "loc", "left")
    changed = F.col("right_dup").isNotNull()
    return joined.select(
        "loc", "doc_id", F.when(changed, F.col("right_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("right_dup", "is_duplicate").alias("is_duplicate"), "digest"
    )


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """(doc_id, keep_id, is_duplicate, digest, path, row), one row per row of ``docs``.

    ``keep_id`` is the smallest doc_id among the rows whose text has the same bytes, the row's own
    where no other has them; all but one of such rows are duplicates, of equal doc_ids the first by
    locator isn't. With ``state``, a folder that all executors share, what was seen in earlier calls
    with that folder counts too: their rows come first, whatever their doc_ids, and the files that
    they were read from must still be there. Rows that come again from the same file and place are
    what they were. Only doc_id, text, lang, source and n_chars are looked at; other columns are ignored
    whatever their names. A null text has no bytes: it is never a duplicate, and its digest is null. Empty
    texts are equal. Null doc_ids come first. Rows that are repeated entirely are duplicates of one
    another. Texts whose digests collide are told apart by their bytes. Texts may be of any length. An
    empty table gives no rows. ``path`` and ``row`` locate the content; rows that aren't read from
    files are written to the shared folder first.
    """
    located = _located(docs)
    nothing = located.filter(F.col("text").isNull()).select(
        F.col("__loc").alias("loc"), "doc_id", F.col("doc_id").alias("keep_id"), F.lit(False).alias("is_duplicate"), F.lit(None).cast("binary").alias("digest")
    )
    return _judged(located, digest, state).unionByName(nothing).select(
        "doc_id", "keep_id", "is_duplicate", F.lower(F.hex("digest")).alias("digest"), F.col("loc.path").alias("path"), F.col("loc.row").alias("row")
    )


def drop_exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with the five columns of documents.

    What holds there of nulls, empty and long texts, repeated rows, ties, columns and empty tables
    holds here. Only the locators of the rows that go meet the texts.
    """
    located = _located(docs)
    gone = settled(_judged(located, digest, state).filter("is_duplicate").select(F.col("loc").alias("__loc")), "gone")
    return located.join(_small(gone), "__loc", "left_anti").select(*DOCUMENT_COLUMNS)
