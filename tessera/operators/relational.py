"""Counting, ranking, joining and set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, seeded_draw, words
from tessera.session import settled

#: A side of a join is broadcast only up to so many rows, counted first.
BROADCAST_ROWS = 100_000


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def matching_count(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("n"))


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.countDistinct(column).alias("n"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys; of equally frequent ones the larger comes first."""
    return count_by(df, key).orderBy(F.desc("n"), F.desc(key)).limit(k)


def top_means(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k keys of the largest mean; of equal ones the smaller comes first."""
    means = df.groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"))
    return means.orderBy(F.desc("mean"), key).limit(k)


def word_counts(docs: DataFrame, text: str = "text", stop_words: DataFrame | None = None) -> DataFrame:
    """(word, n) without stop words; these are a table (word) or the built-in list, with the empty word."""
    each = docs.select(F.explode(words(text)).alias("word"))
    if stop_words is None:
        kept = each.filter(~F.col("word").isin("", *STOP_WORDS))
    else:
        kept = each.filter("word <> ''").join(stop_words, "word", "left_anti")
    return count_by(kept, "word")


def top_words(docs: DataFrame, k: int, text: str = "text", stop_words: DataFrame | None = None) -> DataFrame:
    return word_counts(docs, text, stop_words).orderBy(F.desc("n"), F.desc("word")).limit(k)


def frequent_keys(df: DataFrame, key: str, n: int, strict: bool = True) -> DataFrame:
    """Keys of more than n rows, or of n at least if not strict."""
    counted = count_by(df, key)
    return counted.filter(F.col("n") > n if strict else F.col("n") >= n)


def partition_row_counts(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """(partition, n): rows of each of n partitions after partitioning by the keys; empty ones have 0."""
    spread = df.repartition(n, *[F.col(k) for k in keys]) if keys else df.repartition(n)
    counted = spread.groupBy(F.spark_partition_id().cast("long").alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n).select(F.col("id").alias("partition"))
    return every.join(counted, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n"))


def having(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def holding(df: DataFrame, column: str) -> DataFrame:
    """Rows that have a value in the column: records of one kind in a table of several."""
    return df.filter(F.col(column).isNotNull())


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows with the key's value; the filter is pushed down to the files."""
    return df.filter(F.col(key) == F.lit(value))


def group_to_map(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, map) from key to value, in order of the keys; of several values of a key the largest counts. Null keys are left out.

    One value for each key is settled by an aggregation before the groups are put together.
    """
    one = df.filter(F.col(key).isNotNull()).groupBy(F.col(group).alias("group"), F.col(key).alias("k")).agg(F.max(value).alias("v"))
    return one.groupBy("group").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("map"))


def lacking(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key doesn't occur in ``ids``."""
    return df.join(ids.select(key), key, "left_anti")


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``df`` with ``value`` looked up by key, ``default`` where there is none."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"))


def mean_of_means(df: DataFrame, key: str, value: str) -> DataFrame:
    """The mean of the groups' means, each group counting once."""
    return mean_by(df, key, value).agg(F.avg("mean").alias("mean"))


def encoded(df: DataFrame, column: str) -> DataFrame:
    """(value, code): dense numbers from 0 in the order of the values.

    Counted by ranges: values are sorted in partitions, and each partition starts from what those
    before it hold, so that no task sees them all.
    """
    values = df.select(F.col(column).alias("value")).distinct()
    parted = values.repartitionByRange("value").select("value", F.spark_partition_id().alias("part"))
    local = parted.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1)
    fixed = settled(local, "codes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = fixed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    return fixed.join(starts, "part").select("value", (F.col("first") + F.col("local")).cast("long").alias("code"))


def in_row_sets(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with the intersection, union and difference of two array columns, sorted, and whether they overlap."""
    return df.withColumns(
        {
            "both": F.array_sort(F.array_intersect(a, b)),
            "either": F.array_sort(F.array_union(a, b)),
            "only": F.array_sort(F.array_except(a, b)),
            "overlap": F.arrays_overlap(a, b),
        }
    )


def stacked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def sampled(df: DataFrame, fraction: float, seed: int, *keys: str) -> DataFrame:
    """Rows drawn each with the same probability, by hash of the keys: the same rows on every run and layout."""
    return df.filter(seeded_draw(seed, *keys) < fraction)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in an order; Spark limits groups before it shuffles them."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
