"""Frequent itemsets: level-wise over joins, and in two stages over partitions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bucket
from tessera.operators.relational import small
from tessera.session import cut


def baskets(df: DataFrame, key: str, item: str, more_than: int = 0) -> DataFrame:
    """(key, items): sorted distinct items of each key as strings, of keys with more than so many."""
    grouped = df.select(F.col(key).alias("key"), F.col(item).cast("string").alias("item")).na.drop()
    made = grouped.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return made.filter(F.size("items") > more_than)


def _long(basket_table: DataFrame) -> DataFrame:
    return basket_table.select("key", F.explode("items").alias("item"))


def frequent_itemsets(basket_table: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """(items, size, support) of all itemsets in ``support`` baskets at least.

    Level k joins the itemsets of level k-1 that a basket holds and that agree in all but their last
    item; only those whose other subsets are frequent as well are counted. Each level's frequent
    itemsets are checkpointed and the loop ends at the first level without any.
    """
    rows = _long(basket_table)
    level = cut(rows.groupBy(F.array("item").alias("items")).agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= support))
    held = rows.select("key", F.array("item").alias("items")).join(level, "items", "left_semi")
    found, k = level, 1
    while (max_size is None or k < max_size) and not level.isEmpty():
        k += 1
        stem = F.slice("items", 1, k - 2) if k > 2 else F.array().cast("array<string>")
        last = F.element_at("items", k - 1)
        parts = held.select("key", stem.alias("stem"), last.alias("last"))
        left, right = parts.withColumnRenamed("last", "a"), parts.withColumnRenamed("last", "b")
        held = left.join(right, ["key", "stem"]).filter("a < b").select("key", F.concat("stem", F.array("a", "b")).alias("items"))
        if k > 2:
            held = _with_frequent_subsets(held, level, k)
        level = cut(held.groupBy("items").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= support))
        held = cut(held.join(level, "items", "left_semi"))
        found = found.unionByName(level)
    return found.select("items", F.size("items").alias("size"), "support")


def _with_frequent_subsets(held: DataFrame, level: DataFrame, k: int) -> DataFrame:
    """Rows whose itemset's subsets without one of the first k-2 items are frequent; the other two are by construction."""
    out = held
    for i in range(1, k - 1):
        subset = F.concat(F.slice("items", 1, i - 1), F.slice("items", i + 1, k - i)) if i > 1 else F.slice("items", 2, k - 1)
        out = out.withColumn("__s", subset).join(level.select(F.col("items").alias("__s")), "__s", "left_semi").drop("__s")
    return out


def hashed_pair_candidates(basket_table: DataFrame, support: int, buckets: int = 1000) -> DataFrame:
    """(a, b): pairs of frequent items in a hash bucket of pairs that is itself frequent; a superset of the frequent pairs."""
    rows = _long(basket_table)
    good = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("item")
    kept = rows.join(good, "item", "left_semi")
    left, right = kept.select("key", F.col("item").alias("a")), kept.select("key", F.col("item").alias("b"))
    pairs = left.join(right, "key").filter("a < b").select("a", "b").withColumn("bucket", bucket(buckets, "a", "b"))
    full = pairs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support).select("bucket")
    return pairs.join(full, "bucket", "left_semi").select("a", "b").distinct()


def combinations_of(items: str, k: int):
    """All k-combinations of a sorted array column as arrays, in order: nested higher-order functions, no Python."""
    out = F.array(F.array().cast("array<string>"))
    for _ in range(k):
        out = F.flatten(
            F.transform(
                out,
                lambda c: F.transform(
                    F.filter(F.col(items), lambda x: (F.size(c) == 0) | (x > F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit("")))),
                    lambda x: F.concat(c, F.array(x)),
                ),
            )
        )
    return out


def mine_list(basket_list: Iterable[list[str]], support: int | Callable[[], int]) -> list[tuple[str, ...]]:
    """All frequent itemsets of the baskets, by size and then in order. ``support`` may be a function that is called when all are read.

    Each item's baskets are kept as an array of their numbers; itemsets that agree in all but their last
    item are joined by intersecting their arrays, so no basket is looked at again.
    """
    held: dict[str, list[int]] = {}
    for i, b in enumerate(basket_list):
        for x in dict.fromkeys(b):
            held.setdefault(x, []).append(i)
    if callable(support):
        support = support()
    level = [((x,), np.array(at, np.int32)) for x, at in sorted(held.items()) if len(at) >= support]
    held.clear()
    out = [c for c, _ in level]
    while level:
        new = []
        for i, (c, at) in enumerate(level):
            for d, more in level[i + 1 :]:
                if c[:-1] != d[:-1]:
                    break
                both = np.intersect1d(at, more, assume_unique=True)
                if len(both) >= support:
                    new.append((c + d[-1:], both))
        level = new
        out += [c for c, _ in level]
    return out


def son_itemsets(basket_table: DataFrame, support: int, partitions: int | None = None) -> DataFrame:
    """(items, size, support): candidates mined in each partition at its share of the support, then counted over all baskets.

    A partition without any candidate gives no row. ``partitions`` is that of shuffles if not given.
    """
    spark = basket_table.sparkSession
    shared = cut(basket_table.select("items").repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    total = shared.count()

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def each() -> Iterator[list[str]]:
            nonlocal n
            for b in batches:
                n += b.num_rows
                yield from b.column("items").to_pylist()

        # The share is known when the partition has been read.
        found = mine_list(each(), lambda: math.ceil(support * n / max(1, total)))
        for at in range(0, len(found), 10_000):
            yield pa.record_batch([pa.array(found[at : at + 10_000], pa.list_(pa.string()))], names=["items"])

    candidates = small(cut(shared.mapInArrow(mine, "items array<string>").distinct().withColumn("first", F.element_at("items", 1))))
    # A candidate meets the baskets that hold its first item.
    met = shared.select("items", F.explode("items").alias("first")).withColumnRenamed("items", "basket").join(candidates, "first")
    inside = met.filter(F.size(F.array_except("items", "basket")) == 0)
    counted = inside.groupBy("items").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= support)
    return counted.select("items", F.size("items").alias("size"), "support")
