"""Pairs of ids that share items: they meet in the lists of the items' ids, never in a product of all ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import guarded_ratio
from tessera.session import settled

#: A task counts about so many pairs; a list of ids that meet through an item has so many at most, longer ones go in pieces.
PAIRS, LIST = 2_000_000, 4096


def edges_of(df: DataFrame, id: str, item: str) -> DataFrame:
    """Distinct (id, item) as strings or as they are, nulls left out."""
    return df.select(F.col(id).alias("id"), F.col(item).alias("item")).na.drop().distinct()


def item_lists(rows: DataFrame, item: str, *columns: str) -> DataFrame:
    """The columns, of which the first is an id, as arrays: for each item one row, in order of the ids. Items of one id are left out."""
    grouped = rows.repartition(item).groupBy(item).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("l")).filter(F.size("l") > 1)
    return settled(grouped.select(*[F.col("l")[c].alias(c) for c in columns]), "lists")


def tasks_for(spark: SparkSession, pairs: int) -> int:
    """Enough tasks that each counts ``PAIRS`` pairs at most, as far as they fall evenly; small inputs keep the partitions of shuffles."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-pairs // PAIRS), min(usual, -(-pairs // 100_000)))


def met_in_lists(lists: DataFrame, id: str, *carried: str) -> tuple[DataFrame, int]:
    """(id1, ids), and carried columns as ``<name>1`` and ``<name>s``: for each list and id the list's greater ids; and how many pairs these are in all.

    A pair is an entry of an array until it has reached the task of ``id1``, where it is met by all others of the two: no
    row of a pair crosses a shuffle. Lists longer than ``LIST`` go in pieces, every two of them together.
    """
    n = F.size(id).cast("long")
    total, longest = lists.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0)).cast("long"), F.coalesce(F.max(n), F.lit(0))).first()
    columns = [id, *carried]
    pieces = lists.withColumn("__j", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / LIST).cast("int")))).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__j"))))
    piece = lambda c, k: F.slice(c, F.col(k) * LIST + 1, F.lit(LIST))
    both = pieces.select("__i", "__j", *[piece(c, k).alias(f"{c}{k}") for c in columns for k in ("__i", "__j")])
    if longest > LIST:
        both = both.repartition(tasks_for(lists.sparkSession, total))
    each = both.select("*", F.posexplode(f"{id}__i").alias("__at", "id1"))
    after = F.when(F.col("__i") == F.col("__j"), F.col("__at") + 2).otherwise(F.lit(1))
    sent = each.select(
        "id1",
        *[F.col(f"{c}__i")[F.col("__at")].alias(f"{c}1") for c in carried],
        F.slice(f"{id}__j", after, F.lit(LIST)).alias("ids"),
        *[F.slice(f"{c}__j", after, F.lit(LIST)).alias(f"{c}s") for c in carried],
    )
    return sent.filter(F.size("ids") > 0), total


def pairs_met(lists: DataFrame, id: str, *carried: str) -> DataFrame:
    """(id1, id2), id1 < id2, and carried columns as ``<name>1`` and ``<name>2``: a row for each list that holds both, all of an id1 in one task."""
    sent, total = met_in_lists(lists, id, *carried)
    each = sent.repartition(tasks_for(lists.sparkSession, total), "id1").select("*", F.posexplode("ids").alias("__at", "id2"))
    return each.select("id1", "id2", *[x for c in carried for x in (f"{c}1", F.col(f"{c}s")[F.col("__at")].alias(f"{c}2"))])


def _sized(df: DataFrame, id: str, item: str) -> DataFrame:
    """Distinct (id, item, n), n the id's number of items; by one shuffle of the rows."""
    e = df.select(F.col(id).alias("id"), F.col(item).alias("item")).na.drop().repartition("id").distinct()
    return e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")).cast("int"))


def pair_overlap(df: DataFrame, id: str, item: str, min_shared: int = 1, max_ids_per_item: int | None = None) -> DataFrame:
    """(id1, id2, shared) of ids, id1 < id2, with at least ``min_shared`` distinct items in common.

    Only ids with so many items can qualify; the others leave before they meet. Items of more than
    ``max_ids_per_item`` ids are skipped if that is given; by default none are.
    """
    lists = item_lists(_sized(df, id, item).filter(F.col("n") >= min_shared), "item", "id")
    if max_ids_per_item is not None:
        lists = lists.filter(F.size("id") <= max_ids_per_item)
    shared = pairs_met(lists, "id").groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(F.col("shared") >= min_shared)


def jaccard_pairs(df: DataFrame, id: str, item: str, threshold: float = 0.05, max_items: int | None = 80) -> DataFrame:
    """(id1, id2, jaccard) at or above the threshold, of ids with at most ``max_items`` distinct items."""
    e = _sized(df, id, item)
    if max_items is not None:
        e = e.filter(F.col("n") <= max_items)
    met = pairs_met(item_lists(e, "item", "id", "n"), "id", "n")
    # The sizes are the same in all rows of a pair.
    shared = met.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("shared"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    ratio = F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))
    return shared.select("id1", "id2", ratio.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def minhash_signatures(df: DataFrame, id: str, item: str, n_hashes: int = 225) -> DataFrame:
    """(id, signature): per hash function the smallest hash of the id's items.

    Ids and items are shuffled, once; a signature, many times as long as both, is made where all items of its id are.
    """
    e = df.select(F.col(id).alias("id"), F.col(item).alias("item")).na.drop().repartition("id").distinct()
    least = [F.min(F.xxhash64(F.lit(i), "item")) for i in range(n_hashes)]
    return e.groupBy("id").agg(F.array(*least).alias("signature"))


def lsh_buckets(signatures: DataFrame, bands: int = 75) -> DataFrame:
    """(id, band, bucket): a bucket for each band of equally many rows of the signature."""
    n = F.size("signature")
    rows = (n / bands).cast("int")
    hashed = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("signature", b * rows + 1, rows)).alias("bucket"))
    )
    return signatures.select("id", F.inline(hashed))


def lsh_candidates(signatures: DataFrame, bands: int = 75) -> DataFrame:
    """(id1, id2), distinct, of ids that share a bucket in some band."""
    b = lsh_buckets(signatures, bands)
    left, right = b.withColumnRenamed("id", "id1"), b.withColumnRenamed("id", "id2")
    return left.join(right, ["band", "bucket"]).filter("id1 < id2").select("id1", "id2").distinct()


def rows_and_bands(threshold: float, bands: int = 75, recall: float = 0.9) -> tuple[int, int]:
    """Rows a band and number of bands at which a pair of Jaccard ``threshold`` is found with probability ``recall``."""
    if threshold <= 0:
        raise ValueError("pairs without common items share no bucket: the threshold must be above 0")
    rows = 1
    while rows < 20 and 1 - (1 - min(threshold, 1.0) ** (rows + 1)) ** bands >= recall:
        rows += 1
    while 1 - (1 - min(threshold, 1.0) ** rows) ** bands < recall:
        bands += 1
    return rows, bands


def lsh_jaccard_pairs(df: DataFrame, id: str, item: str, threshold: float = 0.05, n_hashes: int | None = None, bands: int = 75) -> DataFrame:
    """Candidates of banded MinHash, verified by their exact Jaccard similarity.

    Unless ``n_hashes`` is given, bands have as many rows as leave a pair at the threshold a probability
    of 0.9 to be found. Where even one row a band doesn't, there are more bands than ``bands``.
    """
    if n_hashes is None:
        rows, bands = rows_and_bands(threshold, bands)
        n_hashes = rows * bands
    e = settled(_sized(df, id, item), "items")
    buckets = lsh_buckets(minhash_signatures(e, "id", "item", n_hashes), bands).select("id", F.struct("band", "bucket").alias("bucket"))
    found, candidates = met_in_lists(item_lists(buckets, "bucket", "id"), "id")
    shared, meetings = met_in_lists(item_lists(e, "item", "id", "n"), "id", "n")
    if meetings > 10 * candidates:  # items of very many ids: the sets of few candidates are less than the items' pairs
        sets = e.groupBy("id").agg(F.collect_set("item").alias("items"))
        each = found.repartition(tasks_for(df.sparkSession, candidates), "id1").select("id1", F.explode("ids").alias("id2")).distinct()
        both = each.join(sets.toDF("id1", "a"), "id1").join(sets.toDF("id2", "b"), "id2")
        common = F.size(F.array_intersect("a", "b"))
        return both.select("id1", "id2", (common / (F.size("a") + F.size("b") - common)).alias("jaccard")).filter(F.col("jaccard") >= threshold)
    # Overlaps are counted as those who share a bucket are found, at the task of the smaller id: no set travels to a candidate.
    sent = found.withColumn("shared", F.lit(0)).unionByName(shared.withColumn("shared", F.lit(1)), allowMissingColumns=True).repartition(tasks_for(df.sparkSession, candidates + meetings), "id1")
    each = sent.select("id1", "n1", "shared", "ns", F.posexplode("ids").alias("at", "id2")).withColumn("n2", F.col("ns")[F.col("at")])
    sums = [F.sum("shared").alias("shared"), F.min("shared").alias("least"), F.max("n1").alias("n1"), F.max("n2").alias("n2")]
    both = each.groupBy("id1", "id2").agg(*sums).filter("least = 0")
    ratio = F.col("shared") / (F.col("n1") + F.col("n2") - F.col("shared"))
    return both.select("id1", "id2", ratio.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def pearson_pairs(ratings: DataFrame, id: str, other: str, rating: str, min_common: int = 3, min_similarity: float | None = 0.0) -> DataFrame:
    """(id1, id2, common, sim): Pearson correlation over what both rated, of pairs with ``min_common`` such at least.

    Several ratings of one thing by one id count as their mean. A constant side gives -1. Pairs at or
    below ``min_similarity`` are left out unless it is None.
    """
    one = ratings.groupBy(F.col(id).alias("id"), F.col(other).alias("other")).agg(F.avg(F.col(rating)).alias("r"))
    joined = pairs_met(item_lists(one.filter("id IS NOT NULL AND other IS NOT NULL"), "other", "id", "r"), "id", "r").withColumnsRenamed({"r1": "x", "r2": "y"})
    sums = joined.groupBy("id1", "id2").agg(
        F.count(F.lit(1)).alias("common"),
        F.sum("x").alias("sx"),
        F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
    )
    n = F.col("common")
    enough = sums.filter(n >= min_common)
    # Rounding takes away what floating point leaves of a variance that is zero.
    vx = F.round(F.col("sxx") - F.col("sx") * F.col("sx") / n, 9)
    vy = F.round(F.col("syy") - F.col("sy") * F.col("sy") / n, 9)
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    sim = guarded_ratio(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    out = enough.select("id1", "id2", "common", sim.alias("sim"))
    return out if min_similarity is None else out.filter(F.col("sim") > min_similarity)
