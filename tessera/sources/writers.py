"""Writers. Reports that are one ordered text are made of rows that Spark sorted."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_with_header(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def result_object(spark: SparkSession, parts: Mapping[str, DataFrame | object]) -> DataFrame:
    """(value): one JSON object. A DataFrame part of one cell is that value, another the array of its rows in order."""
    out = spark.range(1).select()
    out = out.withColumn("__one", F.lit(1))
    for name, part in parts.items():
        if not isinstance(part, DataFrame):
            out = out.withColumn(name, F.lit(part))
            continue
        rows = part.withColumn("__i", F.monotonically_increasing_id())
        cells: Column = F.col(part.columns[0]) if len(part.columns) == 1 else F.array(*[F.col(c).cast("string") for c in part.columns])
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("__i", cells.alias("x")))), lambda r: r["x"])
        out = out.crossJoin(rows.agg(ordered.alias(name)))
    return out.select(F.to_json(F.struct(*parts)).alias("value"))


def _quoted(items: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit(")"))


def itemset_report(itemsets: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(n, line) of itemsets (items, size): the candidates under their title, then the frequent itemsets under theirs.

    Each size is a line and an empty line. Where no ``candidates`` are given the itemsets stand for
    them. A table without itemsets gives its title alone.
    """

    def section(table: DataFrame, title: str, at: int) -> DataFrame:
        one = table.select("size", "items", _quoted(F.col("items")).alias("shown"))
        ordered = F.sort_array(F.collect_list(F.struct("items", "shown")))
        lines = one.groupBy("size").agg(F.array_join(F.transform(ordered, lambda r: r["shown"]), ",").alias("line"))
        both = F.array(F.struct((F.col("size") * 2 - 1).alias("i"), F.col("line")), F.struct((F.col("size") * 2).alias("i"), F.lit("").alias("line")))
        head = table.sparkSession.createDataFrame([(at, title)], "n int, line string")
        return head.union(lines.select(F.inline(both)).select((F.col("i") + at).cast("int"), "line"))

    largest = (itemsets if candidates is None else candidates).agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    first = section(itemsets if candidates is None else candidates, "Candidates:", 0)
    return first.union(section(itemsets, "Frequent Itemsets:", 2 * largest + 1)).orderBy("n")


def community_lines(communities: DataFrame) -> DataFrame:
    """(value) of communities (members): members in order, communities by size and first member."""
    sorted_members = communities.select(F.sort_array("members").alias("m"))
    shown = F.array_join(F.transform("m", lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")
    return sorted_members.orderBy(F.size("m"), F.col("m")[0]).select(shown.alias("value"))


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """(value) of edges (a, b, betweenness): the largest first, then by endpoints."""
    ordered = edges.orderBy(F.desc("betweenness"), "a", "b")
    return ordered.select(F.format_string("('%s', '%s'), %s", "a", "b", F.col("betweenness").cast("string")).alias("value"))


def label_map(assignments: DataFrame) -> DataFrame:
    """(value): one JSON object from point_id to cluster_id, by point_id."""
    pairs = F.sort_array(F.collect_list(F.struct("point_id", "cluster_id")))
    entries = F.transform(pairs, lambda p: F.struct(p["point_id"].cast("string"), p["cluster_id"]))
    return assignments.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def label_lines(assignments: DataFrame) -> DataFrame:
    """(value), in order: lines that together are one JSON object from point_id to cluster_id, however many points there are.

    Of several assignments of a point the smallest counts. No points give "{}".
    """
    one = assignments.groupBy("point_id").agg(F.min("cluster_id").alias("cluster_id"))
    ends = one.agg(F.min("point_id").alias("first"), F.max("point_id").alias("last"))
    open_, shut = F.when(F.col("point_id") == F.col("first"), "{").otherwise(""), F.when(F.col("point_id") == F.col("last"), "}").otherwise(",")
    line = F.concat(open_, F.format_string('"%s": %s', F.col("point_id").cast("string"), F.col("cluster_id").cast("string")), shut)
    lines = one.crossJoin(F.broadcast(ends)).select("point_id", line.alias("value"))
    none = ends.filter("first is null").select(F.col("first").alias("point_id"), F.lit("{}").alias("value"))
    return lines.unionByName(none).orderBy("point_id").select("value")


def text(df: DataFrame, path: str) -> None:
    """One text column, in the order of the rows, as one file: for reports, whose rows are few."""
    df.select(F.col(df.columns[-1]).cast("string")).coalesce(1).write.mode("overwrite").text(path)


def ordered_text(df: DataFrame, path: str, *order: str | Column, partitions: int | None = None) -> None:
    """The last column as text in files whose names are in the rows' order: read one after the other they are sorted, and no task has them all."""
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).select(F.col(df.columns[-1]).cast("string").alias("value")).write.mode("overwrite").text(path)
