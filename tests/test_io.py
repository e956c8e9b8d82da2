import json
import struct

import xxhash
from pyspark.sql import functions as F

from tessera.operators import pairs, relational
from tessera.sources import readers, writers


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id":"u","business_id":"b","stars":4,"date":"2015-01-02","text":"Hi","extra":1}\n{"user_id":"v"}\n')
    rows = readers.json_lines(spark, str(tmp_path / "r.json"), readers.REVIEW).orderBy("user_id").collect()
    assert rows[0].stars == 4.0 and rows[1].text is None
    (tmp_path / "e.csv").write_text("user_id,business_id\nu,b\n")
    assert readers.csv_with_header(spark, str(tmp_path / "e.csv")).collect() == [("u", "b")]
    (tmp_path / "stop").write_text("the\na\n")
    assert {r.word for r in readers.stop_words(spark, str(tmp_path / "stop")).collect()} == {"the", "a", ""}
    (tmp_path / "labels.json").write_text('{"1": 0, "2": -1}')
    assert sorted(readers.label_map(spark, str(tmp_path / "labels.json")).collect()) == [(1, 0), (2, -1)]
    (tmp_path / "m.json").write_text('{"b1":"y","b2":"x","sim":0.5}\n')
    assert readers.pair_model(spark, str(tmp_path / "m.json")).collect() == [("x", "y", 0.5)]


def test_writers(spark, tmp_path):
    counts = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    obj = json.loads(writers.result_object(spark, {"A": 3, "D": counts}).first()[0])
    assert obj == {"A": 3, "D": [["b", "2"], ["a", "1"]]}
    sets = spark.createDataFrame([(["b"], 1), (["a"], 1), (["a", "b"], 2)], "items array<string>, size int")
    lines = ["('a'),('b')", "", "('a', 'b')", ""]
    assert [r.line for r in writers.itemset_report(sets).collect()] == ["Candidates:", *lines, "Frequent Itemsets:", *lines]
    more = sets.union(spark.createDataFrame([(["c"], 1), (["a", "b", "c"], 3)], sets.schema))
    assert [r.line for r in writers.itemset_report(sets, more).collect()] == ["Candidates:", "('a'),('b'),('c')", *lines[1:], "('a', 'b', 'c')", "", "Frequent Itemsets:", *lines]
    assert [r.line for r in writers.itemset_report(sets.limit(0)).collect()] == ["Candidates:", "Frequent Itemsets:"]
    groups = spark.createDataFrame([(["c", "b"],), (["a"],)], "members array<string>")
    assert [r.value for r in writers.community_lines(groups).collect()] == ["'a'", "'b', 'c'"]
    scores = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5)], "a string, b string, betweenness double")
    assert [r.value for r in writers.betweenness_lines(scores).collect()] == ["('a', 'c'), 2.5", "('a', 'b'), 1.0"]
    marks = spark.createDataFrame([(10, 1), (9, -1)], "point_id long, cluster_id int")
    assert writers.label_map(marks).first()[0] == '{"9":-1,"10":1}'
    many = spark.range(1000).select(F.col("id").alias("point_id"), (F.col("id") % 7 - 1).cast("int").alias("cluster_id"))
    for table, want in ((many, {str(i): i % 7 - 1 for i in range(1000)}), (many.union(many), {str(i): i % 7 - 1 for i in range(1000)}), (many.limit(0), {}), (many.limit(1), {"0": -1})):
        assert json.loads("".join(r.value for r in writers.label_lines(table).collect())) == want
    writers.ordered_text(many.select("point_id", F.col("point_id").cast("string").alias("v")).orderBy(F.rand(1)), str(tmp_path / "t"), "point_id", partitions=5)
    files = sorted((tmp_path / "t").glob("part-*"))
    assert len(files) == 5 and [int(x) for f in files for x in f.read_text().split()] == list(range(1000))
    writers.json_lines(counts, str(tmp_path / "j"))
    writers.csv_with_header(counts, str(tmp_path / "c"))
    writers.parquet(counts, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == readers.profiles(spark, str(tmp_path / "p")).count() == 2


def test_partitions_hold_all_rows_and_keys_together(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 37)
    assert sum(r.n for r in relational.partition_row_counts(df, 8, "k").collect()) == 1000
    placed = df.repartition(8, "k").withColumn("p", F.spark_partition_id()).select("k", "p").distinct().collect()
    assert len(placed) == 37


def test_lsh_recall(spark):
    import random

    random.seed(5)
    base = [[random.randrange(400) for _ in range(20)] for _ in range(15)]
    rows = [(f"u{i}{j}", x) for i, b in enumerate(base) for j in range(3) for x in (b if j == 0 else random.sample(b, 16))]
    df = spark.createDataFrame(rows, "u string, x int")
    exact = {(r.id1, r.id2) for r in pairs.jaccard_pairs(df, "u", "x", 0.5, None).collect()}
    found = {(r.id1, r.id2) for r in pairs.lsh_jaccard_pairs(df, "u", "x", 0.5).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact) > 0


def test_pearson_of_a_constant_side(spark):
    df = spark.createDataFrame([("a", i, 3.0) for i in range(3)] + [("b", i, float(i)) for i in range(3)] + [("c", i, 2.0 * i) for i in range(3)], "u string, i int, r double")
    got = {(r.id1, r.id2): round(r.sim, 9) for r in pairs.pearson_pairs(df, "u", "i", "r", 3, None).collect()}
    assert got == {("a", "b"): -1.0, ("a", "c"): -1.0, ("b", "c"): 1.0}


def test_rows_and_bands_reach_the_recall_at_the_threshold():
    for threshold in [0.01, 0.05, 0.1, 0.3, 0.5, 0.8, 1.0]:
        rows, bands = pairs.rows_and_bands(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9


def test_lsh_recall_at_the_registered_threshold(spark):
    from tessera.plans import catalogue

    ratings = catalogue._ratings(spark, "/root/testdata/sf0.001", "l_partkey")
    want = {(r.id1, r.id2) for r in pairs.jaccard_pairs(ratings, "user", "item", catalogue.JACCARD, None).collect()}
    found = {(r.id1, r.id2) for r in catalogue.lsh_jaccard_pairs(spark, "/root/testdata/sf0.001").collect()}
    assert len(want) > 1000 and found <= want
    assert len(found) >= 0.9 * len(want)


def test_mixed_records_come_apart_by_their_keys(spark, tmp_path):
    lines = ['{"item": "a", "profile": [1, 2]}', '{"user": "u", "norm": 2.5, "profile": {"3": 0.5}}', "", '{"item": null, "user": "v", "norm": 1}', '{"other": 1}', '{"item": "b", "user": "w"}']
    (tmp_path / "m.json").write_text("\n".join(lines))
    parts = readers.mixed_records(spark, str(tmp_path / "m.json"), {"item": "item string, profile array<int>", "user": "user string, norm double"})
    assert sorted(map(tuple, parts["item"].collect()), key=str) == [("a", [1, 2]), ("b", None)]
    assert sorted(map(tuple, parts["user"].collect())) == [("u", 2.5), ("v", 1.0), ("w", None)]
    table = spark.createDataFrame([("a", None), (None, "u"), ("b", "w")], "item string, user string")
    assert sorted(r.item for r in relational.holding(table, "item").collect()) == ["a", "b"]
    assert [r.user for r in relational.lookup(table, "item", "b").collect()] == ["w"]


def test_groups_become_maps_with_the_largest_value_of_a_key(spark):
    df = spark.createDataFrame([("u", "b", 1.0), ("u", "a", 2.0), ("u", "b", 3.0), ("u", "b", 2.0), ("v", None, 1.0), ("v", "c", None)], "g string, k string, v double")
    got = {r.group: list(r.map.items()) for r in relational.group_to_map(df, "g", "k", "v").collect()}
    assert got == {"u": [("a", 2.0), ("b", 3.0)], "v": [("c", None)]}


def test_sample_is_drawn_by_hash(spark):
    """The draw by another implementation of the hash: the same rows, about the share asked for, and no row twice."""
    n, fraction, seed = 20_000, 0.3, 10
    chained = lambda i: xxhash.xxh64_intdigest(struct.pack("<q", i), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42))
    want = [i for i in range(n) if (chained(i) % (1 << 30)) / (1 << 30) < fraction]
    got = [r.id for r in relational.sampled(spark.range(n), fraction, seed, "id").orderBy("id").collect()]
    assert got == want and abs(len(got) - fraction * n) < 4 * (n * fraction * (1 - fraction)) ** 0.5
    assert relational.sampled(spark.range(n), 0.0, seed, "id").count() == 0 and relational.sampled(spark.range(n), 1.0, seed, "id").count() == n


def test_minhash_signatures_by_brute_force(spark):
    rows = [(u, i) for u in range(12) for i in range(u, 40, u % 5 + 1)] + [(0, 0), (None, 3), (3, None)]
    df = spark.createDataFrame(rows, "u int, i int")
    chained = lambda k, i: xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(struct.pack("<i", k), 42))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r.id: list(r.signature) for r in pairs.minhash_signatures(df, "u", "i", 20).collect()}
    want = {u: [min(signed(chained(k, i)) for v, i in rows if v == u and i is not None) for k in range(20)] for u in range(12)}
    assert got == want
    signatures = pairs.minhash_signatures(df, "u", "i", 20)
    buckets = {(r.id, r.band): r.bucket for r in pairs.lsh_buckets(signatures, 5).collect()}
    assert len(buckets) == 60
    alike = {(a, b) for a in range(12) for b in range(12) if a < b and any(want[a][4 * k : 4 * k + 4] == want[b][4 * k : 4 * k + 4] for k in range(5))}
    assert {(r.id1, r.id2) for r in pairs.lsh_candidates(signatures, 5).collect()} == alike
    assert all((buckets[a, k] == buckets[b, k]) == (want[a][4 * k : 4 * k + 4] == want[b][4 * k : 4 * k + 4]) for a in range(12) for b in range(12) for k in range(5))


def test_partitions_are_those_of_the_hash(spark):
    df = spark.range(3000).withColumn("k", F.col("id") % 37)
    want = {r.p: r.n for r in df.groupBy(F.pmod(F.hash("k"), F.lit(8)).alias("p")).agg(F.count("*").alias("n")).collect()}
    assert {r.partition: r.n for r in relational.partition_row_counts(df, 8, "k").collect()} == {p: want.get(p, 0) for p in range(8)}
