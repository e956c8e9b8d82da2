"""All queries over the driver's tables by name, with SQL that gives the same rows.

How the tables are read: a customer is a user, a supplier or part an item, a line item's quantity a
rating; an order is a basket of its parts' brands; a document's source is what its words describe;
an embedding is a point.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, categories, words, year_prefix
from tessera.operators import cluster, graph, itemsets, pairs, recommend, relational
from tessera.plans import sql as S
from tessera.session import cut, settled
from tessera.sources import writers

Query = Callable[[SparkSession, str], DataFrame]

TOP, YEAR, STATE_REGION = 20, 1995, "ASIA"
MORE_THAN, AT_LEAST = 40, 45
SUPPORT_SHARE = 0.0043
JACCARD, MAX_ITEMS = 0.05, 80
CO_EDGE = 7
K_TERMS, K_ITEMS, K_USERS = 200, 50, 200
ROUNDS = 5

_found: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _found[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ratings(spark: SparkSession, sf_dir: str, item: str = "l_suppkey") -> DataFrame:
    o, l = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("user"), F.col(item).alias("item"), F.col("l_quantity").cast("double").alias("rating"))


# Counts and rankings


@_query("SELECT count(*) AS n FROM orders")
def row_count(spark, sf_dir):
    return relational.row_count(_t(spark, sf_dir, "orders"))


@_query(f"SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = {YEAR}")
def year_count(spark, sf_dir):
    return relational.matching_count(_t(spark, sf_dir, "orders"), year_prefix(F.col("o_orderdate").cast("string")) == YEAR)


@_query("SELECT count(DISTINCT o_custkey) AS n FROM orders")
def distinct_users(spark, sf_dir):
    return relational.distinct_count(_t(spark, sf_dir, "orders"), "o_custkey")


@_query(f"SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey DESC LIMIT {TOP}")
def top_users(spark, sf_dir):
    return relational.top_counts(_t(spark, sf_dir, "orders"), "o_custkey", TOP)


@_query(S.words("documents", "doc_id") + f"SELECT term AS word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word DESC LIMIT {TOP}")
def top_words(spark, sf_dir):
    return relational.top_words(_t(spark, sf_dir, "documents"), TOP)


@_query(S.words("documents", "doc_id") + "SELECT term AS word, count(*) AS n FROM w GROUP BY 1")
def word_counts(spark, sf_dir):
    return relational.word_counts(_t(spark, sf_dir, "documents"))


@_query(S.words("documents", "doc_id") + "SELECT term AS word, count(*) AS n FROM w GROUP BY 1")
def word_counts_with_table(spark, sf_dir):
    """Stop words as a table to anti-join instead of a list."""
    stop = spark.createDataFrame([(w,) for w in ("", *STOP_WORDS)], "word string")
    return relational.word_counts(_t(spark, sf_dir, "documents"), stop_words=stop)


@_query(
    f"""WITH c AS (SELECT p_partkey, trim(unnest(string_split(p_name, ' '))) AS category FROM part WHERE p_name IS NOT NULL)
    SELECT category, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN c ON l_partkey = p_partkey
    GROUP BY 1 ORDER BY mean DESC, category LIMIT {TOP}"""
)
def top_categories(spark, sf_dir):
    p, l = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem")
    each = p.filter(F.col("p_name").isNotNull()).select("p_partkey", F.explode(categories(F.replace("p_name", F.lit(" "), F.lit(",")))).alias("category"))
    return relational.top_means(l.join(each, l.l_partkey == each.p_partkey), "category", "l_quantity", TOP)


@_query(f"SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > {MORE_THAN}")
def frequent_keys_above(spark, sf_dir):
    return relational.frequent_keys(_t(spark, sf_dir, "lineitem"), "l_partkey", MORE_THAN)


@_query(f"SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= {AT_LEAST}")
def frequent_keys_from(spark, sf_dir):
    return relational.frequent_keys(_t(spark, sf_dir, "lineitem"), "l_partkey", AT_LEAST, strict=False)


@_query()
def partition_row_counts(spark, sf_dir):
    return relational.partition_row_counts(_t(spark, sf_dir, "lineitem"), 8, "l_partkey")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def filtered_projection(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    return l.filter((F.col("l_quantity") >= 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber")


@_query(
    """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean
    FROM events WHERE props IS NOT NULL GROUP BY 1"""
)
def json_items(spark, sf_dir):
    """Items inside a JSON column, parsed with a schema."""
    parsed = _t(spark, sf_dir, "events").filter(F.col("props").isNotNull()).select(F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return parsed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# Joins and sets


@_query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = '{STATE_REGION}')")
def orders_of_region(spark, sf_dir):
    region = _t(spark, sf_dir, "region").filter(F.col("r_name") == STATE_REGION)
    nations = _t(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    c = _t(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return relational.having(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, "o_custkey")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.lacking(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), o, "c_custkey")


@_query(
    """WITH m AS (SELECT o_custkey, avg(o_totalprice) AS mean FROM orders GROUP BY 1)
    SELECT c_custkey, round(coalesce(m.mean, (SELECT avg(mean) FROM m)), 6) AS mean FROM customer LEFT JOIN m ON c_custkey = o_custkey"""
)
def means_with_default(spark, sf_dir):
    """A customer's mean price; the mean of all customers' means for those without orders."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    means = relational.mean_by(o, "c_custkey", "o_totalprice")
    overall = relational.mean_of_means(o, "c_custkey", "o_totalprice").withColumnRenamed("mean", "overall")
    c = _t(spark, sf_dir, "customer").select("c_custkey").crossJoin(overall)
    return relational.with_default(c, means, "c_custkey", "mean", F.col("overall")).select("c_custkey", F.round("mean", 6).alias("mean"))


@_query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def stacked_models(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return relational.stacked(c, s)


@_query(
    """WITH s AS (SELECT user_id, list_distinct(list(event_type) FILTER (value < 50)) AS a, list_distinct(list(event_type) FILTER (value >= 50)) AS b FROM events GROUP BY 1),
    t AS (SELECT user_id, coalesce(a, []) AS a, coalesce(b, []) AS b FROM s)
    SELECT user_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS "both", array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS either,
    array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS "only", len(list_intersect(a, b)) > 0 AS overlap FROM t"""
)
def in_row_sets(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(
        F.collect_set(F.when(F.col("value") < 50, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") >= 50, F.col("event_type"))).alias("b")
    )
    out = relational.in_row_sets(s, "a", "b")
    shown = [F.array_join(c, ",").alias(c) for c in ("both", "either", "only")]
    return out.select("user_id", *shown, "overlap")


@_query("SELECT p_type AS value, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT p_type FROM part)")
def dense_codes(spark, sf_dir):
    return relational.encoded(_t(spark, sf_dir, "part"), "p_type")


# Baskets and itemsets


@_query("SELECT o_custkey AS key, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), ',') AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def baskets(spark, sf_dir):
    made = itemsets.baskets(_ratings(spark, sf_dir), "user", "item")
    return made.select("key", F.array_join("items", ",").alias("items"))


@_query(f"SELECT o_custkey AS key, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS size FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) > {MORE_THAN}")
def large_baskets(spark, sf_dir):
    return itemsets.baskets(_ratings(spark, sf_dir), "user", "item", MORE_THAN).select("key", F.size("items").alias("size"))


def _brand_baskets(spark, sf_dir) -> tuple[DataFrame, int]:
    l, p = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    # Made once: they are counted first and then read by every level.
    made = settled(itemsets.baskets(l.join(p, l.l_partkey == p.p_partkey), "l_orderkey", "p_brand"), "baskets")
    return made, math.ceil(SUPPORT_SHARE * made.count())


def _flat(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("items", ",").alias("items"), F.col("size").cast("int").alias("size"), "support")


@_query(S.ITEMSETS.format(share=SUPPORT_SHARE) + "SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4")
def frequent_itemsets(spark, sf_dir):
    return _flat(itemsets.frequent_itemsets(*_brand_baskets(spark, sf_dir)))


@_query(S.ITEMSETS.format(share=SUPPORT_SHARE) + "SELECT * FROM f1 UNION ALL SELECT * FROM f2")
def frequent_pairs(spark, sf_dir):
    return _flat(itemsets.frequent_itemsets(*_brand_baskets(spark, sf_dir), max_size=2))


@_query(S.ITEMSETS.format(share=SUPPORT_SHARE) + "SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4")
def frequent_itemsets_by_partition(spark, sf_dir):
    """The same in two stages: candidates by partition, then their counts."""
    return _flat(itemsets.son_itemsets(*_brand_baskets(spark, sf_dir)))


@_query()
def hashed_pair_candidates(spark, sf_dir):
    return itemsets.hashed_pair_candidates(*_brand_baskets(spark, sf_dir))


@_query(S.ITEMSETS.format(share=SUPPORT_SHARE) + "SELECT a.item || ',' || b.item AS pair, count(*) AS n FROM b a JOIN b ON a.key = b.key AND a.item < b.item GROUP BY 1")
def basket_combinations(spark, sf_dir):
    """All pairs in each basket, made inside the row."""
    made, _ = _brand_baskets(spark, sf_dir)
    each = made.select(F.explode(itemsets.combinations_of("items", 2)).alias("c"))
    return each.groupBy(F.array_join("c", ",").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@_query()
def itemset_report(spark, sf_dir):
    return writers.itemset_report(itemsets.frequent_itemsets(*_brand_baskets(spark, sf_dir)))


# Similar pairs


@_query(
    f"""WITH e AS (SELECT DISTINCT o_custkey AS id, l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
    s AS (SELECT id, count(*) AS n FROM e GROUP BY 1 HAVING count(*) <= {MAX_ITEMS}),
    p AS (SELECT a.id AS id1, b.id AS id2, count(*) AS c FROM e a JOIN e b ON a.item = b.item AND a.id < b.id GROUP BY 1, 2)
    SELECT id1, id2, round(CAST(c AS DOUBLE) / (x.n + y.n - c), 6) AS jaccard FROM p JOIN s x ON x.id = id1 JOIN s y ON y.id = id2
    WHERE CAST(c AS DOUBLE) / (x.n + y.n - c) >= {JACCARD}"""
)
def jaccard_pairs(spark, sf_dir):
    found = pairs.jaccard_pairs(_ratings(spark, sf_dir, "l_partkey"), "user", "item", JACCARD, MAX_ITEMS)
    return found.withColumn("jaccard", F.round("jaccard", 6))


@_query()
def minhash_signatures(spark, sf_dir):
    return pairs.minhash_signatures(_ratings(spark, sf_dir, "l_partkey"), "user", "item")


@_query()
def lsh_jaccard_pairs(spark, sf_dir):
    return pairs.lsh_jaccard_pairs(_ratings(spark, sf_dir, "l_partkey"), "user", "item", JACCARD)


@_query(S.pearson("l_suppkey", "l_suppkey", "o_custkey") + "SELECT id1, id2, common, sim FROM model")
def pearson_items(spark, sf_dir):
    return _model(pairs.pearson_pairs(_ratings(spark, sf_dir), "item", "user", "rating"))


@_query(S.pearson("l_partkey", "o_custkey", "l_partkey") + "SELECT id1, id2, common, sim FROM model")
def pearson_users(spark, sf_dir):
    return _model(pairs.pearson_pairs(_ratings(spark, sf_dir, "l_partkey"), "user", "item", "rating"))


def _model(found: DataFrame) -> DataFrame:
    return found.withColumn("sim", F.round("sim", 6)).filter("sim > 0")


# Content profiles


def _counts(spark, sf_dir) -> DataFrame:
    return recommend.term_counts(_t(spark, sf_dir, "documents"), "source")


def _users(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.pmod("doc_id", F.lit(50)).alias("user"), F.col("source").alias("doc"))


@_query(S.TFIDF + "SELECT term, df FROM df")
def term_df(spark, sf_dir):
    return recommend.inverse_frequency(_counts(spark, sf_dir)).select("term", "df")


@_query(S.TFIDF + "SELECT term, round(idf, 6) AS idf FROM idf")
def term_idf(spark, sf_dir):
    return recommend.inverse_frequency(_counts(spark, sf_dir)).select("term", F.round("idf", 6).alias("idf"))


@_query(S.TFIDF + "SELECT doc, term, round(tf, 6) AS tf FROM tf")
def term_tf(spark, sf_dir):
    return recommend.term_frequency(_counts(spark, sf_dir)).withColumn("tf", F.round("tf", 6))


@_query(S.TFIDF + f"SELECT doc, term, tfidf FROM ranked WHERE r <= {K_TERMS}")
def tfidf_top_terms(spark, sf_dir):
    return recommend.top_terms(_counts(spark, sf_dir), K_TERMS)


@_query(S.PROFILES.format(k=K_TERMS) + "SELECT doc, term FROM prof")
def item_profiles(spark, sf_dir):
    return recommend.item_profiles(_counts(spark, sf_dir), K_TERMS)


def _profiles(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    items, users = recommend.item_profiles(_counts(spark, sf_dir), K_TERMS), _users(spark, sf_dir)
    return users, recommend.user_profiles(users, items), items


@_query(S.PROFILES.format(k=K_TERMS) + 'SELECT "user", term, round(weight, 6) AS weight FROM up')
def user_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir)[1].withColumn("weight", F.round("weight", 6))


@_query(S.PROFILES.format(k=K_TERMS) + 'SELECT "user", round(sqrt(sum(weight * weight)), 6) AS norm FROM up GROUP BY 1')
def profile_norms(spark, sf_dir):
    return recommend.profile_norms(_profiles(spark, sf_dir)[1]).withColumn("norm", F.round("norm", 6))


@_query(S.PROFILES.format(k=K_TERMS) + f"""SELECT d."user", d.doc, round(dot / (sqrt(CAST({K_TERMS} AS DOUBLE)) * norm), 5) AS sim
    FROM (SELECT o."user", o.doc, sum(weight) AS dot FROM own o JOIN prof p ON o.doc = p.doc JOIN up ON up."user" = o."user" AND up.term = p.term GROUP BY 1, 2) d
    JOIN (SELECT "user", sqrt(sum(weight * weight)) AS norm FROM up GROUP BY 1) n ON n."user" = d."user"
    WHERE dot / (sqrt(CAST({K_TERMS} AS DOUBLE)) * norm) >= 0.01""")
def cosine_scores(spark, sf_dir):
    return recommend.cosine_scores(*_profiles(spark, sf_dir), k=K_TERMS)


# Rating prediction


@_query("SELECT l_suppkey AS item, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def rating_means(spark, sf_dir):
    return relational.mean_by(_ratings(spark, sf_dir), "item", "rating").withColumn("mean", F.round("mean", 6))


@_query("SELECT round(avg(m), 6) AS mean FROM (SELECT avg(l_quantity) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey)")
def mean_of_means(spark, sf_dir):
    return relational.mean_of_means(_ratings(spark, sf_dir), "item", "rating").withColumn("mean", F.round("mean", 6))


def _by_items(spark, sf_dir, normalized: bool) -> DataFrame:
    ratings = settled(_ratings(spark, sf_dir), "ratings")
    found = recommend.predict_by_items(ratings, ratings, _model(pairs.pearson_pairs(ratings, "item", "user", "rating")), K_ITEMS, normalized)
    # Sums of products have six places exactly; quotients are cut off where no tie is likely.
    return found.withColumn("prediction", F.round("prediction", 4 if normalized else 6))


@_query(S.predict_items(K_ITEMS, True))
def predict_by_items(spark, sf_dir):
    """Every customer and supplier that met, predicted from the customer's other suppliers."""
    return _by_items(spark, sf_dir, True)


@_query(S.predict_items(K_ITEMS, False))
def predict_by_items_summed(spark, sf_dir):
    return _by_items(spark, sf_dir, False)


@_query(S.predict_users(K_USERS))
def predict_by_users(spark, sf_dir):
    ratings = settled(_ratings(spark, sf_dir, "l_partkey"), "ratings")
    found = recommend.predict_by_users(ratings, ratings, _model(pairs.pearson_pairs(ratings, "user", "item", "rating")), K_USERS)
    return found.withColumn("prediction", F.round("prediction", 4))


# Graphs


def _edges(spark, sf_dir) -> DataFrame:
    return cut(graph.co_occurrence_edges(_ratings(spark, sf_dir, "l_partkey"), "user", "item", CO_EDGE))


_E = S.EDGES.format(t=CO_EDGE)


@_query(_E + "SELECT src, dst FROM e")
def co_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@_query(_E + "SELECT src AS id, count(*) AS degree FROM e GROUP BY 1")
def degrees(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@_query(_E + "SELECT DISTINCT src AS id FROM e")
def vertices(spark, sf_dir):
    return graph.vertices(_edges(spark, sf_dir))


@_query(S.label_propagation(_E, ROUNDS))
def label_propagation(spark, sf_dir):
    return graph.label_propagation(_edges(spark, sf_dir), ROUNDS)


@_query(S.label_propagation(_E, ROUNDS, "SELECT array_to_string(list_sort(list(id)), ',') AS members FROM {last} GROUP BY label"))
def label_communities(spark, sf_dir):
    found = graph.communities(graph.label_propagation(_edges(spark, sf_dir), ROUNDS))
    return found.select(F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def _least(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("src").alias("id"))


@_query(_E + S.BFS + "SELECT root, id, CAST(level AS INTEGER) AS level FROM dist WHERE root = (SELECT min(src) FROM e)")
def bfs_levels(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.bfs(e, _least(e)).select("root", "id", "level")


@_query(_E + S.BFS + "SELECT root, id, CAST(level AS INTEGER) AS level, CAST(n_paths AS BIGINT) AS n_paths FROM sigma")
def bfs_paths(spark, sf_dir):
    """From every vertex."""
    e = _edges(spark, sf_dir)
    return graph.bfs(e, graph.vertices(e)).withColumn("n_paths", F.col("n_paths").cast("long"))


@_query(_E + S.BFS + S.BETWEENNESS)
def edge_betweenness(spark, sf_dir):
    return graph.edge_betweenness(_edges(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 6))


@_query(_E + S.REACH + "SELECT id, component FROM comp")
def components(spark, sf_dir):
    return graph.components(_edges(spark, sf_dir))


@_query(_E + S.REACH + S.MODULARITY)
def modularity(spark, sf_dir):
    e = _edges(spark, sf_dir)
    labels = graph.components(e).withColumnRenamed("component", "label")
    return graph.modularity(e, labels).select(F.round("modularity", 6).alias("modularity"))


@_query()
def girvan_newman(spark, sf_dir):
    return graph.girvan_newman(_edges(spark, sf_dir))[0]


@_query()
def community_lines(spark, sf_dir):
    return writers.community_lines(graph.communities(graph.label_propagation(_edges(spark, sf_dir), ROUNDS)))


# Clusters


def _points(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), "label")


@_query(S.POINTS + "SELECT dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x GROUP BY 1")
def dimension_stats(spark, sf_dir):
    found = cluster.dimension_stats(_points(spark, sf_dir))
    return found.select("dim", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@_query(S.POINTS + S.Z + "SELECT point_id, dim, round(z, 6) AS z FROM z")
def z_scores(spark, sf_dir):
    z = cluster.z_scores(_points(spark, sf_dir)).select("point_id", F.posexplode("features").alias("dim", "z"))
    return z.withColumn("z", F.round("z", 6))


@_query(S.POINTS + S.Z + "SELECT point_id FROM z GROUP BY 1 HAVING max(abs(z)) > 3")
def outliers(spark, sf_dir):
    return cluster.standardize(_points(spark, sf_dir))[1]


def _label_centroids(spark, sf_dir) -> tuple[DataFrame, list]:
    p = _points(spark, sf_dir)
    return p, cluster.centroids_of(p.withColumn("cluster_id", F.col("label").cast("int")))


@_query(S.POINTS + S.NEAREST + "SELECT point_id, cluster_id, round(distance, 6) AS distance FROM near")
def nearest_centroid(spark, sf_dir):
    p, centroids = _label_centroids(spark, sf_dir)
    return cluster.nearest(p, centroids).select("point_id", "cluster_id", F.round("distance", 6).alias("distance"))


@_query(S.POINTS + S.NEAREST + "SELECT cluster_id, dim, round(avg(x), 6) AS mean FROM near JOIN x USING (point_id) GROUP BY 1, 2")
def kmeans_step(spark, sf_dir):
    """One round from the labels' means: assignment and new centroids."""
    p, centroids = _label_centroids(spark, sf_dir)
    s = cluster.cluster_summary(cluster.nearest(p, centroids))
    means = s.select("cluster_id", F.posexplode(F.transform("sum", lambda x: x / F.col("n"))).alias("dim", "mean"))
    return means.withColumn("mean", F.round("mean", 6))


@_query(S.POINTS + "SELECT CAST(label AS INTEGER) AS cluster_id, dim, count(*) AS n, round(sum(x), 6) AS sum, round(sum(x * x), 6) AS sumsq FROM x GROUP BY 1, 2")
def cluster_summary(spark, sf_dir):
    s = cluster.cluster_summary(_points(spark, sf_dir).withColumn("cluster_id", F.col("label").cast("int")))
    each = s.select("cluster_id", "n", F.posexplode(F.arrays_zip("sum", "sumsq")).alias("dim", "s"))
    return each.select("cluster_id", "dim", "n", F.round("s.sum", 6).alias("sum"), F.round("s.sumsq", 6).alias("sumsq"))


@_query(S.POINTS + S.NEAREST + S.NMI)
def nmi(spark, sf_dir):
    p, centroids = _label_centroids(spark, sf_dir)
    labels = cluster.nearest(p, centroids).select(F.col("label").alias("l1"), F.col("cluster_id").alias("l2"))
    return cluster.normalized_mutual_information(labels).select(F.round("nmi", 6).alias("nmi"))


@_query()
def kmeans(spark, sf_dir):
    return cluster.kmeans(_points(spark, sf_dir).select("point_id", "features"), 10).select("point_id", "cluster_id")


def _bfr(spark, sf_dir) -> cluster.BfrResult:
    p = _points(spark, sf_dir).select("point_id", "features")
    # Five chunks that together are the whole table.
    return cluster.bfr((p.filter(F.pmod("point_id", F.lit(5)) == i) for i in range(5)), 10)


@_query()
def bfr_assignments(spark, sf_dir):
    return _bfr(spark, sf_dir).assignments


@_query()
def bfr_rounds(spark, sf_dir):
    return spark.createDataFrame(_bfr(spark, sf_dir).rounds)


@_query()
def bernoulli_sample(spark, sf_dir):
    return relational.sampled(_points(spark, sf_dir).select("point_id"), 0.3, 10, "point_id")


@_query()
def result_object(spark, sf_dir):
    """Several results as one JSON object."""
    return writers.result_object(spark, {"A": row_count(spark, sf_dir), "B": year_count(spark, sf_dir), "C": distinct_users(spark, sf_dir), "D": top_users(spark, sf_dir), "E": top_words(spark, sf_dir).select("word")})
