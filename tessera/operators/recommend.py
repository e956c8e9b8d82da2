"""TF-IDF profiles with cosine scores, and nearest-neighbour prediction of ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import STOP_WORDS, words
from tessera.operators import neighbours
from tessera.operators.relational import top_per_group


def term_counts(texts: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, term, n) without stop words, all texts of a doc together."""
    each = texts.select(F.col(doc).alias("doc"), F.explode(words(text)).alias("term"))
    return each.filter(~F.col("term").isin("", *STOP_WORDS)).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(counts: DataFrame) -> DataFrame:
    """(doc, term, tf): counts by the doc's largest."""
    return counts.withColumn("tf", F.col("n") / F.max("n").over(Window.partitionBy("doc"))).drop("n")


def inverse_frequency(counts: DataFrame) -> DataFrame:
    """(term, df, idf): log2 of docs with any term by docs with this one. The number of docs joins as a row, not through the driver."""
    n_docs = counts.agg(F.countDistinct("doc").alias("n_docs"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(n_docs).select("term", "df", F.log2(F.col("n_docs") / F.col("df")).alias("idf"))


def tfidf(counts: DataFrame) -> DataFrame:
    """(doc, term, tfidf), rounded to 6 places so that ties are ties on every engine."""
    joined = term_frequency(counts).join(inverse_frequency(counts).select("term", "idf"), "term")
    return joined.select("doc", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("tfidf"))


def top_terms(counts: DataFrame, k: int = 200) -> DataFrame:
    """(doc, term, tfidf): the doc's k largest, the smaller term first among equals."""
    return top_per_group(tfidf(counts), ["doc"], [F.desc("tfidf"), F.asc("term")], k)


def item_profiles(counts: DataFrame, k: int = 200) -> DataFrame:
    """(doc, term): a binary vector of the top terms."""
    return top_terms(counts, k).select("doc", "term")


def user_profiles(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(user, term, weight): the mean of the profiles of the user's distinct items; ``pairs`` is (user, doc)."""
    own = pairs.select("user", "doc").distinct().join(profiles.select("doc").distinct(), "doc", "left_semi")
    n = own.groupBy("user").agg(F.count(F.lit(1)).alias("n_docs"))
    sums = own.join(profiles, "doc").groupBy("user", "term").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(n, "user").select("user", "term", (F.col("n") / F.col("n_docs")).alias("weight"))


def profile_norms(users: DataFrame) -> DataFrame:
    return users.groupBy("user").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))


def cosine_scores(pairs: DataFrame, users: DataFrame, profiles: DataFrame, k: int = 200, least: float = 0.01) -> DataFrame:
    """(user, doc, sim) of the pairs, with the item's norm taken as that of a full profile; below ``least`` left out."""
    dots = pairs.select("user", "doc").distinct().join(profiles, "doc").join(users, ["user", "term"]).groupBy("user", "doc").agg(F.sum("weight").alias("dot"))
    raw = dots.join(profile_norms(users), "user").withColumn("sim", F.col("dot") / (F.sqrt(F.lit(float(k))) * F.col("norm")))
    return raw.filter(F.col("sim") >= least).select("user", "doc", F.round("sim", 5).alias("sim"))


def _means(ratings: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    means = ratings.groupBy(key).agg(F.avg("rating").alias("mean"))
    return means, means.agg(F.avg("mean").alias("overall"))


def predict_by_items(ratings: DataFrame, pairs: DataFrame, model: DataFrame, k: int = 50, normalized: bool = True) -> DataFrame:
    """(user, item, prediction) of pairs (user, item) from the user's ratings of the k most similar items.

    ``ratings`` is (user, item, rating), ``model`` (id1, id2, sim) of items. Weighted by similarity;
    if not normalized the products of similarity and rating are only summed. Without any neighbour it
    is the item's mean, then the mean of the items' means. Of equally similar items the smaller comes first; all of a user's ratings of
    one item count.
    """
    wanted = pairs.select(F.col("user").alias("group"), F.col("item").alias("target")).distinct()
    rated = ratings.select(F.col("user").alias("group"), F.col("item").alias("neighbour"), "rating")
    scored = neighbours.scores(wanted, rated, model, k, normalized).toDF("user", "item", "score")
    means, overall = _means(ratings, "item")
    joined = scored.join(means, "item", "left").crossJoin(overall)
    return joined.select("user", "item", F.coalesce("score", "mean", "overall").alias("prediction"))


def predict_by_users(ratings: DataFrame, pairs: DataFrame, model: DataFrame, k: int = 200, normalized: bool = True) -> DataFrame:
    """(user, item, prediction) of pairs from what the k most similar raters of the item gave, each less their own mean.

    ``model`` is (id1, id2, sim) of users. To the weighted mean of these the user's own mean is added,
    for an unknown user the mean of the users' means; without neighbours that is all.
    """
    wanted = pairs.select(F.col("item").alias("group"), F.col("user").alias("target")).distinct()
    means, overall = _means(ratings, "user")
    centred = ratings.join(means, "user").select(F.col("item").alias("group"), F.col("user").alias("neighbour"), (F.col("rating") - F.col("mean")).alias("rating"))
    scored = neighbours.scores(wanted, centred, model, k, normalized).toDF("item", "user", "score")
    joined = scored.join(means, "user", "left").crossJoin(overall)
    return joined.select("user", "item", (F.coalesce("score", F.lit(0.0)) + F.coalesce("mean", "overall")).alias("prediction"))
