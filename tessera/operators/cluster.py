"""Clustering of points (point_id, features array<double>): statistics, k-means, chunk-wise BFR, quality."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import seeded_draw, squared_distance
from tessera.session import cut, fresh_path


def dimension_stats(points: DataFrame) -> DataFrame:
    """(dim, n, mean, std) with the population's standard deviation."""
    each = points.select(F.posexplode("features").alias("dim", "x"))
    return each.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def _as_arrays(stats: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("dim", "mean", "std")))
    return stats.agg(F.transform(ordered, lambda s: s["mean"]).alias("__mean"), F.transform(ordered, lambda s: s["std"]).alias("__std"))


def z_scores(points: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``points`` with features as z-scores; a dimension without variance is 0."""
    one = _as_arrays(dimension_stats(points) if stats is None else stats)
    z = F.zip_with(
        F.zip_with("features", "__mean", lambda x, m: x - m), "__std", lambda d, s: F.when(s > 0, d / F.when(s > 0, s)).otherwise(F.lit(0.0))
    )
    return points.crossJoin(F.broadcast(one)).withColumn("features", z).drop("__mean", "__std")


def largest_z(z: Column | str) -> Column:
    return F.array_max(F.transform(z, lambda x: F.abs(x)))


def standardize(points: DataFrame, limit: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(points as z-scores, ids of outliers): points with some |z| over the limit leave, the rest is measured again."""
    scored = z_scores(points).select("point_id", (largest_z("features") > limit).alias("out"))
    outliers = scored.filter("out").select("point_id")
    return z_scores(points.join(outliers, "point_id", "left_anti")), outliers


def nearest(points: DataFrame, centroids: list[tuple[int, list[float]]], spreads: dict[int, list[float]] | None = None) -> DataFrame:
    """``points`` with cluster_id and distance of the nearest centroid, the smallest id of equally near ones; -1 and null without any.

    All rows and columns stay. With ``spreads``, differences are divided by those of the centroid's id.
    """
    if not centroids:
        return points.withColumn("cluster_id", F.lit(-1)).withColumn("distance", F.lit(None).cast("double"))
    # One array with a struct for each centroid, of which the caller has k: a constant, which tasks get with their code.
    rows = [{"id": int(i), "c": list(map(float, c)), "w": [1 / x for x in spreads[i]] if spreads else None} for i, c in centroids]
    table = f"from_json('{json.dumps(rows)}', 'array<struct<id: int, c: array<double>, w: array<double>>>')"
    x, c = ("zip_with(features, c.w, (x, w) -> x * w)", "zip_with(c.c, c.w, (x, w) -> x * w)") if spreads else ("features", "c.c")
    # As SQL, which is parsed at once: lambdas of Python take longer to build than a small chunk to place.
    least = F.expr(f"array_min(transform({table}, c -> struct(sqrt({squared_distance(x, c)}) AS d, c.id AS id))) AS __b")
    kept = [F.col(f"`{n}`") for n in points.columns if n not in ("cluster_id", "distance")]
    return points.select("*", least).select(*kept, F.col("__b.id").alias("cluster_id"), F.col("__b.d").alias("distance"))


def cluster_summary(assigned: DataFrame, dims: int | None = None) -> DataFrame:
    """(cluster_id, n, sum, sumsq) with sums by dimension. Where the dimensions are known, one aggregation gives them, without a row for each."""
    if dims is not None:
        sums = [", ".join(f"sum({term.format(f'features[{i}]')})" for i in range(dims)) for term in ("{0}", "{0} * {0}")]
        return assigned.groupBy("cluster_id").agg(F.expr("count(1) AS n"), F.expr(f"array({sums[0]}) AS sum"), F.expr(f"array({sums[1]}) AS sumsq"))
    each = assigned.select("cluster_id", F.posexplode("features").alias("dim", "x"))
    sums = each.groupBy("cluster_id", "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    ordered = F.sort_array(F.collect_list(F.struct("dim", "s", "q")))
    return sums.groupBy("cluster_id").agg(F.max("n").alias("n"), F.transform(ordered, lambda r: r["s"]).alias("sum"), F.transform(ordered, lambda r: r["q"]).alias("sumsq"))


def centroids_of(assigned: DataFrame) -> list[tuple[int, list[float]]]:
    """(cluster_id, mean): one row per cluster is what the driver gets."""
    rows = cluster_summary(assigned).orderBy("cluster_id").collect()
    return [(r["cluster_id"], [x / r["n"] for x in r["sum"]]) for r in rows]


def farthest_first(points: DataFrame, k: int, fraction: float = 0.3, seed: int = 10) -> list[list[float]]:
    """Initial centroids: the sample's point of smallest id, then again and again the one farthest from all chosen."""
    total = points.count()
    if total <= k:
        return [r["features"] for r in points.orderBy("point_id").select("features").collect()]
    pool = points.filter(seeded_draw(seed, F.col("point_id")) < fraction) if fraction * total >= k else points
    pool = pool.cache()
    try:
        first = pool.orderBy("point_id").first() or points.orderBy("point_id").first()
        chosen = [first["features"]]
        while len(chosen) < k:
            far = nearest(pool, list(enumerate(chosen))).orderBy(F.desc("distance"), "point_id").first()
            if far is None or not far["distance"]:
                break
            chosen.append(far["features"])
        return chosen
    finally:
        pool.unpersist()


def kmeans(points: DataFrame, k: int, min_cluster_id: int = 0, max_iterations: int = 20, settled_below: int = 3) -> DataFrame:
    """(point_id, features, cluster_id). Ends when the clusters' sizes change by nearly the same, or after so many rounds."""
    schema = "point_id bigint, features array<double>, cluster_id int"
    starts = farthest_first(points, k)
    if not starts:
        return points.sparkSession.createDataFrame([], schema)
    centroids = [(min_cluster_id + i, c) for i, c in enumerate(starts)]
    held = points.select("point_id", "features").cache()
    try:
        sizes: dict[int, int] = {}
        for _ in range(max_iterations):
            rows = cluster_summary(nearest(held, centroids), len(starts[0])).collect()
            new = {r["cluster_id"]: r["n"] for r in rows}
            change = [new.get(i, 0) - sizes.get(i, 0) for i, _ in centroids]
            moved = {r["cluster_id"]: [x / r["n"] for x in r["sum"]] for r in rows}
            done = bool(sizes) and max(change) - min(change) < settled_below
            if done:
                break
            centroids = [(i, moved.get(i, c)) for i, c in centroids]
            sizes = new
        return cut(nearest(held, centroids).select("point_id", "features", "cluster_id"))
    finally:
        held.unpersist()


@dataclass
class Summaries:
    """n, sum and sum of squares by cluster: bounded by the number of clusters, whatever the points."""

    rows: dict[int, tuple[int, list[float], list[float]]] = field(default_factory=dict)

    def add(self, assigned: DataFrame, dims: int) -> None:
        for r in cluster_summary(assigned, dims).collect():
            n, s, q = self.rows.get(r["cluster_id"], (0, [0.0] * len(r["sum"]), [0.0] * len(r["sum"])))
            self.rows[r["cluster_id"]] = (n + r["n"], [a + b for a, b in zip(s, r["sum"])], [a + b for a, b in zip(q, r["sumsq"])])

    def merge(self, source: int, target: int, into: Summaries) -> None:
        n, s, q = self.rows.pop(source)
        m, t, u = into.rows.get(target, (0, [0.0] * len(s), [0.0] * len(s)))
        into.rows[target] = (n + m, [a + b for a, b in zip(s, t)], [a + b for a, b in zip(q, u)])

    def centroids(self) -> list[tuple[int, list[float]]]:
        return [(i, [x / n for x in s]) for i, (n, s, _) in sorted(self.rows.items())]

    def spreads(self) -> dict[int, list[float]]:
        """Standard deviations by dimension; 1 where a cluster doesn't vary."""
        return {i: [math.sqrt(v) if v > 1e-12 else 1.0 for v in (b / n - (a / n) ** 2 for a, b in zip(s, q))] for i, (n, s, q) in self.rows.items()}

    def points(self) -> int:
        return sum(n for n, _, _ in self.rows.values())

    def nearest(self, point: list[float], limit: float) -> int | None:
        near = min(((math.dist(point, c), i) for i, c in self.centroids()), default=None)
        return near[1] if near and near[0] < limit else None


@dataclass
class BfrResult:
    assignments: DataFrame  # (point_id, cluster_id), -1 for outliers
    rounds: list[dict[str, int]]


class Bfr:
    """Chunk-wise clustering that keeps summaries of clusters, not their points.

    The discard set holds the k clusters of the first chunk, the compression set smaller clusters apart
    from them, and the retained set points that no cluster is near. A point joins the nearest cluster
    whose centroid is nearer than ``alpha`` times the square root of the dimensions. With ``scaled``,
    distances to a cluster are in units of its standard deviations, dimension by dimension (Mahalanobis
    without covariances); a dimension that the cluster doesn't vary in counts as it is.

    Assignments are appended, chunk by chunk, to a folder; ``folder`` names it, and then also keeps the
    summaries after each chunk, so that :meth:`resume` goes on from there.
    """

    def __init__(self, k: int, alpha: float = 10.0, sample: float = 0.8, seed: int = 666, scaled: bool = False, folder: str | None = None):
        self.k, self.alpha, self.sample, self.seed, self.scaled, self.folder = k, alpha, sample, seed, scaled, folder
        self.discard, self.compression = Summaries(), Summaries()
        self.retained: DataFrame | None = None
        self.parts: list[str] = []  # written (point_id, cluster_id, in_discard)
        self.rounds: list[dict[str, int]] = []
        self._next = 0
        self._dims = 0

    def _record(self, rows: DataFrame, in_discard: bool) -> None:
        """Writes what a chunk assigns beside what earlier ones did; nothing is written twice."""
        if self.folder is None:
            self.folder = fresh_path(rows.sparkSession, "bfr")
        part = f"{self.folder}/assigned/round={len(self.rounds)}-{len(self.parts)}"
        rows.select("point_id", F.col("cluster_id").cast("int").alias("cluster_id"), F.lit(in_discard).alias("in_discard")).write.mode("overwrite").parquet(part)
        self.parts.append(part)

    def _assigned(self, spark: SparkSession) -> DataFrame:
        schema = "point_id bigint, cluster_id int, in_discard boolean"
        return spark.read.schema(schema).parquet(*self.parts) if self.parts else spark.createDataFrame([], schema)

    def _save(self, spark: SparkSession) -> None:
        """The summaries, which k bounds, as one row, and the retained points; both in a folder of their round."""
        n = len(self.rounds)
        held = {k: getattr(self, k) for k in ("parts", "rounds", "_next", "_dims")} | {k: list(getattr(self, k).rows.items()) for k in ("discard", "compression")}
        if self.retained is not None:
            self.retained.write.mode("overwrite").parquet(f"{self.folder}/retained/{n}")
            self.retained = spark.read.schema("point_id bigint, features array<double>").parquet(f"{self.folder}/retained/{n}")
        spark.createDataFrame([(n, json.dumps(held | {"has_retained": self.retained is not None}))], "n int, held string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/state/{n}")

    def resume(self, spark: SparkSession, n: int) -> None:
        """Goes back to what was after ``n`` chunks, which an earlier object with the same folder added."""
        held = json.loads(spark.read.parquet(f"{self.folder}/state/{n}").first()["held"])
        self.parts, self.rounds, self._next, self._dims = (held[k] for k in ("parts", "rounds", "_next", "_dims"))
        self.discard, self.compression = (Summaries({i: tuple(x) for i, x in held[k]}) for k in ("discard", "compression"))
        if held["has_retained"]:
            self.retained = spark.read.schema("point_id bigint, features array<double>").parquet(f"{self.folder}/retained/{n}")

    def _compress(self, rest: DataFrame) -> None:
        """Clusters the points that no cluster took: singletons are retained, others join the compression set."""
        made = kmeans(rest, 3 * self.k, self._next)
        sizes = made.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
        self._next += 3 * self.k
        alone = sizes.filter("n = 1")
        self.retained = cut(made.join(alone, "cluster_id", "left_semi").select("point_id", "features"))
        groups = made.join(alone, "cluster_id", "left_anti")
        fresh = Summaries()
        fresh.add(groups, self._dims)
        renamed: dict[int, int] = {}
        old = Summaries(dict(self.compression.rows))
        for i, c in fresh.centroids():
            near = old.nearest(c, self.alpha * math.sqrt(self._dims))
            renamed[i] = i if near is None else near
            fresh.merge(i, renamed[i], self.compression)
        if renamed:
            named = made.sparkSession.createDataFrame(list(renamed.items()), "cluster_id int, final int")  # a row for each cluster
            self._record(groups.join(F.broadcast(named), "cluster_id").select("point_id", F.col("final").alias("cluster_id")), False)

    def add_chunk(self, points: DataFrame) -> None:
        keep = self.folder is not None
        standard, out = standardize(points)
        standard = cut(standard)
        self._record(out.withColumn("cluster_id", F.lit(-1)), False)
        first = standard.first()
        if first is not None:
            self._dims = len(first["features"])
            if not self.discard.rows:
                drawn = seeded_draw(self.seed, F.col("point_id")) < self.sample
                part = kmeans(standard.filter(drawn), self.k, self._next)
                self._next += self.k
                self.discard.add(part, self._dims)
                self._record(part, True)
                self._compress(standard.join(part, "point_id", "left_anti"))
            else:
                limit = F.lit(self.alpha * math.sqrt(self._dims))
                rest = standard
                for held, is_discard in ((self.discard, True), (self.compression, False)):
                    placed = cut(nearest(rest, held.centroids(), held.spreads() if self.scaled else None))
                    inside = (F.col("cluster_id") >= 0) & (F.col("distance") < limit)
                    taken = placed.filter(inside)
                    held.add(taken, self._dims)
                    self._record(taken, is_discard)
                    rest = placed.filter(~F.coalesce(inside, F.lit(False))).select("point_id", "features")
                if self.retained is not None:
                    rest = rest.unionByName(self.retained)
                self._compress(cut(rest))
        self.rounds.append(
            {
                "round_id": len(self.rounds) + 1,
                "nof_cluster_discard": len(self.discard.rows),
                "nof_point_discard": self.discard.points(),
                "nof_cluster_compression": len(self.compression.rows),
                "nof_point_compression": self.compression.points(),
                "nof_point_retained": self.retained.count() if self.retained is not None else 0,
            }
        )
        if keep:
            self._save(points.sparkSession)

    def finish(self, spark: SparkSession) -> BfrResult:
        """Merges compression clusters near a discard cluster into it; what is left over is outliers."""
        limit, renamed = self.alpha * math.sqrt(self._dims), {-1: -1} | {i: i for i in self.discard.rows}
        for i, c in self.compression.centroids():
            near = self.discard.nearest(c, limit)
            if near is None:
                renamed[i] = -1
            else:
                renamed[i] = near
                self.compression.merge(i, near, self.discard)
        named = spark.createDataFrame(list(renamed.items()), "cluster_id int, final int")  # a row for each cluster
        out = self._assigned(spark).join(F.broadcast(named), "cluster_id").select("point_id", F.col("final").alias("cluster_id"))
        if self.retained is not None:
            out = out.unionByName(self.retained.select("point_id", F.lit(-1).alias("cluster_id")))
        return BfrResult(out, self.rounds)


def bfr(chunks: Iterable[DataFrame], k: int, alpha: float = 10.0, scaled: bool = False) -> BfrResult:
    state, spark = Bfr(k, alpha, scaled=scaled), None
    for chunk in chunks:
        spark = chunk.sparkSession
        state.add_chunk(chunk)
    if spark is None:
        raise ValueError("there is no chunk")
    return state.finish(spark)


def normalized_mutual_information(labels: DataFrame) -> DataFrame:
    """(nmi) of two labellings (l1, l2) of the same points, by the arithmetic mean of their entropies; -1 is a label like others."""
    cells = labels.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("c"))
    total = cells.agg(F.sum("c").cast("double").alias("n"))
    side = lambda l, name: cells.groupBy(l).agg(F.sum("c").alias(name))
    mutual = cells.join(side("l1", "a"), "l1").join(side("l2", "b"), "l2").crossJoin(total)
    mi = mutual.agg(F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("a") * F.col("b")))).alias("mi"))
    entropy = lambda l, name: side(l, "x").crossJoin(total).agg((-F.sum(F.col("x") / F.col("n") * F.ln(F.col("x") / F.col("n")))).alias(name))
    both = mi.crossJoin(entropy("l1", "h1")).crossJoin(entropy("l2", "h2"))
    mean = (F.col("h1") + F.col("h2")) / 2
    return both.select(F.when(mean <= 0, F.lit(1.0)).otherwise(F.col("mi") / F.when(mean > 0, mean)).alias("nmi"))


def cluster_sizes(labels: DataFrame, label: str) -> DataFrame:
    return labels.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy("n", label)
