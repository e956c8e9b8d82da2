import math
import random
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.operators import cluster
from tessera.sources import readers
from tessera.streaming.chunks import bfr_stream


def blobs(n=40, k=3, seed=1):
    random.seed(seed)
    rows = [(i, [random.gauss(20 * (i % k), 1), random.gauss(-20 * (i % k), 1)]) for i in range(n * k)]
    return rows, {i: i % k for i in range(n * k)}


def agreement(spark, df, truth):
    labels = df.join(spark.createDataFrame(list(truth.items()), "point_id long, l1 int"), "point_id").select("l1", F.col("cluster_id").alias("l2"))
    return cluster.normalized_mutual_information(labels).first()[0]


def test_kmeans_finds_blobs(spark):
    rows, truth = blobs()
    p = spark.createDataFrame(rows, "point_id long, features array<double>")
    found = cluster.kmeans(p, 3)
    assert found.count() == len(rows) and agreement(spark, found, truth) > 0.99
    assert cluster.kmeans(p.limit(2), 5).select("cluster_id").distinct().count() == 2
    assert cluster.kmeans(p.limit(0), 5).count() == 0


def test_zero_variance_and_nearest(spark):
    p = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "point_id long, features array<double>")
    assert sorted(r.features for r in cluster.z_scores(p).collect()) == [[-1.0, 0.0], [1.0, 0.0]]
    assert [r.cluster_id for r in cluster.nearest(p, [(4, [2.0, 5.0]), (3, [2.0, 5.0])]).collect()] == [3, 3]
    assert [r.cluster_id for r in cluster.nearest(p, []).collect()] == [-1, -1]


def test_bfr_places_every_point_once(spark, tmp_path):
    rows, truth = blobs(60)
    random.shuffle(rows)
    chunks = [rows[i::3] for i in range(3)]
    for i, c in enumerate(chunks):
        (tmp_path / f"chunk{i}.txt").write_text("".join(f"{p},{x},{y}\n" for p, (x, y) in c))
    for result in (cluster.bfr(readers.point_chunks(spark, str(tmp_path)), 3, alpha=1.0), bfr_stream(spark, str(tmp_path), 3, alpha=1.0)):
        got = result.assignments
        assert got.count() == len(rows) == got.select("point_id").distinct().count()
        assert len(result.rounds) == 3
        assert agreement(spark, got, truth) > 0.7
        last = result.rounds[-1]
        assert last["nof_point_discard"] + last["nof_point_compression"] + last["nof_point_retained"] <= len(rows)


def test_nmi_bounds(spark):
    same = spark.createDataFrame([(0, 5), (0, 5), (1, 6)], "l1 int, l2 int")
    assert abs(cluster.normalized_mutual_information(same).first()[0] - 1) < 1e-12
    apart = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "l1 int, l2 int")
    assert abs(cluster.normalized_mutual_information(apart).first()[0]) < 1e-12


def test_nearest_keeps_every_row_and_column(spark):
    p = spark.createDataFrame([(1, [1.0], "a", 5), (1, [1.0], "b", 6), (2, [9.0], None, 7)], "point_id long, features array<double>, label string, extra int")
    rng = random.Random(1)
    for many in (3, 60_000):  # the second is over 200,000 values
        centroids = [(i, [rng.uniform(20, 30)] * 1) for i in range(many)] + [(10**6, [0.5]), (10**6 + 1, [9.5])]
        got = cluster.nearest(p, centroids)
        assert got.columns == ["point_id", "features", "label", "extra", "cluster_id", "distance"]
        assert sorted((r.extra, r.cluster_id, r.distance) for r in got.collect()) == [(5, 10**6, 0.5), (6, 10**6, 0.5), (7, 10**6 + 1, 0.5)]


def test_distances_in_units_of_each_clusters_spread(spark):
    p = spark.createDataFrame([(1, [6.0, 0.0])], "point_id long, features array<double>")
    centroids, spreads = [(0, [0.0, 0.0]), (1, [10.0, 0.0])], {0: [10.0, 1.0], 1: [1.0, 1.0]}
    assert cluster.nearest(p, centroids).first().cluster_id == 1
    r = cluster.nearest(p, centroids, spreads).first()
    assert (r.cluster_id, round(r.distance, 9)) == (0, 0.6)


# Chunk-wise clustering by brute force, in plain lists


def plain_z(points):
    n, d = len(points), len(next(iter(points.values())))
    mean = [sum(x[j] for x in points.values()) / n for j in range(d)]
    std = [math.sqrt(sum((x[j] - mean[j]) ** 2 for x in points.values()) / n) for j in range(d)]
    return {i: [(x[j] - mean[j]) / std[j] if std[j] > 0 else 0.0 for j in range(d)] for i, x in points.items()}


def plain_nearest(x, centroids):
    return min((math.dist(x, c), i) for i, c in centroids)


def plain_draw(seed, i):
    return (xxhash.xxh64_intdigest(struct.pack("<q", i), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)) % (1 << 30)) / (1 << 30)


def plain_kmeans(points, k, first_id):
    if not points:
        return {}
    if len(points) <= k:
        starts = [points[i] for i in sorted(points)]
    else:
        pool = {i: x for i, x in points.items() if 0.3 * len(points) < k or plain_draw(10, i) < 0.3}
        starts = [(pool or points)[min(pool or points)]]
        while len(starts) < k and pool:
            d, i = max((min(math.dist(x, c) for c in starts), -i) for i, x in pool.items())
            if d == 0:
                break
            starts.append(pool[-i])
    centroids, sizes = [(first_id + j, c) for j, c in enumerate(starts)], {}
    for _ in range(20):
        at = {i: plain_nearest(x, centroids)[1] for i, x in points.items()}
        new = Counter(at.values())
        change = [new.get(c, 0) - sizes.get(c, 0) for c, _ in centroids]
        if sizes and max(change) - min(change) < 3:
            break
        centroids = [(c, [sum(points[i][j] for i in points if at[i] == c) / new[c] for j in range(len(x))] if new.get(c) else x) for c, x in centroids]
        sizes = new
    return {i: plain_nearest(x, centroids)[1] for i, x in points.items()}


def plain_bfr(chunks, k, alpha):
    discard, compression, retained, next_id, labels, rounds = {}, {}, {}, 0, {}, []
    centre = lambda members: [sum(c) / len(members) for c in zip(*members)]

    def compress(rest):
        nonlocal retained, next_id
        made = plain_kmeans(rest, 3 * k, next_id)
        next_id += 3 * k
        n = Counter(made.values())
        retained = {i: x for i, x in rest.items() if n[made[i]] == 1}
        before = {c: centre(m) for c, m in compression.items()}
        for c in sorted(c for c in n if n[c] > 1):
            mine = {i: x for i, x in rest.items() if made[i] == c}
            d, near = min(((math.dist(centre(list(mine.values())), x), o) for o, x in before.items()), default=(limit, None))
            to = near if d < limit else c
            compression.setdefault(to, []).extend(mine.values())
            labels.update(dict.fromkeys(mine, to))

    for chunk in chunks:
        z = plain_z(chunk)
        out = {i for i, x in z.items() if max(map(abs, x)) > 3.0}
        labels.update(dict.fromkeys(out, -1))
        z = plain_z({i: x for i, x in chunk.items() if i not in out})
        limit = alpha * math.sqrt(len(next(iter(z.values()))))
        if not discard:
            part = plain_kmeans({i: x for i, x in z.items() if plain_draw(666, i) < 0.8}, k, next_id)
            next_id += k
            for i, c in part.items():
                discard.setdefault(c, []).append(z[i])
            labels.update(part)
            compress({i: x for i, x in z.items() if i not in part})
        else:
            rest = z
            for held in (discard, compression):
                centroids = [(c, centre(m)) for c, m in sorted(held.items())]
                left = {}
                for i, x in rest.items():
                    d, c = min(((math.dist(x, o), c) for c, o in centroids), default=(limit, None))
                    if d < limit:
                        held[c].append(x)
                        labels[i] = c
                    else:
                        left[i] = x
                rest = left
            compress({**rest, **retained})
        count = lambda held: sum(map(len, held.values()))
        rounds.append((len(discard), count(discard), len(compression), count(compression), len(retained)))
    final = {c: c for c in discard} | {-1: -1}
    for c, m in sorted(compression.items()):
        d, near = min((math.dist(centre(m), centre(o)), i) for i, o in sorted(discard.items()))
        final[c] = near if d < limit else -1
        if d < limit:
            discard[near] = discard[near] + m
    return {i: final[c] for i, c in labels.items()} | dict.fromkeys(retained, -1), rounds


@pytest.mark.parametrize("alpha, seed", [(0.35, 1), (0.2, 2), (1.0, 3)])
def test_bfr_by_brute_force(spark, alpha, seed):
    rng = random.Random(seed)
    points = {i: [rng.gauss(20 * (i % 4), 2), rng.gauss(-9 * (i % 3), 2)] for i in range(160)}
    points |= {1000 + i: [rng.uniform(-80, 140), rng.uniform(-90, 60)] for i in range(14)}
    ids = list(points)
    rng.shuffle(ids)
    chunks = [{i: points[i] for i in ids[j::3]} for j in range(3)]
    frames = [spark.createDataFrame(list(c.items()), "point_id long, features array<double>") for c in chunks]
    result = cluster.bfr(frames, 4, alpha)
    want, rounds = plain_bfr(chunks, 4, alpha)
    names = ("nof_cluster_discard", "nof_point_discard", "nof_cluster_compression", "nof_point_compression", "nof_point_retained")
    assert [tuple(r[n] for n in names) for r in result.rounds] == rounds
    assert {r.point_id: r.cluster_id for r in result.assignments.collect()} == want


def test_kmeans_by_brute_force(spark):
    rng = random.Random(8)
    points = {i: [rng.gauss(6 * (i % 5), 2), rng.gauss(5 * (i % 2), 2)] for i in range(120)}
    found = cluster.kmeans(spark.createDataFrame(list(points.items()), "point_id long, features array<double>"), 5, 30)
    assert {r.point_id: r.cluster_id for r in found.collect()} == plain_kmeans(points, 5, 30)


def test_stream_goes_on_with_files_that_come_later(spark, tmp_path):
    rows, _ = blobs(50)
    random.Random(4).shuffle(rows)
    (tmp_path / "in").mkdir()
    whole = cluster.bfr([spark.createDataFrame(rows[i::4], "point_id long, features array<double>") for i in range(4)], 3, 0.4)
    for i in range(4):
        (tmp_path / "in" / f"{i}.txt").write_text("".join(f"{p},{x},{y}\n" for p, (x, y) in rows[i::4]))
        got = bfr_stream(spark, str(tmp_path / "in"), 3, 0.4, "file://" + str(tmp_path / "state"))
        assert len(got.rounds) == i + 1
    again = bfr_stream(spark, str(tmp_path / "in"), 3, 0.4, "file://" + str(tmp_path / "state"))
    for result in (got, again):
        assert result.rounds == whole.rounds
        assert sorted(map(tuple, result.assignments.collect())) == sorted(map(tuple, whole.assignments.collect()))
    scaled = cluster.bfr([spark.createDataFrame(rows, "point_id long, features array<double>")], 3, 2.0, scaled=True)
    assert scaled.assignments.count() == len(rows)
