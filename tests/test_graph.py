import random
from collections import deque
from itertools import combinations

import pytest

from tessera.operators import graph


def frame(spark, edges):
    return graph.both_directions(spark.createDataFrame(edges, "src string, dst string"))


def brandes(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    total = dict.fromkeys([tuple(sorted(e)) for e in edges], 0.0)
    for s in near:
        dist, paths, order, q = {s: 0}, {s: 1}, [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    paths[w] = 0
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        credit = dict.fromkeys(order, 1.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    c = credit[w] * paths[v] / paths[w]
                    credit[v] += c
                    total[tuple(sorted((v, w)))] += c
    return {e: c / 2 for e, c in total.items()}


def random_edges(seed, n=14, m=18):
    random.seed(seed)
    return random.sample(list(combinations([f"v{i:02}" for i in range(n)], 2)), m)


@pytest.mark.parametrize("seed", [1, 2])
def test_betweenness_both_ways(spark, seed):
    edges = random_edges(seed)
    want = brandes(edges)
    for found in (graph.edge_betweenness(frame(spark, edges)), graph._betweenness_of(frame(spark, edges), edges)):
        got = {(r.a, r.b): r.betweenness for r in found.collect()}
        assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)


def test_components_of_a_chain(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y")]
    got = {r.id: r.component for r in graph.components(frame(spark, chain)).collect()}
    assert set(got.values()) == {"n000", "x"} and got["n060"] == "n000" and len(got) == 63


def _modularity(edges, label):
    m = 2 * len(edges)
    k = {}
    for a, b in edges:
        k[a] = k.get(a, 0) + 1
        k[b] = k.get(b, 0) + 1
    there = {tuple(sorted(e)) for e in edges}
    return sum(((p in there) - k[p[0]] * k[p[1]] / m) / m for p in combinations(sorted(k), 2) if label[p[0]] == label[p[1]])


def test_girvan_newman_of_two_cliques(spark):
    edges = [*combinations("abcd", 2), *combinations("wxyz", 2), ("d", "w")]
    labels, q = graph.girvan_newman(frame(spark, edges))
    got = {r.id: r.component for r in labels.collect()}
    assert got == dict.fromkeys("abcd", "a") | dict.fromkeys("wxyz", "w")
    assert abs(q - _modularity(edges, got)) < 1e-12


def test_a_cut_may_isolate_a_vertex(spark):
    labels, _ = graph.girvan_newman(frame(spark, [("a", "b")]))
    assert {r.id: r.component for r in labels.collect()} == {"a": "a", "b": "a"}


def test_label_propagation_ties_go_to_the_smallest(spark):
    got = {r.id: r.label for r in graph.label_propagation(frame(spark, [("a", "b"), ("b", "c")]), 1).collect()}
    assert got == {"a": "b", "b": "a", "c": "b"}


def test_empty(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert graph.components(e).count() == graph.edge_betweenness(e).count() == graph.label_propagation(e).count() == 0


def test_no_edge_has_no_modularity_and_no_communities(spark):
    """As in tables in which no two customers share enough parts."""
    e = spark.createDataFrame([], "src long, dst long")
    assert [tuple(r) for r in graph.modularity(e, spark.createDataFrame([], "id long, label long")).collect()] == [(None,)]
    labels, q = graph.girvan_newman(e)
    assert (labels.count(), q) == (0, 0.0)


def test_no_edge_has_no_levels(spark):
    """The smallest of no vertices is a row of null, which is no root."""
    e = spark.createDataFrame([], "src long, dst long")
    assert graph.bfs(e, e.selectExpr("min(src) AS id")).count() == 0
