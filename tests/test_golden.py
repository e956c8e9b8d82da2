"""Results that are known from elsewhere, over the inputs in golden.py."""

from collections import Counter

import pytest
from golden import BASKETS_1, BASKETS_2, BUSIEST, COMMUNITIES, GRAPH

from tessera.operators import graph, itemsets


def pairs(text):
    return [(int(k), int(v)) for part in text.split(";") for k, vs in [part.split(":")] for v in vs.split(",")]


@pytest.fixture(scope="module")
def edges(spark):
    from tessera.session import cut

    return cut(graph.both_directions(spark.createDataFrame(pairs(GRAPH), "src long, dst long").coalesce(2)))


def test_betweenness(spark, edges):
    assert edges.count() == 2 * 498 and graph.vertices(edges).count() == 222
    for found in (graph.edge_betweenness(edges), graph._betweenness_of(edges, pairs(GRAPH))):
        got = {(r.a, r.b): r.betweenness for r in found.collect()}
        assert len(got) == 498 and abs(sum(got.values()) - 86_309.0) < 1e-6
        assert all(abs(got[a, b] - v) < 1e-5 for a, b, v in BUSIEST)
        assert sorted(got.values())[-len(BUSIEST) :] == sorted(got[a, b] for a, b, _ in BUSIEST)


def test_components(spark, edges):
    sizes = Counter(r.component for r in graph.components(edges).collect())
    assert sorted(sizes.values()) == [2] * 8 + [3, 4, 4, 5, 190]


def test_communities_of_the_largest_modularity(spark, edges):
    labels, q = graph.girvan_newman(edges)
    found = {}
    for r in labels.collect():
        found.setdefault(r.component, set()).add(r.id)
    want = [set(map(int, c.split(","))) for c in COMMUNITIES.split(";")]
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want)) and len(want) == 19
    assert round(q, 6) == 0.350355


#: Frequent itemsets by size.
COUNTS = [
    (BASKETS_1, 1, 3, [8, 20, 16, 3]),
    (BASKETS_1, 1, 4, [7, 14, 4]),
    (BASKETS_1, 2, 3, [14, 32, 25, 8, 1]),
    (BASKETS_1, 2, 4, [8, 10, 3]),
    (BASKETS_2, 1, 6, [22, 179, 510, 397, 89, 7]),
    (BASKETS_2, 1, 9, [20, 117, 134, 30, 1]),
    (BASKETS_2, 2, 6, [38, 350, 644, 296, 69, 7]),
    (BASKETS_2, 2, 9, [28, 62, 10, 1]),
]


@pytest.mark.parametrize("text, case, support, want", COUNTS)
def test_frequent_itemsets_by_partition(spark, text, case, support, want):
    key, item = ("k", "x") if case == 1 else ("x", "k")
    b = itemsets.baskets(spark.createDataFrame(pairs(text), "k int, x int"), key, item)
    found = itemsets.son_itemsets(b, support, 3).collect()
    assert [n for _, n in sorted(Counter(r.size for r in found).items())] == want
    if (case, support, len(want)) == (1, 4, 3):
        assert sorted(tuple(r["items"]) for r in found if r.size == 3) == [("100", "101", "98"), ("101", "97", "99"), ("102", "103", "99"), ("97", "98", "99")]


@pytest.mark.parametrize("text, case, support, want", [COUNTS[i] for i in (1, 6)])
def test_frequent_itemsets_by_levels(spark, text, case, support, want):
    key, item = ("k", "x") if case == 1 else ("x", "k")
    b = itemsets.baskets(spark.createDataFrame(pairs(text), "k int, x int"), key, item)
    found = {tuple(r["items"]): r.support for r in itemsets.frequent_itemsets(b, support).collect()}
    assert [n for _, n in sorted(Counter(map(len, found)).items())] == want
    assert found == {tuple(r["items"]): r.support for r in itemsets.son_itemsets(b, support, 4).collect()}
