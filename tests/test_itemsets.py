import random
from collections import Counter
from itertools import combinations

import pytest
import xxhash

from tessera.operators import itemsets


def brute(baskets, support):
    out = {}
    items = sorted({x for b in baskets for x in b})
    for k in range(1, len(items) + 1):
        level = {c: sum(set(c) <= set(b) for b in baskets) for c in combinations(items, k)}
        level = {c: n for c, n in level.items() if n >= support}
        if not level:
            break
        out |= level
    return out


def frame(spark, baskets):
    return itemsets.baskets(spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "k int, x string"), "k", "x")


def got(df):
    return {tuple(r["items"]): r["support"] for r in df.collect()}


@pytest.mark.parametrize("support", [2, 4])
def test_against_brute_force(spark, support):
    random.seed(support)
    baskets = [random.sample([str(i) for i in range(95, 104)], random.randint(1, 6)) for _ in range(18)]
    want = brute(baskets, support)
    b = frame(spark, baskets)
    assert got(itemsets.frequent_itemsets(b, support)) == want
    assert got(itemsets.son_itemsets(b, support, 3)) == want
    assert itemsets.mine_list(baskets, support) == sorted(want, key=lambda c: (len(c), c))
    hashed = {tuple(r) for r in itemsets.hashed_pair_candidates(b, support, 7).collect()}
    assert {c for c in want if len(c) == 2} <= hashed <= set(combinations(sorted({x for b in baskets for x in b}), 2))


def test_none_frequent(spark):
    b = frame(spark, [["a"], ["b"]])
    assert got(itemsets.frequent_itemsets(b, 3)) == {} == got(itemsets.son_itemsets(b, 3))


def test_combinations_in_row(spark):
    b = frame(spark, [["d", "b", "a", "c"], ["x"]])
    rows = b.select(itemsets.combinations_of("items", 3).alias("c")).collect()
    assert sorted(tuple(c) for r in rows for c in r["c"]) == list(combinations("abcd", 3))


def test_partitions_where_nothing_reaches_its_share(spark):
    """One item in most baskets, among many partitions with few or none of them."""
    b = frame(spark, [["x"]] * 40 + [["y"], ["z"], ["y", "w"], ["q"]])
    for partitions in (8, 40, 100):
        assert got(itemsets.son_itemsets(b, 38, partitions)) == {("x",): 40}
    assert got(itemsets.son_itemsets(b.limit(0), 2)) == {}
    assert got(itemsets.son_itemsets(b, 2)) == {("x",): 40, ("y",): 2}


def test_mined_lists_of_larger_baskets():
    rng = random.Random(3)
    baskets = [rng.sample([f"i{k:02}" for k in range(25)], rng.randint(3, 12)) for _ in range(60)]
    want = brute(baskets, 12)
    assert itemsets.mine_list(baskets, 12) == sorted(want, key=lambda c: (len(c), c))
    assert itemsets.mine_list(iter(baskets), lambda: 12) == itemsets.mine_list(baskets, 12)


def test_hashed_buckets_by_brute_force(spark):
    rng = random.Random(7)
    baskets = [rng.sample([str(i) for i in range(30)], rng.randint(1, 6)) for _ in range(80)]
    b = frame(spark, baskets)
    support, buckets = 6, 40
    frequent = {x for x in {x for b in baskets for x in b} if sum(x in b for b in baskets) >= support}
    each = [p for b in baskets for p in combinations(sorted(set(b) & frequent), 2)]
    chained = lambda a, b: xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    full = Counter(signed(chained(*p)) % buckets for p in each)
    want = {p for p in each if full[signed(chained(*p)) % buckets] >= support}
    assert {tuple(r) for r in itemsets.hashed_pair_candidates(b, support, buckets).collect()} == want


def test_brand_baskets_are_made_once(spark):
    """What is counted and mined is read from files, not joined and grouped again for each."""
    from tessera.plans import catalogue

    made, _ = catalogue._brand_baskets(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
