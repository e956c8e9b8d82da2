import random
from collections import Counter
from itertools import combinations

import pytest

from tessera.operators import pairs


def ratings(spark, seed=3, users=25, items=12, n=160):
    rng = random.Random(seed)
    rows = [(rng.randrange(users), rng.randrange(items), float(rng.randint(1, 5))) for _ in range(n)] + [(None, 1, 2.0), (1, None, 2.0)]
    return rows, spark.createDataFrame(rows, "user int, item int, rating double")


def sets_of(rows):
    out = {}
    for u, i, _ in rows:
        if u is not None and i is not None:
            out.setdefault(u, set()).add(i)
    return out


def in_pieces(monkeypatch, size):
    monkeypatch.setattr(pairs, "LIST", size)
    monkeypatch.setattr(pairs, "PAIRS", 40)


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_overlap_by_brute_force(spark, monkeypatch, size):
    """Lists of ids that go in pieces give each pair once for each item, as whole ones do."""
    in_pieces(monkeypatch, size)
    rows, df = ratings(spark)
    want = {(a, b): len(x & y) for (a, x), (b, y) in combinations(sorted(sets_of(rows).items()), 2)}
    for least in (1, 3):
        got = [tuple(r) for r in pairs.pair_overlap(df, "user", "item", least).collect()]
        assert len(got) == len({r[:2] for r in got}) and {r[:2]: r[2] for r in got} == {p: n for p, n in want.items() if n >= least}


@pytest.mark.parametrize("size", [2, 4096])
def test_jaccard_by_brute_force(spark, monkeypatch, size):
    in_pieces(monkeypatch, size)
    rows, df = ratings(spark)
    few = {u: x for u, x in sets_of(rows).items() if len(x) <= 6}
    want = {(a, b): len(x & y) / len(x | y) for (a, x), (b, y) in combinations(sorted(few.items()), 2) if x & y and len(x & y) / len(x | y) >= 0.3}
    got = {(r.id1, r.id2): r.jaccard for r in pairs.jaccard_pairs(df, "user", "item", 0.3, 6).collect()}
    assert got == want and want


@pytest.mark.parametrize("size", [2, 4096])
def test_pearson_by_brute_force(spark, monkeypatch, size):
    in_pieces(monkeypatch, size)
    rows, df = ratings(spark)
    given = {}
    for u, i, r in rows:
        if u is not None and i is not None:
            given.setdefault(u, {}).setdefault(i, []).append(r)
    mean = {u: {i: sum(x) / len(x) for i, x in g.items()} for u, g in given.items()}
    want = {}
    for a, b in combinations(sorted(mean), 2):
        both = sorted(mean[a].keys() & mean[b].keys())
        if len(both) >= 3:
            x, y = [mean[a][i] for i in both], [mean[b][i] for i in both]
            mx, my = sum(x) / len(x), sum(y) / len(y)
            vx, vy = sum((p - mx) ** 2 for p in x), sum((p - my) ** 2 for p in y)
            want[a, b] = (len(both), sum((p - mx) * (q - my) for p, q in zip(x, y)) / (vx * vy) ** 0.5 if vx * vy > 1e-9 else -1.0)
    got = {(r.id1, r.id2): (r.common, r.sim) for r in pairs.pearson_pairs(df, "user", "item", "rating", 3, None).collect()}
    assert got.keys() == want.keys() and all(got[p][0] == n and abs(got[p][1] - s) < 1e-6 for p, (n, s) in want.items())


@pytest.mark.parametrize(
    "made",
    [
        lambda df: pairs.pair_overlap(df, "user", "item", 2),
        lambda df: pairs.jaccard_pairs(df, "user", "item"),
        lambda df: pairs.pearson_pairs(df, "user", "item", "rating"),
        lambda df: pairs.lsh_jaccard_pairs(df, "user", "item", 0.3, 12, 6),
    ],
)
def test_no_row_of_a_pair_is_shuffled_and_tasks_grow_with_the_pairs(spark, monkeypatch, made):
    in_pieces(monkeypatch, 4096)
    rows, df = ratings(spark)
    found = made(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "id2" not in shuffles[0]
    met = sum(n * (n - 1) // 2 for n in Counter(i for x in sets_of(rows).values() for i in x).values())
    assert found.rdd.getNumPartitions() >= met / 40 / 2


def test_signatures_are_not_shuffled(spark):
    rows, df = ratings(spark)
    made = pairs.minhash_signatures(df, "user", "item", 5)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert {r.id for r in made.collect()} == sets_of(rows).keys()


@pytest.mark.parametrize("size", [2, 4096])
def test_verified_candidates_are_the_pairs_of_a_bucket_with_their_similarity(spark, monkeypatch, size):
    in_pieces(monkeypatch, size)
    rows, df = ratings(spark)
    sets = sets_of(rows)
    met = {tuple(r) for r in pairs.lsh_candidates(pairs.minhash_signatures(df, "user", "item", 12), 6).collect()}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in met}
    got = [tuple(r) for r in pairs.lsh_jaccard_pairs(df, "user", "item", 0.3, 12, 6).collect()]
    assert {r[:2]: r[2] for r in got} == {p: j for p, j in alike.items() if j >= 0.3} and len(got) == len(set(got))
    assert len(met) < len(sets) * (len(sets) - 1) // 2


def test_candidates_few_beside_the_pairs_of_items_are_verified_by_sets(spark):
    """All have item 0; a signature of many rows a band puts hardly any two of them into a bucket."""
    sets = {u: {0, *random.Random(u % 60).sample(range(1, 2000), 20)} for u in range(64)}
    df = spark.createDataFrame([(u, i) for u, x in sets.items() for i in x], "user int, item int")
    got = {(r.id1, r.id2): r.jaccard for r in pairs.lsh_jaccard_pairs(df, "user", "item", 0.9, 40, 4).collect()}
    assert got == {(u, u + 60): 1.0 for u in range(4)}
