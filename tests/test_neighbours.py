import random

import pytest

from tessera.operators import neighbours, recommend


def brute(wanted, rated, sim, k, normalized):
    out = {}
    for g, t in wanted:
        near = sorted((-sim[t, n], n, r) for h, n, r in rated if h == g and (t, n) in sim)[:k] if g is not None and t is not None else []
        total, weight = sum(-s * r for s, _, r in near), sum(-s for s, _, _ in near)
        out[g, t] = (total / weight if normalized else total) if near else None
    return out


def case(name):
    rng = random.Random(5)
    rated = [(g, name(rng.randrange(14)), float(rng.randint(1, 5))) for g in range(30) for _ in range(rng.randint(1, 12))] + [(None, name(1), 2.0), (3, None, 2.0)]
    wanted = sorted({(g, name(rng.randrange(16))) for g in range(32) for _ in range(5)}) + [(None, name(2)), (4, None), (40, name(3))]
    model = {(name(a), name(b)): rng.choice([0.25, 0.5, 0.75]) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.6}
    return rated, wanted, model


def frames(spark, kind, rated, wanted, model):
    return (
        spark.createDataFrame(wanted, f"group int, target {kind}"),
        spark.createDataFrame(rated, f"group int, neighbour {kind}, rating double"),
        spark.createDataFrame([(a, b, s) for (a, b), s in model.items()], f"id1 {kind}, id2 {kind}, sim double"),
    )


@pytest.mark.parametrize("kind, name", [("int", lambda i: i), ("string", lambda i: f"i{i:02}")])
@pytest.mark.parametrize("k, normalized, small", [(3, True, False), (2, False, True), (50, True, True)])
def test_scores_by_brute_force(spark, monkeypatch, kind, name, k, normalized, small):
    if small:  # many blocks, pieces and steps
        for what, size in (("MODEL_ROWS", 20), ("MET", 100), ("STEP", 7)):
            monkeypatch.setattr(neighbours, what, size)
    rated, wanted, model = case(name)
    want = brute(wanted, rated, model | {(b, a): s for (a, b), s in model.items()}, k, normalized)
    got = {(r.group, r.target): r.score for r in neighbours.scores(*frames(spark, kind, rated, wanted, model), k, normalized).collect()}
    assert got.keys() == want.keys()
    assert all((got[p] is None) == (want[p] is None) and abs((got[p] or 0) - (want[p] or 0)) < 1e-9 for p in want)


@pytest.mark.parametrize("predict", [recommend.predict_by_items, recommend.predict_by_users])
def test_no_row_of_a_wanted_pair_and_a_neighbour_is_shuffled(spark, predict):
    rng = random.Random(2)
    ratings = spark.createDataFrame([(u, i, float(rng.randint(1, 5))) for u in range(40) for i in range(40)], "user int, item int, rating double")
    model = spark.createDataFrame([(a, b, 0.5) for a in range(40) for b in range(a + 1, 40)], "id1 int, id2 int, sim double")
    found = predict(ratings, ratings, model, 50)
    assert found.count() == 1600
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "neighbour" in line]
    assert "Window" not in plan


def test_without_a_model_the_means_are_left(spark):
    ratings = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 1, 4.0)], "user int, item int, rating double")
    none = spark.createDataFrame([], "id1 int, id2 int, sim double")
    asked = spark.createDataFrame([(1, 1), (9, 2), (2, 7)], "user int, item int")
    assert {(r.user, r.item): r.prediction for r in recommend.predict_by_items(ratings, asked, none).collect()} == {(1, 1): 3.0, (9, 2): 4.0, (2, 7): 3.5}
    assert {(r.user, r.item): r.prediction for r in recommend.predict_by_users(ratings, asked, none).collect()} == {(1, 1): 3.0, (9, 2): 3.5, (2, 7): 4.0}
