import random
from collections import Counter

from fixtures import AWKWARD, documents
from pyspark.sql import functions as F

from tessera.llm import exactdedup


def brute(rows):
    """keep_id and number of duplicates by text."""
    best, n = {}, Counter()
    for i, t, *_ in rows:
        if t is not None:
            n[t] += 1
            best[t] = i if t not in best else min((best[t], i), key=lambda x: (x is not None, x or 0))
    return best, n


def check(rows, got):
    best, n = brute(rows)
    assert len(got) == len(rows)
    assert sum(not r.is_duplicate for r in got) == len(best) + sum(t is None for _, t, *_ in rows)
    want = Counter((i, i if t is None else best[t]) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.keep_id) for r in got) == want


def test_awkward(spark):
    docs = documents(spark, AWKWARD)
    check(AWKWARD, exactdedup.exact_duplicates(docs).collect())
    kept = exactdedup.drop_exact_duplicates(docs).collect()
    assert Counter(r.text for r in kept if r.text is not None) == Counter({t for _, t, *_ in AWKWARD if t is not None})
    assert sum(r.text is None for r in kept) == 2
    assert exactdedup.exact_duplicates(docs.limit(0)).count() == exactdedup.drop_exact_duplicates(docs.limit(0)).count() == 0


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    random.seed(2)
    rows = [(i, f"text {random.randrange(40)}", "en", "s") for i in range(200)]
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1).cast("binary")
    docs = documents(spark, rows)
    check(rows, exactdedup.exact_duplicates(docs, weak).collect())
    assert sorted(r.text for r in exactdedup.drop_exact_duplicates(docs, weak).collect()) == sorted({t for _, t, *_ in rows})


def test_files_give_locators(spark, tmp_path):
    rows = [(i, f"t{i % 3}", "en", "s") for i in range(9)]
    documents(spark, rows).drop("_metadata").write.parquet(str(tmp_path / "d"))
    got = exactdedup.exact_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()
    check(rows, got)
    assert all(r.path.startswith("file:") for r in got) and len({(r.path, r.row) for r in got}) == 9


def keys(spark, rows):
    located = exactdedup._located(documents(spark, rows)).filter("text is not null")
    return located.select(exactdedup.sha256(F.col("text")).alias("digest"), "doc_id", F.col("__loc").alias("loc"))


def test_the_state_goes_on(spark, tmp_path):
    state = "file://" + str(tmp_path / "state")
    exactdedup.seen_digests(keys(spark, [(5, "a", "en", "s"), (6, "b", "en", "s")]), state)
    seen = {r.first.doc_id: r.n for r in exactdedup.seen_digests(keys(spark, [(1, "a", "en", "s"), (2, "c", "en", "s")]), state).collect()}
    assert seen == {5: 2, 2: 1}  # the identifier that came first is stable, though 1 is smaller
    assert exactdedup.seen_digests(keys(spark, []), state).count() == 0


def weak(text):
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 1).cast("binary")


def test_calls_with_one_state_know_each_other(spark, tmp_path):
    """Rows come in four calls; digests collide within and between calls, and each text counts once over all."""
    rng = random.Random(4)
    state = "file://" + str(tmp_path / "the state")
    seen = {}
    for call in range(4):
        rows = [(call * 1000 + 100 - i, f"text {rng.randrange(60)}", "en", "s") for i in range(50)] + [(None, None, "en", "s")]
        path = str(tmp_path / f"call {call}")
        documents(spark, rows).drop("_metadata").write.parquet(path)
        docs = spark.read.parquet(path)
        got = exactdedup.exact_duplicates(docs, weak, state).collect()
        assert len(got) == len(rows)
        best = {}
        for i, t, *_ in rows:
            if t is not None:
                best[t] = min(best.get(t, i), i)
        text = {i: t for i, t, *_ in rows}
        for r in got:
            t = text[r.doc_id]
            if t is None:
                assert r.keep_id is None and not r.is_duplicate
            else:
                assert r.keep_id == seen.get(t, best[t]) and r.is_duplicate == (t in seen or best[t] != r.doc_id)
        seen = {**best, **seen}
        if call == 2:  # what comes again from the same place is what it was
            again = {r.doc_id: (r.keep_id, r.is_duplicate) for r in exactdedup.exact_duplicates(docs, weak, state).collect()}
            assert again == {r.doc_id: (r.keep_id, r.is_duplicate) for r in got}


def test_later_calls_drop_what_earlier_ones_had(spark, tmp_path):
    state = "file://" + str(tmp_path / "state")
    first = exactdedup.drop_exact_duplicates(documents(spark, [(7, "a", "en", "s"), (8, "b", "en", "s"), (9, "a", "en", "s")]), state=state)
    assert sorted(r.doc_id for r in first.collect()) == [7, 8]
    second = exactdedup.drop_exact_duplicates(documents(spark, [(1, "a", "en", "s"), (2, "c", "en", "s"), (3, None, "en", "s")]), state=state)
    assert sorted(r.doc_id for r in second.collect()) == [2, 3]


def test_joins_by_shuffling_give_the_same(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows = [(i, f"t{rng.randrange(30)}" if rng.random() < 0.6 else "hot " * 50, "en", "s") for i in range(300)]
    monkeypatch.setattr(exactdedup, "BROADCAST_ROWS", -1)
    check(rows, exactdedup.exact_duplicates(documents(spark, rows), weak).collect())
    check(rows, exactdedup.exact_duplicates(documents(spark, rows)).collect())
