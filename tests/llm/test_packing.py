import random
from collections import Counter

import duckdb
import pytest
from fixtures import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import packing
from tessera.llm.tokens import codec


def best_fit(items, capacity):
    """Best-fit decreasing, piece by piece: room left by bin."""
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        i = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(capacity)
        rooms[i] -= x
    return rooms


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=90))))
def test_plan_is_best_fit_decreasing(case):
    capacity, items = case
    entries, n = packing.plan(list(Counter(items).items()), capacity)
    rooms = [capacity] * n
    for length, lo, hi, first, per, _ in entries:
        for x in range(lo, hi):
            rooms[first + (x - lo) // per] -= length
    assert rooms == best_fit(items, capacity)


def test_plan_does_not_grow_with_counts():
    small = packing.plan([(n, 3 + n % 5) for n in range(1, 2049)])[0]
    large = packing.plan([(n, (3 + n % 5) * 10**9) for n in range(1, 2049)])[0]
    assert len(large) < 4 * 2048 and len(small) < 4 * 2048


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        if r.bin is not None:
            by.setdefault(r.bin, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    assert set(by) == set(range(len(by)))


@pytest.mark.parametrize("part_pieces", [3, packing.PART_PIECES])
def test_every_token_has_one_place(spark, part_pieces):
    random.seed(8)
    n = [random.choice([0, None, 1, 5, 16, 17, 40, random.randint(1, 100)]) for _ in range(300)]
    lengths = spark.createDataFrame([(i // 2, i, x) for i, x in enumerate(n)], "doc_id long, tie long, n_tokens long")
    rows = packing.pack(lengths, 16, part_pieces=part_pieces).collect()
    check_layout(rows, 16)
    pieces = [min(16, x - at) for x in n if x for at in range(0, x, 16)]
    assert Counter(r.length for r in rows if r.bin is not None) == Counter(pieces)
    assert sorted(16 - sum(r.length for r in rows if r.bin == b) for b in {r.bin for r in rows if r.bin is not None}) == sorted(best_fit(pieces, 16))
    assert sum(r.bin is None for r in rows) == sum(not x for x in n)


def test_awkward(spark):
    docs = documents(spark, AWKWARD)
    rows = packing.pack_documents(docs, 64).collect()
    check_layout(rows, 64)
    c = codec()
    want = Counter()
    for i, t, *_ in AWKWARD:
        want[i] += len(c.whole(t)) // 2 + 1 if t else 0
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want and packing.pack_documents(docs.limit(0)).count() == 0


def test_tokens_are_tiktokens_and_parts_join_to_the_text():
    c = codec()
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    random.seed(1)
    for t in [*texts, "a  b", "a \n b", "a\n\n b  ", "\n", "  ", " x", "x ", "🎉字符 " * 9, "it's 'quoted'  don't"]:
        ids = c.encode(t)
        assert ids == c.whole(t)
        n = len(ids) // 2
        cuts = [0, *sorted(random.randint(0, n) for _ in range(6)), n]
        assert "".join(c.decode(ids[2 * a : 2 * b], ids[2 * b : 2 * b + 6]) for a, b in zip(cuts, cuts[1:])) == t
