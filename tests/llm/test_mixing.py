from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import AWKWARD, documents

from tessera.llm import mixing
from tessera.llm.tokens import codec


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    seen = set()
    for epoch in range(4):
        key = mixing._key(7, 3, np.full(n, epoch))
        image = mixing.permuted(np.arange(n), n, key).tolist()
        assert sorted(image) == list(range(n))
        seen.add(tuple(image))
    assert n < 10 or len(seen) == 4


def test_draws_against_the_definition(spark):
    sources = [("a", 700, 7), ("b", 300, 3), ("c", 100, 1)]
    p = np.array([0.5, 0.3, 0.2])
    rows = mixing.draw_slots(spark, sources, p, 250, 60, 5).collect()
    assert Counter(r.shard for r in rows) == {0: 60, 1: 60, 2: 60, 3: 60, 4: 10}
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(60 if s < 4 else 10)) for s in range(5))
    drawn = Counter((r.shard, r.source) for r in rows)
    for s in range(5):
        want = np.random.default_rng([5, s]).multinomial(60 if s < 4 else 10, p)
        assert [drawn[s, n] for n in "abc"] == want.tolist()
    for name, _, blocks in sources:  # whole passes, and one that isn't finished
        by_epoch = defaultdict(list)
        for r in rows:
            if r.source == name:
                by_epoch[r.epoch].append(r.block)
        last = max(by_epoch)
        assert all(sorted(by_epoch[e]) == list(range(blocks)) for e in range(last)) and len(set(by_epoch[last])) == len(by_epoch[last])


def test_blocks_hold_the_sources_streams(spark):
    rows = [(i, f"document {i} says " + "word " * (i % 40), "en", "ab"[i % 2]) for i in range(120)]
    docs = documents(spark, rows).coalesce(1)
    got = mixing.mix(docs, {"a": 1.0, "b": 1.0, "gone": 3.0}, n_slots=600, block=50, shard_slots=64).collect()
    assert len(got) == 600
    c = codec()
    end = np.array([c.end], "<u2").tobytes()
    for source in "ab":
        stream = b"".join(c.encode(t) + end for _, t, _, s in rows if s == source)
        blocks = {r.block: (bytes(r.tokens), r.n_tokens) for r in got if r.source == source}
        assert set(blocks) == set(range(-(-len(stream) // 100)))
        assert b"".join(blocks[k][0] for k in sorted(blocks)) == stream
        assert all(n == 50 for k, (_, n) in blocks.items() if k < max(blocks))
    share = sum(r.source == "a" for r in got) / 600
    assert abs(share - 0.5) < 0.1


def test_weights(spark):
    s = [("a", 400, 4), ("b", 100, 1)]
    assert mixing.shares(s, None, 0.5).tolist() == [2 / 3, 1 / 3]
    assert mixing.shares(s, {"b": 2}, 1).tolist() == [0, 1]
    with pytest.raises(ValueError):
        mixing.shares(s, {"z": 1}, 1)


def test_documents_parts_are_their_texts(spark):
    rows = [(i, f"dœcument {i} 🎉 " + "wörd字 " * (i % 50), "fr", "s") for i in range(60)]
    parts = mixing.mixed_documents(documents(spark, rows), block=32).collect()
    text = {i: t for i, t, *_ in rows}
    assert parts and all(p.text in text[p.doc_id] and p.n_chars == len(p.text) and p.lang == "fr" and "�" not in p.text for p in parts)
    every = mixing._segments(mixing.tokenised(documents(spark, rows)), 32).collect()
    c = codec()
    joined = defaultdict(str)
    for r in sorted(every, key=lambda r: (r.block, r.place)):
        joined[r.doc_id] += c.decode(bytes(r.tokens), bytes(r.after))
    assert joined == text


def test_awkward(spark):
    docs = documents(spark, AWKWARD)
    got = mixing.mix(docs, block=64, shard_slots=16).collect()
    assert {r.source for r in got} <= {"a", "b", "c", "unknown"} and all(r.n_tokens == len(r.tokens) // 2 for r in got)
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_documents(docs.limit(0)).count() == 0
