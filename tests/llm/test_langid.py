import os
import random
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from fixtures import AWKWARD, documents

from tessera.llm import langid

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.01/documents.parquet"


def naive_vector(text, dim, seed):
    """The definition: sum over trigrams of the product of rotated letter vectors."""
    letter = lambda c: np.random.default_rng([seed, ord(c)]).integers(0, 2, dim, dtype=np.int8).astype(int) * 2 - 1
    kept = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    kept = f" {kept} "
    total = np.zeros(dim, int)
    for a, b, c in zip(kept, kept[1:], kept[2:]):
        total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return total


@pytest.mark.parametrize("text", ["Hello, wörld! Hello.", "a", "日本語 text", "x" * 50 + " y"])
def test_vectors_follow_the_definition(text):
    p = langid.Profiler(64, 3)
    got = p.vectors([text, None, "", text])
    assert (got[0] == naive_vector(text, 64, 3)).all() and (got[3] == got[0]).all() and not got[1:3].any()


def test_many_letters_are_counted_like_few():
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 300))) + " abc"
    assert (langid.Profiler(32, 1).vectors([text])[0] == naive_vector(text, 32, 1)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(SF)
    train, test = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    models = langid.prototypes(train, per_language=50)
    rows = langid.scored(test, models).select("lang", "__lid.predicted").collect()
    assert sum(r.lang == r.predicted for r in rows) >= 0.98 * len(rows)


def test_rejects_what_is_no_language_of_the_corpus_and_keeps_the_rest(spark):
    random.seed(4)
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}'").fetchall()
    noise = " ".join("".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randint(2, 9))) for _ in range(200))
    foreign = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. " * 3
    docs = documents(spark, [*rows, (-1, noise, "en", "z"), (-2, foreign, "en", "z"), (-3, "1 2 3", "en", "z")])
    kept = {r.doc_id for r in langid.keep_known_languages(docs).collect()}
    assert not kept & {-1, -2, -3} and len(kept) >= 0.995 * len(rows)


def test_awkward(spark):
    docs = documents(spark, AWKWARD)
    rows = langid.language_id(docs).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        if r.doc_id in (2, 3, 4, 5, 6):
            assert r.predicted is r.similarity is r.margin is None and not r.accepted
    assert langid.keep_known_languages(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert langid.language_id(docs.limit(0)).count() == 0
    unlabelled = documents(spark, [(1, "some text", None, None)])
    assert [tuple(r) for r in langid.language_id(unlabelled).collect()] == [(1, None, None, None, None, True)]


def test_long_text_of_many_letters_takes_little_memory():
    code = """
import random, resource, sys
from tessera.llm import langid
random.seed(1)
text = "".join(chr(random.randrange(0x4E00, 0x9FFF)) for _ in range(1_000_000))
p = langid.Profiler()
p.vectors(["a few words"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
v = p.vectors([text])
assert v.any() and p.sizes == [1_000_000]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert int(got.stdout) < 1000


def test_blocks_of_trigrams_add_up(monkeypatch):
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 500))) + " and some more words"
    whole = langid.Profiler(32, 1).vectors([text, "and some"])
    monkeypatch.setattr(langid, "_BLOCK", 7)
    assert (langid.Profiler(32, 1).vectors([text, "and some"]) == whole).all()


def test_short_foreign_texts_are_judged_too(spark):
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}'").fetchall()
    foreign = "Все люди рождаются свободными и равными в своем достоинстве и правах".split()
    short = [(-i - 1, " ".join(foreign[i : i + 5]), "en", "z") for i in range(len(foreign) - 4)]
    kept = {r.doc_id for r in langid.language_id(documents(spark, [*rows, *short])).filter("accepted").collect()}
    assert sum(i < 0 for i in kept) <= len(short) // 4
    tiny = [i for i, t, _, _ in rows if t and len(t) < 120]
    assert sum(i in kept for i in tiny) >= 0.9 * len(tiny)


def test_the_scores_and_ties_follow_the_definition(spark):
    """Prototypes and cosines by brute force; of equal cosines the language first in the alphabet counts."""
    texts = [("aa", "eins zwei drei"), ("aa", "zwei drei vier"), ("bb", "uno dos tres"), ("cc", "uno dos tres")]
    docs = documents(spark, [(i, t, l, "s") for i, (l, t) in enumerate(texts)])
    vectors = {t: naive_vector(t, langid.DIM, langid.SEED).astype(float) for _, t in texts}
    unit = lambda v: v / np.linalg.norm(v)
    proto = {l: unit(sum(unit(vectors[t]) for k, t in texts if k == l)) for l in ("aa", "bb", "cc")}
    for r in langid.language_id(docs).collect():
        text = texts[r.doc_id][1]
        cos = {l: float(unit(vectors[text]) @ p) for l, p in proto.items()}
        best = sorted(cos.values(), reverse=True)
        assert r.predicted == min(l for l in cos if cos[l] > best[0] - 1e-6)
        assert abs(r.similarity - best[0]) < 1e-5 and abs(r.margin - (best[0] - best[1])) < 1e-5
