import random
import re
from collections import Counter

import zstandard
from fixtures import AWKWARD, documents

from tessera.llm import secrets

CODE = "def get_access_token(client, settings):\n    token = client.authentication_token(settings.user_name)\n    return token\n"


def hexes(n, rng):
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def test_finds_random_strings_in_sensitive_contexts(spark):
    rng = random.Random(1)
    rows, want = [], []
    for i in range(60):
        secret = [hexes(40, rng), hexes(20, rng), "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16))][i % 3]
        line = [f'token = "{secret}"', f"password={secret}", f"id {secret} end"][i % 3]
        text = CODE + line + "\n" + CODE
        rows.append((i, text, "en", "s"))
        want.append((i, text.index(secret), text.index(secret) + len(secret), secret))
    rows += [(100 + i, CODE * (i + 1), "en", "s") for i in range(40)]
    rows += [(200, 'checksum "' + hexes(40, rng) + '"', "en", "s"), (201, 'token = "authentication_token"', "en", "s"), (202, "password=aaaaaaaaaaaaaaaaaaaaaaaa", "en", "s")]
    got = secrets.secret_scan(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.found) for r in got) == want


def test_dictionary_counts_all_identifiers_but_no_candidates(spark):
    rows = [(i, 'alpha beta_gamma token = "zz99zz99zz99zz99"', "en", "s") for i in range(5)] + [(9, "alpha", "en", "s")]
    counts = {r.word: r.n for r in secrets.identifier_counts(documents(spark, rows)).collect()}
    assert counts == {"alpha": 6, "beta_gamma": 5, "token": 5}
    assert secrets.dictionary(documents(spark, rows), 18) == b"beta_gamma alpha "


def test_repeated_secrets_are_each_new(spark):
    secret = hexes(40, random.Random(3))
    text = f'token = "{secret}" and token = "{secret}"'
    assert len(secrets.secret_scan(documents(spark, [(1, text, "en", "s")])).collect()) == 2


def test_awkward(spark):
    docs = documents(spark, [*AWKWARD, (50, "x " * 100_000 + "password=" + hexes(24, random.Random(5)), None, None)])
    assert [(r.doc_id, r.start) for r in secrets.secret_scan(docs).collect()] == [(50, 200_009)]
    assert secrets.secret_scan(docs.limit(0)).count() == 0


def test_long_random_strings_of_small_alphabets_are_new(spark):
    rng = random.Random(8)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    primer = secrets.dictionary(documents(spark, [(1, CODE, "en", "s")]))
    measure = secrets.Novelty(primer).added
    for alphabet in alphabets:
        for n in [63, 64, 65, 96, 128, 256, 400, 1000]:
            strings = ["".join(rng.choice(alphabet) for _ in range(n)) for _ in range(40)]
            found = sum(measure(CODE, x, CODE) >= secrets.MIN_NOVELTY * n for x in strings)
            assert found >= 38, (alphabet, n, found)
    for repeated in ["authentication_token." * 20, "a" * 300, hexes(20, rng) * 20]:
        assert measure(CODE, repeated, CODE) < secrets.MIN_NOVELTY * len(repeated)
    jwt = "eyJ" + "".join(rng.choice(alphabets[2][:62]) for _ in range(600))
    rows = [(1, f'token = "{hexes(64, rng)}"', "en", "s"), (2, f"bearer {jwt}", "en", "s")]
    assert sorted(r.doc_id for r in secrets.secret_scan(documents(spark, rows)).collect()) == [1, 2]


def brute_scan(rows, size, around):
    """Dictionary and novelty over plain lists: identifiers counted in one Counter and sorted whole, each string compressed by itself."""
    counts = Counter()
    for _, text in rows:
        spans = secrets.candidates(text or "")
        bare = list(text or "")
        for s, e, _ in spans:
            bare[s:e] = " " * (e - s)
            counts.update(re.findall("[A-Z]?[a-z]{3,}", text[s:e]))
        counts.update(re.findall(r"[^\W\d][\w$]{2,}", "".join(bare)))
    words, total = [], 0
    for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if total + len(w.encode()) + 1 > size:
            break
        words.append(w)
        total += len(w.encode()) + 1
    primer = "".join(w + " " for w in reversed(words)).encode()
    out = []
    for doc_id, text in rows:
        spans = secrets.candidates(text or "")
        bare = list(text or "")
        for s, e, _ in spans:
            bare[s:e] = " " * (e - s)
        bare = "".join(bare)
        for s, e, context in spans:
            n, k = 0, -(-(e - s) // secrets.PIECE)
            for i in range(k):
                lo, hi = s + i * (e - s) // k, s + (i + 1) * (e - s) // k
                known = primer + (bare[e : e + around] + bare[max(0, s - around) : s]).encode() + b" " * 8 + text[s:lo].encode()
                c = zstandard.ZstdCompressor(level=secrets.LEVEL, dict_data=zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
                n += max(0, len(c.compress(text[lo:hi].encode())) - len(c.compress(b"")))
            if n / (e - s) >= secrets.MIN_NOVELTY:
                out.append((doc_id, s, e, context, text[s:e], n))
    return sorted(out), primer


def test_scan_and_dictionary_against_brute_force(spark):
    rng = random.Random(12)
    names = ["".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(3, 60))) for _ in range(400)]
    rows = []
    for i in range(200):
        code = " ".join(rng.choice(names[: rng.choice([5, 50, 400])]) for _ in range(rng.randint(0, 80)))
        secret = rng.choice([hexes(rng.choice([12, 32, 64, 130]), rng), rng.choice(names), "_".join(rng.sample(names, 2)), "sk-" + hexes(30, rng)])
        rows.append((i, code + rng.choice([' token = "', " password: ", " api_key_of_the_very_long_named_service_account=", " x "]) + secret + '" ' + code[::-1]))
    rows += [(500, None), (501, "")]
    docs = documents(spark, [(i, t, "en", "s") for i, t in rows])
    for size, around in ((2_000, 256), (600, 40), (65_536, 0)):
        want, primer = brute_scan(rows, size, around)
        assert secrets.dictionary(docs, size) == primer
        got = sorted((r.doc_id, r.start, r.end, r.context, r.found, r.added_bytes) for r in secrets.secret_scan(docs, dictionary_bytes=size, around=around).collect())
        assert got == want and len(want) > 50


def test_the_quick_look_misses_no_candidate():
    rng = random.Random(2)
    names = ["api-key", "APIKEY", "access_key", "private-key", "secret", "client_secret", "ToKen", "authorization", "auth_key", "bearer", "password", "passwd", "passphrase", "PWD", "credential", "\u017fecret", "api_\u212aey"]
    starts = ["AKIA", "ASIA", "ghp_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "AIza", "npm_", "eyJ"]
    for text in [*(f"x {n}: {hexes(30, rng)}" for n in names), *(f"x {p}{hexes(30, rng)}" for p in starts)]:
        assert len(secrets.candidates(text)) == 1, text
