"""Secret scans by dictionary-primed zstandard novelty.

A candidate is a run of key characters in a sensitive context: after a word such as token or
password, or with a prefix that credentials have. Its novelty is what it adds in compressed bytes
to the code around it, with zstandard primed by that code and a dictionary of the corpus's identifiers.
Identifiers and repeated names add little; random strings add nearly their length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents_only, sliced
from tessera.session import settled

#: Size of the dictionary: a model of fixed size, made from counts over all documents.
DICTIONARY_BYTES = 64 * 1024
#: Longer candidates are measured in pieces of at most so many characters: from 64 bytes on zstandard codes
#: literals by Huffman, and what a random string adds by its length depends on its alphabet.
PIECE = 63
#: Characters on each side of a candidate that are its surroundings, unless given otherwise.
AROUND = 256
MIN_LENGTH, MIN_NOVELTY = 12, 0.9
LEVEL = 3

_WORDS = r"(?:api[_-]?key|apikey|access[_-]?key|private[_-]?key|secret(?:[_-]?key)?|client[_-]?secret|token|auth(?:orization|[_-]?key)?|bearer|passw(?:or)?d|passphrase|pwd|credentials?)"
_PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|npm_|eyJ)"
_KEY = r"[A-Za-z0-9+/_.~-]"
#: A colon, an equals sign, an arrow or "is", with or without quotes, on one line; after "bearer" a space will do.
_GIVES = r"[\"'`]?[ \t]{0,3}(?::=|=>|[:=]|\bis\b)[ \t]{0,3}[\"'`]?"
_CANDIDATE = re.compile(
    rf"(?P<word>{_WORDS})[\w-]*+(?:{_GIVES}|(?<=[Bb]earer)[ \t]+)(?P<a>{_KEY}{{{MIN_LENGTH},}}={{0,2}})"
    rf"|(?<![A-Za-z0-9_])(?P<b>{_PREFIX}{_KEY}{{{MIN_LENGTH - 2},}}={{0,2}})",
    re.I,
)
_PREFIXED = re.compile(_PREFIX)
_IDENTIFIER = re.compile(r"[^\W\d][\w$]{2,}")
#: What of a candidate may be words: a secret's own letters are rarely in this form.
_WORD_PART = re.compile(r"[A-Z]?[a-z]{3,}")


#: Every candidate has one of these before it or in it; most texts have none, which is quickly seen.
_STEMS = ("key", "secret", "token", "auth", "bearer", "passw", "passp", "pwd", "credent")
_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xox", "AIza", "npm_", "eyJ")


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, context) of the candidates; context is the sensitive word, or "prefix"."""
    low = text.casefold()
    if not any(x in low for x in _STEMS) and not any(x in text for x in _MARKS):
        return []
    out = []
    for m in _CANDIDATE.finditer(text):
        part = "a" if m["a"] else "b"
        if part == "b" and not _PREFIXED.match(m["b"]):  # prefixes are in capitals or not; words may be in either
            continue
        start, end = m.span(part)
        while end > start and text[end - 1] in ".-":
            end -= 1
        if end - start >= MIN_LENGTH:
            out.append((start, end, m["word"].lower() if m["word"] else "prefix"))
    return out


def _blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text, as long as before, with spaces for the candidates."""
    out, at = [], 0
    for s, e, _ in spans:
        out += [text[at:s], " " * (e - s)]
        at = e
    return "".join([*out, text[at:]])


def identifier_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each identifier stands in all the texts; of candidates, the words in them.

    A secret that is copied often must not make itself known.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for b in sliced(batches):
            for text in b.column("text").to_pylist():
                if text:
                    spans = candidates(text)
                    seen.update(_IDENTIFIER.findall(_blanked(text, spans) if spans else text))
                    for start, end, _ in spans:
                        seen.update(_WORD_PART.findall(text, start, end))
            if len(seen) > 200_000:
                yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The most frequent identifiers up to ``size`` bytes, the most frequent last, where zstandard finds them cheapest."""
    counts = settled(identifier_counts(docs).select("word", "n", F.octet_length("word").alias("bytes")), "identifiers")
    # Counts are put in classes, 32 to each power of two, of which there are some 2,000 whatever the corpus. The
    # words of the classes that fill the dictionary are all that the driver gets.
    level = F.floor(F.log2("n") * 32).cast("int")
    classes = counts.groupBy(level.alias("level")).agg(F.sum(F.col("bytes") + 1).alias("bytes"), F.min("n").alias("n")).collect()
    least, room = 1, size
    for c in sorted(classes, key=lambda c: -c["level"]):
        least, room = c["n"], room - c["bytes"]
        if room <= 0:
            break
    # An identifier has three bytes at least, so no more rows than this can be needed.
    rows = counts.filter(F.col("n") >= least).select("word", "n").orderBy(F.desc("n"), "word").limit(size // 4).collect()
    words, total = [], 0
    for r in rows:
        w = r["word"].encode()
        if total + len(w) + 1 > size:
            break
        words.append(w)
        total += len(w) + 1
    return b"".join(w + b" " for w in reversed(words))


class Novelty:
    """Measures strings against a dictionary of identifiers that the surroundings are appended to.

    The string alone is compressed. The difference between compressing the surroundings with and
    without it would be too rough: a few more literals can change how zstandard codes all of them.
    A string of more than ``PIECE`` characters is compressed in about equal pieces, each with up to
    ``DICTIONARY_BYTES`` before it among what is known, so that what repeats within the string adds little.
    """

    def __init__(self, primer: bytes):
        self._primer = primer

    def added(self, before: str, candidate: str, after: str) -> int:
        """Bytes that the candidate takes beyond what an empty frame does."""
        pieces = -(-len(candidate) // PIECE)
        cuts = [i * len(candidate) // pieces for i in range(pieces + 1)]
        # What stands before is nearest.
        return sum(self._piece(after + before, candidate[max(0, i - DICTIONARY_BYTES) : i], candidate[i:j]) for i, j in zip(cuts, cuts[1:]))

    def _piece(self, around: str, earlier: str, piece: str) -> int:
        known = self._primer + around.encode("utf-8", "surrogatepass") + b" " * 8 + earlier.encode()
        primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False).compress
        return max(0, len(size(piece.encode())) - len(size(b"")))


_FOUND = "doc_id long, start int, end int, context string, found string, added_bytes int, novelty double"


def secret_scan(docs: DataFrame, min_novelty: float = MIN_NOVELTY, dictionary_bytes: int = DICTIONARY_BYTES, around: int = AROUND) -> DataFrame:
    """(doc_id, start, end, context, found, added_bytes, novelty), one row per reported string.

    ``start`` and ``end`` count characters of the text, ``context`` is the sensitive word before the
    string, or "prefix" for a prefix of credentials; ``novelty`` is ``added_bytes`` by the string's
    length, and strings of less than ``min_novelty`` aren't reported. ``around`` characters on each side
    are the code that a string is measured against. Identifiers that are equally frequent come into the
    dictionary by the alphabet. Needs doc_id and text; other
    columns are ignored whatever their names. Null and empty texts have no secrets. Repeated rows are
    reported as often; a string is measured afresh wherever it stands. Whole texts are scanned,
    however long. An empty table gives no rows.
    """
    docs = documents_only(docs).select("doc_id", "text")
    primer = dictionary(docs, dictionary_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty(primer).added
        for b in sliced(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                spans = candidates(text or "")
                # What a candidate stands in is measured without candidates: a secret said twice is one still.
                bare = _blanked(text, spans) if spans else ""
                for s, e, context in spans:
                    n = measure(bare[max(0, s - around) : s], text[s:e], bare[e : e + around])
                    if n >= min_novelty * (e - s):
                        rows.append((doc_id, s, e, context, text[s:e], n, n / (e - s)))
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return docs.mapInArrow(scan, _FOUND)
