"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. A trigram's vector binds its letters by elementwise
product after rotating each by its position; a document's vector bundles (adds) the vectors of
all its trigrams; a language's prototype bundles the documents labelled with it. A document gets
the language whose prototype has the largest cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import DOCUMENT_COLUMNS, documents_only

DIM = 1024
SEED = 20_011
#: Labelled rows per language that the prototypes are made from, at most.
SAMPLE_PER_LANGUAGE = 2_000
#: A document resembles none of the languages if its best cosine is below this, less for short texts: the
#: cosine that a text of a language reaches grows with its trigrams n as the square root of n / (n + HALFWAY).
MIN_SIMILARITY, HALFWAY = 0.2, 100
_CHUNK_CHARS = 400_000
_CHUNK_DOCS = 96
_MAX_CACHED = 40_000
#: Trigrams whose vectors are added at a time.
_BLOCK = 8_192


class Profiler:
    """Document vectors. The letters' vectors depend on the seed and the code point alone."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letter_rows = np.zeros((0, dim), np.int8)
        self.index = np.full(0x110000, -1, np.int32)  # of a code point; 0 is the space
        self.index[32] = 0
        self.points = [32]
        self.trigrams: dict[int, int] = {}
        self.rows = np.zeros((1024, dim), np.int8)
        self._grow()

    def _grow(self) -> None:
        new = self.points[len(self.letter_rows) :]
        made = [np.random.default_rng([self.seed, p]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1 for p in new]
        self.letter_rows = np.concatenate([self.letter_rows, np.array(made, np.int8).reshape(-1, self.dim)])

    def _letters(self, text: str) -> np.ndarray:
        """Letter indices of the lower-cased text; every run of other characters is one 0."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        at = self.index[points]
        if (at == -1).any():
            for p in np.unique(points[at == -1]).tolist():
                if chr(p).isalpha():
                    self.index[p] = len(self.points)
                    self.points.append(p)
                else:
                    self.index[p] = -2
            self._grow()
            at = self.index[points]
        at = np.where(at < 0, 0, at)
        at = np.concatenate([[0], at, [0]])
        keep = np.ones(len(at), bool)
        keep[1:] = (at[1:] != 0) | (at[:-1] != 0)
        return at[keep]

    def trigram_rows(self, ids: np.ndarray) -> np.ndarray:
        """Vectors of trigrams, given as a << 42 | b << 21 | c of letter indices."""
        known = self.trigrams
        if len(known) > _MAX_CACHED:
            known.clear()
        new = [i for i in ids.tolist() if i not in known]
        if new:
            n = np.array(new, np.int64)
            a, b, c = n >> 42, (n >> 21) & 0x1FFFFF, n & 0x1FFFFF
            made = np.roll(self.letter_rows[a], 2, axis=1) * np.roll(self.letter_rows[b], 1, axis=1) * self.letter_rows[c]
            while len(self.rows) < len(known) + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for i, row in zip(new, made):
                self.rows[len(known)] = row
                known[i] = len(known)
        return self.rows[[known[i] for i in ids.tolist()]].astype(np.float32)

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """One row per text; zeros where a text is null or has no letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        self.sizes: list[int] = []  # trigrams of each text
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and stop - start < _CHUNK_DOCS and (stop == start or chars < _CHUNK_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            out[start:stop] = self._chunk(texts[start:stop])
            start = stop
        return out

    def _chunk(self, texts: list[str | None]) -> np.ndarray:
        letters = [self._letters(t) if t else np.zeros(0, np.int32) for t in texts]
        letters = [x if len(x) > 2 else np.zeros(0, np.int32) for x in letters]
        tri = [(x[:-2].astype(np.int64) << 42) | (x[1:-1].astype(np.int64) << 21) | x[2:] for x in letters]
        sizes = [len(x) for x in tri]
        self.sizes += sizes
        if not sum(sizes):
            return np.zeros((len(texts), self.dim), np.float32)
        k = len(self.points)
        every = np.concatenate(tri)
        if k <= 160:  # a dense table of all trigrams is small: count without sorting
            dense = ((every >> 42) * k + ((every >> 21) & 0x1FFFFF)) * k + (every & 0x1FFFFF)
            there = np.zeros(k**3, bool)
            there[dense] = True
            ids = np.flatnonzero(there)
            place = np.cumsum(there, dtype=np.int32) - 1
            which = place[dense]
            ids = ((ids // (k * k)) << 42) | ((ids // k % k) << 21) | (ids % k)
        else:
            ids, which = np.unique(every, return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), sizes)
        out = np.zeros((len(texts), self.dim), np.float32)
        if len(ids) > _BLOCK:  # trigrams in order, so that each block is a slice
            order = np.argsort(which, kind="stable")
            doc, which = doc[order], which[order]
        for lo in range(0, len(ids), _BLOCK):
            n = min(_BLOCK, len(ids) - lo)
            here = slice(*np.searchsorted(which, [lo, lo + n])) if len(ids) > _BLOCK else slice(None)
            counts = np.bincount(doc[here] * n + (which[here] - lo), minlength=len(texts) * n).reshape(len(texts), n)
            out += counts.astype(np.float32) @ self.trigram_rows(ids[lo : lo + n])
        return out


def _labelled_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """The ``per_language`` labelled rows of each language whose hashes are smallest."""
    spread = F.xxhash64(F.lit("sample"), F.col("doc_id"), F.col("n"))
    keys = (
        docs.filter(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull())
        .select("lang", spread.alias("h"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .filter(F.col("rank") <= per_language)
        .groupBy("lang")
        .agg(F.max("h").alias("most"))
        .collect()  # one row per language
    )
    most = F.lit(None).cast("long")
    for r in keys:
        most = F.when(F.col("lang") == r["lang"], F.lit(r["most"])).otherwise(most)
    return docs.filter(F.col("text").isNotNull() & (spread <= most))


def prototypes(
    docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, dim: int = DIM, seed: int = SEED
) -> dict[str, np.ndarray]:
    """Unit-length prototypes by language, bundled from at most ``per_language`` labelled rows each.

    The sample is a bound on the classifier's training rows, not on the rows that it is applied to.
    Rows with a null or empty ``lang`` or a null text teach nothing; without any labelled row the
    result is empty. Which rows are drawn depends on ``doc_id`` and ``n_chars`` alone.
    """
    rows = docs.select("doc_id", "text", "lang", F.coalesce(F.col("n_chars"), F.lit(-1)).alias("n"))

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiler, sums = Profiler(dim, seed), {}
        for b in batches:
            for start in range(0, len(b), _CHUNK_DOCS):
                part = b.iloc[start : start + _CHUNK_DOCS]
                v = profiler.vectors(part["text"].tolist()).astype(np.float64)
                lengths = np.linalg.norm(v, axis=1, keepdims=True)
                v /= np.where(lengths == 0, 1, lengths)
                for lang, at in part.groupby("lang").indices.items():
                    sums[lang] = sums.get(lang, 0) + v[at].sum(axis=0)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.tolist() for x in sums.values()]})

    parts = _labelled_sample(rows, per_language).select("lang", "text").mapInPandas(bundle, "lang string, v array<double>")
    # Partial sums are added by dimension before they reach the driver: languages x dim numbers.
    total = (
        parts.select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        .collect()
    )
    out = {}
    for r in sorted(total, key=lambda r: r["lang"]):
        v = np.array([x["x"] for x in r["v"]], np.float64)
        if np.linalg.norm(v) > 0:
            out[r["lang"]] = (v / np.linalg.norm(v)).astype(np.float32)
    return out


_RESULT = "predicted string, similarity double, margin double, trigrams long"


def scored(docs: DataFrame, models: dict[str, np.ndarray], dim: int = DIM, seed: int = SEED) -> DataFrame:
    """``docs`` with a struct column ``__lid`` of predicted, similarity and margin over the second language."""
    names = sorted(models)
    matrix = np.stack([models[n] for n in names], axis=1) if names else np.zeros((dim, 0), np.float32)

    fields = [pa.field("predicted", pa.string()), pa.field("similarity", pa.float64()), pa.field("margin", pa.float64()), pa.field("trigrams", pa.int64())]

    def some(profiler: Profiler, texts: list[str | None]) -> pa.StructArray:
        v = profiler.vectors(texts)
        lengths = np.linalg.norm(v, axis=1)
        none = (lengths == 0) | (not names)
        cos = (v @ matrix) / np.where(lengths == 0, 1, lengths)[:, None] if names else np.zeros((len(v), 1))
        order = np.argsort(-cos, axis=1, kind="stable")
        best = np.take_along_axis(cos, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(cos, order[:, 1:2], 1)[:, 0] if len(names) > 1 else np.zeros(len(v))
        found = [
            pa.array([None if no else names[i] for i, no in zip(order[:, 0], none)], pa.string()),
            pa.array(best, pa.float64(), mask=none),
            pa.array(best - second, pa.float64(), mask=none),
            pa.array(profiler.sizes, pa.int64()),
        ]
        return pa.StructArray.from_arrays(found, fields=fields)

    @F.arrow_udf(_RESULT)
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        profiler = Profiler(dim, seed)
        for b in batches:
            parts = [some(profiler, b.slice(at, _CHUNK_DOCS).to_pylist()) for at in range(0, len(b), _CHUNK_DOCS)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))
        pa.default_memory_pool().release_unused()

    return docs.withColumn("__lid", identify(F.col("text")))


def _accepted(min_similarity: float, halfway: float, have_models: bool) -> Column:
    """Rejected: no letters, or no language that resembles the text as much as its number of trigrams allows."""
    if not have_models:
        return F.lit(True)
    found = F.col("__lid")
    n = found["trigrams"]
    return found["predicted"].isNotNull() & (found["similarity"] >= min_similarity * F.sqrt(n / (n + F.lit(float(halfway)))))


def language_id(
    docs: DataFrame,
    per_language: int = SAMPLE_PER_LANGUAGE,
    min_similarity: float = MIN_SIMILARITY,
    halfway: float = HALFWAY,
    dim: int = DIM,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, lang, predicted, similarity, margin, accepted), one row per row of ``docs``.

    Needs doc_id, text and lang; other columns are ignored whatever their names. ``predicted``,
    ``similarity`` and ``margin`` are null for a text that is null, empty or without letters, and
    such a row isn't accepted. Any other text of n trigrams is accepted if its cosine with some language
    is at least ``min_similarity`` times the square root of n / (n + ``halfway``): one rule for texts of
    every length. Equal cosines go to the language first in the alphabet. Without any
    labelled row nothing can be told apart: all three are null and every row is accepted. Repeated
    rows are scored alike. Whole texts are profiled, however long. An empty table gives no rows.
    """
    docs = documents_only(docs)
    models = prototypes(docs, per_language, dim, seed)
    out = scored(docs.select("doc_id", "text", "lang"), models, dim, seed)
    return out.select(
        "doc_id",
        "lang",
        F.col("__lid.predicted").alias("predicted"),
        F.col("__lid.similarity").alias("similarity"),
        F.col("__lid.margin").alias("margin"),
        _accepted(min_similarity, halfway, bool(models)).alias("accepted"),
    )


def keep_known_languages(
    docs: DataFrame,
    per_language: int = SAMPLE_PER_LANGUAGE,
    min_similarity: float = MIN_SIMILARITY,
    halfway: float = HALFWAY,
    dim: int = DIM,
    seed: int = SEED,
) -> DataFrame:
    """The rows of ``docs`` that :func:`language_id` accepts, with the five columns of documents.

    Rows whose text is null, empty or without letters leave. Without any labelled row all stay.
    Repeated rows stay or leave together; columns beyond the five are left out. Texts of any length
    are read whole, and equal cosines decide nothing here. An empty table gives no rows.
    """
    docs = documents_only(docs)
    models = prototypes(docs, per_language, dim, seed)
    out = scored(docs, models, dim, seed).filter(_accepted(min_similarity, halfway, bool(models)))
    return out.select(*DOCUMENT_COLUMNS)
