"""Mixing sources to target weights.

Each source's documents are one stream of tokens, cut into blocks of fixed length. Every output
shard draws how many of its slots each source fills, from a multinomial distribution. The draws of a
source are numbered through all shards, and a pseudorandom permutation of its block numbers, another
one for every pass over the source, turns a draw into a block. Blocks then join slots by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import DOCUMENT_COLUMNS, documents_only, sliced
from tessera.llm.tokens import VOCABULARY, codec, release
from tessera.session import cut, settled

BLOCK, SHARD_SLOTS, SEED = 1024, 4096, 7
#: Shards whose draws are numbered in one window.
RUN = 4096
_TURNS = np.array([t * 0x9E3779B97F4A7C15 % 2**64 for t in range(6)], np.uint64)
#: Without given weights a source weighs as its tokens to this power: 1 as it is, 0 all alike.
TEMPERATURE = 0.5
NO_SOURCE = "unknown"
#: Rows of the offsets' table up to which it is broadcast.
BROADCAST_ROWS = 200_000


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(position: np.ndarray, n: int, key: np.ndarray) -> np.ndarray:
    """The images of ``position`` under permutations of 0..n-1, one for each value of ``key``.

    A Feistel network permutes the next power of four; what falls at n or beyond is put through it
    again until it falls below.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x, key = position.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right, k = x[todo] >> shift, x[todo] & mask, key[todo]
        for turn in _TURNS:
            left, right = right, left ^ (_mix64(right + k + turn) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _key(seed: int, source: int, epoch: np.ndarray) -> np.ndarray:
    start = np.uint64((seed * 1_000_003 + source) & 0xFFFFFFFFFFFFFFFF)
    return _mix64(_mix64(np.full(1, start)) + epoch.astype(np.uint64))


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, lang, source, part, before, n, tokens) of documents with tokens, each with an end token.

    ``before`` counts the source's tokens that come earlier in the same partition, ``part``. Written
    and read again, so that later steps agree on both.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, ends = codec(vocabulary), TaskContext.get().partitionId(), {}
        stop = np.array([c.end], "<u2").tobytes()
        for rows in sliced(batches):
            made = [c.encode(t) for t in rows.column("text").to_pylist()]
            before, n = [], []
            for s, x in zip(rows.column("source").to_pylist(), made):
                if x:
                    before.append(ends.get(s, 0))
                    n.append(len(x) // 2 + 1)
                    ends[s] = before[-1] + n[-1]
            kept = rows.filter(pa.array([bool(x) for x in made], pa.bool_()))
            yield pa.record_batch(
                [*(kept.column(x) for x in ("doc_id", "lang", "source")), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array([x + stop for x in made if x], pa.binary())],
                names=["doc_id", "lang", "source", "part", "before", "n", "tokens"],
            )
        release()

    named = docs.select("doc_id", "lang", F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), "text")
    return settled(named.mapInArrow(encode, "doc_id long, lang string, source string, part int, before long, n long, tokens binary"), "tokens")


def _segments(tokens: DataFrame, block: int) -> DataFrame:
    """(source, block, place, doc_id, lang, tokens, after): the part of each document in each block of its source."""
    totals = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    offsets = cut(offsets)  # a row for each source and partition; few enough, they go to the tokens instead of these to them
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    start = F.col("before") + F.col("offset")
    begun = tokens.join(offsets, ["source", "part"]).withColumn("start", start)

    def piece(b):
        lo = F.greatest(F.lit(0).cast("long"), b * block - F.col("start"))
        hi = F.least(F.col("n"), (b + 1) * block - F.col("start"))
        return F.struct(
            b.alias("block"),
            (F.col("start") + lo - b * block).alias("place"),
            F.substring("tokens", (lo * 2 + 1).cast("int"), ((hi - lo) * 2).cast("int")).alias("tokens"),
            F.substring("tokens", (hi * 2 + 1).cast("int"), F.lit(6)).alias("after"),
        )

    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block)
    return begun.select("source", "doc_id", "lang", F.inline(F.transform(F.sequence(first, last), piece)))


def _sources(tokens: DataFrame, block: int) -> list[tuple[str, int, int]]:
    """(source, tokens, blocks): one row per source is what the driver gets."""
    rows = tokens.groupBy("source").agg(F.sum("n").alias("n")).collect()
    return sorted((r["source"], r["n"], -(-r["n"] // block)) for r in rows)


def shares(sources: list[tuple[str, int, int]], weights: dict[str, float] | None, temperature: float) -> np.ndarray:
    """Probabilities by source. Sources that ``weights`` doesn't name get nothing; names without tokens are left out."""
    w = np.array([float(n) ** temperature if weights is None else float(weights.get(s, 0)) for s, n, _ in sources])
    if len(w) and (w < 0).any() or len(w) and w.sum() <= 0:
        raise ValueError("weights must not be negative, and one of a source with tokens must be positive")
    return w / w.sum() if len(w) else w


def draw_slots(
    spark, sources: list[tuple[str, int, int]], p: np.ndarray, n_slots: int, shard_slots: int = SHARD_SLOTS, seed: int = SEED
) -> DataFrame:
    """(shard, slot, source, epoch, block) of all slots."""
    names = [s for s, _, _ in sources]
    blocks = [b for _, _, b in sources]

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard in b["id"]:
                size = min(shard_slots, n_slots - shard * shard_slots)
                n = np.random.default_rng([seed, shard]).multinomial(size, p)
                yield pd.DataFrame({"shard": shard, "s": np.arange(len(p)), "n": n})

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, drawn in zip(b["shard"], b["drawn"]):
                s = np.array([x["s"] for x in drawn])
                n = np.array([x["n"] for x in drawn])
                first = np.array([x["first"] for x in drawn])
                order = np.random.default_rng([seed, shard, 1]).permutation(int(n.sum()))  # slots of a source lie anywhere
                rows = []
                for i, lo in enumerate(np.cumsum(n) - n):
                    d = first[i] + np.arange(n[i])
                    epoch, at = np.divmod(d, blocks[s[i]])
                    rows.append(pd.DataFrame({"slot": order[lo : lo + n[i]], "source": names[s[i]], "epoch": epoch, "block": permuted(at, blocks[s[i]], _key(seed, int(s[i]), epoch))}))
                yield pd.concat(rows).assign(shard=shard)[["shard", "slot", "source", "epoch", "block"]]

    if not sources or n_slots <= 0:
        return spark.createDataFrame([], "shard long, slot long, source string, epoch long, block long")
    n_shards = -(-n_slots // shard_slots)
    # Draws are numbered by runs of shards, then within each run, so that no window goes over all shards.
    drawn = spark.range(n_shards).mapInPandas(counts, "shard long, s int, n long").withColumn("run", F.floor(F.col("shard") / RUN))
    runs = drawn.groupBy("s", "run").agg(F.sum("n").alias("in_run"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("s", "run", F.coalesce(F.sum("in_run").over(before("s", "run")), F.lit(0)).alias("start"))
    local = drawn.withColumn("local", F.coalesce(F.sum("n").over(before("s", "run", "shard")), F.lit(0)))
    numbered = local.join(starts, ["s", "run"]).select("shard", "s", "n", (F.col("start") + F.col("local")).alias("first"))
    # A row here is thousands of slots when filled: the number of tasks is set by the shards, not by the bytes that come in.
    tasks = max(1, min(n_shards, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    spread = numbered.filter("n > 0").repartition(tasks, "shard")
    by_shard = spread.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("s", "n", "first"))).alias("drawn"))
    slots = by_shard.mapInPandas(fill, "shard long, slot long, source string, epoch long, block long")
    # There are as many slots as the data has blocks, which Spark can't tell: they must not be broadcast.
    return slots.hint("shuffle_hash")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    n_slots: int | None = None,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(shard, slot, source, epoch, block, n_tokens, doc_ids, tokens), one row per slot.

    ``tokens`` are little-endian 16-bit ids; ``doc_ids`` are the documents that the block has parts
    of, in order. ``n_slots`` is as many as there are blocks if not given. A source drawn more often
    than it has blocks is gone through again, in another order, ``epoch`` counting its passes. The
    last block of a source may be shorter. A source's stream follows the order of its rows in the
    input's partitions: there are no ties. Needs doc_id, text, lang and source; other columns are ignored whatever their
    names. Null and empty texts have no tokens and no place. A null source is the source "unknown".
    Repeated rows are as many documents. Texts may be of any length. An empty table gives no rows.
    """
    tokens = tokenised(documents_only(docs), vocabulary)
    sources = _sources(tokens, block)
    slots = draw_slots(docs.sparkSession, sources, shares(sources, weights, temperature), sum(b for _, _, b in sources) if n_slots is None else n_slots, shard_slots, seed)
    parts = _segments(tokens, block).select("source", "block", F.struct("place", "doc_id", "tokens").alias("part"))
    blocks = parts.groupBy("source", "block").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["tokens"]))
    return blocks.join(slots, ["source", "block"]).select(
        "shard", "slot", "source", "epoch", "block", (F.length(joined) / 2).cast("int").alias("n_tokens"), F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"), joined.alias("tokens")
    )


def mixed_documents(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """The documents' parts in the drawn blocks, as rows with the five columns of documents.

    A document within one block comes whole; of one that spans several, each drawn block gives the
    part of its text that lies there. A block that is drawn several times gives its parts as often.
    Null and empty texts have no tokens and no row; a null source reads "unknown". Repeated rows are as
    many documents; rows follow their order in the input's partitions, so there are no ties. Columns
    beyond the five are left out, and ``n_chars`` is counted anew. Texts may be of any length. An empty
    table gives no rows.
    """
    tokens = tokenised(documents_only(docs), vocabulary)
    sources = _sources(tokens, block)
    slots = draw_slots(docs.sparkSession, sources, shares(sources, weights, temperature), sum(b for _, _, b in sources), shard_slots, seed)

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(vocabulary).decode
        for b in sliced(batches):
            made = [decode(ids, after) for ids, after in zip(b.column("tokens").to_pylist(), b.column("after").to_pylist())]
            yield pa.record_batch([b.column("doc_id"), pa.array(made, pa.string()), b.column("lang"), b.column("source")], names=["doc_id", "text", "lang", "source"])
        release()

    drawn = _segments(tokens, block).join(slots.select("source", "block").hint("shuffle_hash"), ["source", "block"])
    rows = drawn.select("doc_id", "lang", "source", "tokens", "after").mapInArrow(text, "doc_id long, text string, lang string, source string")
    return rows.filter("text <> ''").withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)
