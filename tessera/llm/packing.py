"""Best-fit packing planned on a histogram of lengths.

Best-fit decreasing is run over counts of equal lengths, not over documents: bins in one state are
one range of bin numbers, and all pieces of a length that go to a range are one entry of the plan.
The work and the size of the plan depend on the capacity alone. Pieces then take their planned slots
by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents_only, sliced
from tessera.llm.tokens import VOCABULARY, codec, release
from tessera.session import settled

CAPACITY = 2048
#: Rows of the plan up to which it is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 50_000
#: Ranks within a length are counted in parts of about so many pieces, so that no length is one task's work.
PART_PIECES = 500_000


def plan(histogram: list[tuple[int, int]], capacity: int = CAPACITY) -> tuple[list[tuple[int, ...]], int]:
    """Entries (length, rank_lo, rank_hi, bin_lo, per_bin, offset) and the number of bins.

    The piece of rank x, rank_lo <= x < rank_hi, goes to bin ``bin_lo + (x - rank_lo) // per_bin`` at
    ``offset + (x - rank_lo) % per_bin * length``. This is what best-fit decreasing does piece by
    piece: longest first, each into the fullest bin that has room, of equally full ones the first.
    """
    entries: list[tuple[int, ...]] = []
    ranges: dict[int, list[tuple[int, int]]] = {}  # by room left: (first bin, bins), sorted
    rooms: list[int] = []
    n_bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                bisect.insort(rooms, room)
            bisect.insort(ranges[room], (first, n))

    for length, count in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} isn't in 1..{capacity}")
        rank = 0
        while rank < count:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                room, per = capacity, capacity // length
                first, n = n_bins, -(-(count - rank) // per)
                n_bins += n
            else:
                room = rooms[i]
                per = room // length
                first, n = ranges[room].pop(0)
                if not ranges[room]:
                    del ranges[room], rooms[i]
            full, left = divmod(count - rank, per)
            if full >= n:
                full, left = n, 0
            taken = full * per + left
            entries.append((length, rank, rank + taken, first, per, capacity - room))
            put(room - per * length, first, full)
            if left:
                put(room - left * length, first + full, 1)
            put(room, first + full + bool(left), n - full - bool(left))
            rank += taken
    return entries, n_bins


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tie, n_tokens); tie tells rows of one doc_id apart. Null and empty texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(vocabulary).encode
        for b in sliced(batches):
            n = [len(encode(t)) // 2 for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), b.column("tie"), pa.array(n, pa.int64())], names=["doc_id", "tie", "n_tokens"])
        release()

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(count, "doc_id long, tie long, n_tokens long")


def _ranked(pieces: DataFrame, parts: int) -> DataFrame:
    """``pieces`` with ``rank``: counted from 0 within each length, part by part."""
    parted = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "tie", "chunk"), F.lit(parts)))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "tie", "chunk")
    local = parted.withColumn("local", F.row_number().over(order) - 1)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return local.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))


def pack(lengths: DataFrame, capacity: int = CAPACITY, n_tokens: str | Column = "n_tokens", part_pieces: int = PART_PIECES) -> DataFrame:
    """(doc_id, chunk, start, length, bin, offset): where each piece of each document goes.

    ``lengths`` has doc_id, tie and n_tokens. A document of more than ``capacity`` tokens is cut
    into pieces of ``capacity`` and a rest. A length that is null or 0 takes no slot: its row has
    nulls in ``bin`` and ``offset``. Rows with equal doc_id and tie are packed one by one, their
    slots given out in any order. Bins are numbered from 0, the longest pieces first. Pieces of one
    length are alike to the plan; they take its slots by a hash of their documents. Columns beyond these
    are left out, and an empty table gives no rows.
    """
    n = F.coalesce(n_tokens if isinstance(n_tokens, Column) else F.col(n_tokens), F.lit(0))
    whole = lengths.select("doc_id", "tie", n.alias("n"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))
    cut = whole.filter("n > 0").select("doc_id", "tie", F.explode(chunks).alias("chunk"), "n")
    start = F.col("chunk") * capacity
    pieces = settled(cut.select("doc_id", "tie", "chunk", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("length")), "pieces")
    histogram = [(r["length"], r["count"]) for r in pieces.groupBy("length").count().collect()]  # capacity rows at most
    entries, _ = plan(histogram, capacity)
    spark = lengths.sparkSession
    names = ["at", "rank_lo", "rank_hi", "bin_lo", "per_bin", "base"]
    slots = spark.createDataFrame(pd.DataFrame(entries, columns=names, dtype="int64"), ", ".join(f"{x} long" for x in names))
    if len(entries) <= BROADCAST_ROWS:
        slots = F.broadcast(slots)
    within = F.col("rank") - F.col("rank_lo")
    placed = _ranked(pieces, max(1, -(-max((n for _, n in histogram), default=0) // part_pieces))).join(slots, (F.col("length") == F.col("at")) & F.col("rank").between(F.col("rank_lo"), F.col("rank_hi") - 1))
    done = placed.select(
        "doc_id",
        "chunk",
        "start",
        F.col("length").cast("long").alias("length"),
        (F.col("bin_lo") + F.floor(within / F.col("per_bin"))).alias("bin"),
        (F.col("base") + within % F.col("per_bin") * F.col("length")).alias("offset"),
    )
    nothing = whole.filter("n <= 0").select("doc_id", *[F.lit(x).cast("long").alias(c) for c, x in (("chunk", 0), ("start", 0), ("length", 0), ("bin", None), ("offset", None))])
    return done.unionByName(nothing)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`pack` by token counts, each document followed by one end token.

    Needs doc_id and text; other columns are ignored whatever their names. Null and empty texts
    take no slot. Repeated rows are packed each; ties are as in :func:`pack`. Texts of any length are
    counted whole. An empty table gives no rows.
    """
    lengths = settled(token_lengths(documents_only(docs), vocabulary), "lengths")
    return pack(lengths, capacity, F.when(F.col("n_tokens") > 0, F.col("n_tokens") + 1))
