"""Near-duplicate groups by SimHash and Golay-code fuzzy hashing.

A document's features are its distinct pairs of neighbouring tokens, all words and numbers among
them; the signs of the features' summed random vectors are its fingerprint of five segments of 23
bits. A segment is decoded to the indices of the Golay codewords within 4 of it: segments that differ
in at most two bits have one in common. Of two fingerprints that differ in at most 14 bits, some
segment does by the pigeonhole principle. An index has but 12 bits, and segments meet by chance; so
each key is an index with two features, the smallest of the document's under two hash functions.
Fifteen such, three to a segment, find most pairs of Jaccard similarity 0.75 or more. Below that
fingerprints differ in 20 to 30 bits, in four or more in each segment; so the smallest features under
three hash functions, without an index, give 15 more keys, of which a pair of similarity J shares one
with probability 1 - (1 - J^3)^15: 0.97 at 0.6. Fingerprints that meet under a key are verified by their
Hamming distance, then by the Jaccard similarity of the documents' whole feature sets. Verified pairs
are the edges of a graph whose components are the groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import golay
from tessera.llm.common import DOCUMENT_COLUMNS, documents_only, sliced
from tessera.session import cut, settled

SEGMENTS = 5
BITS = SEGMENTS * golay.LENGTH
#: Fingerprints of near duplicates differ in at most so many of the 115 bits.
MAX_DISTANCE = 34
#: Near duplicates share at least this part of their features.
MIN_JACCARD = 0.6
#: Numbers of nodes up to which they are broadcast to find their features; more are joined by shuffling.
BROADCAST_NODES = 500_000
_WORD = re.compile(r"\w+")
#: Keys of smallest features: so many bands of so many hash functions; and as many keys with a segment's index.
BANDS, BAND_ROWS = 15, 3
_CACHED_WORDS = 150_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Signer:
    """Features of texts; words that were seen before aren't hashed again."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def features(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the pairs of neighbouring tokens, of the token where there is one only."""
        low = (text or "").lower()
        words = _WORD.findall(low) or low.split()
        if len(self.known) > _CACHED_WORDS:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return np.unique(_mixed(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h)


def summed_signs(features: list[np.ndarray]) -> np.ndarray:
    """By feature set, the sum of its features' sign vectors, which are bits of their hashes."""
    sums = np.zeros((len(features), BITS), np.int32)
    for k, f in enumerate(features):
        for at in range(0, len(f), 8192):
            part = f[at : at + 8192]
            bits = np.unpackbits(np.stack([_mixed(part), _mixed(part ^ np.uint64(0x5851F42D4C957F2D))], axis=1).view(np.uint8), axis=1)
            sums[k] += 2 * bits[:, :BITS].sum(axis=0, dtype=np.int32) - len(part)
    return sums


def hashed_set(features: np.ndarray) -> np.ndarray:
    """A whole feature set in 32 bits a feature, for comparison."""
    return np.unique((features >> np.uint64(32)).astype(np.uint32))


def fingerprint_bits(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper (three segments) and lower (two segments) part of the fingerprints; a sum of 0 gives a 0."""
    bits = (sums > 0).astype(np.int64)
    weights = np.int64(1) << np.arange(3 * golay.LENGTH - 6, dtype=np.int64)  # 63 places fit a positive long
    return bits[:, : len(weights)] @ weights, bits[:, len(weights) :] @ weights[: BITS - len(weights)]


def segments(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Five 23-bit words of each fingerprint."""
    places = np.arange(63)
    bits = np.concatenate([(hi[:, None] >> places) & 1, (lo[:, None] >> places[: BITS - 63]) & 1], axis=1)
    return (bits.reshape(-1, SEGMENTS, golay.LENGTH) << np.arange(golay.LENGTH)).sum(axis=2)


_MIXERS = np.random.default_rng(23).integers(0, 1 << 63, (3, BANDS * BAND_ROWS), dtype=np.uint64)


def least_features(features: list[np.ndarray]) -> np.ndarray:
    """By feature set, the smallest hash of its features under each hash function."""
    least = np.zeros((len(features), BANDS * BAND_ROWS), np.uint64)
    factor, shift = _MIXERS[0] | np.uint64(1), _MIXERS[1]
    for k, h in enumerate(features):
        for i in range(0, len(h), 4096):
            low = ((h[i : i + 4096, None] * factor + shift) >> np.uint64(20)).min(axis=0)
            least[k] = np.minimum(least[k], low) if i else low
    return least


def _joined(parts: list[np.ndarray], tag: int) -> np.ndarray:
    key = np.full(parts[0].shape, tag * 0x9E3779B9 + 1, np.uint64)
    for x in parts:
        key = _mixed((key ^ (x + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15))
    return key


def band_keys(least: np.ndarray) -> np.ndarray:
    """A row of ``2 * BANDS`` numbers for each set: keys of three smallest features, then pairs that an index joins."""
    three = [_joined([least[:, r * BAND_ROWS + i] for i in range(BAND_ROWS)], r) for r in range(BANDS)]
    # Other combinations than the bands', so that these keys find other pairs.
    two = [_joined([least[:, r * BAND_ROWS + 2], least[:, (r + 1) % BANDS * BAND_ROWS]], BANDS + r) for r in range(BANDS)]
    return np.stack(three + two, axis=1).view(np.int64)


def keys_of(hi: np.ndarray, lo: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of each fingerprint: those of three features, and each pair with each index of its segment."""
    words = segments(hi, lo)
    lists = [golay.near(words[:, i]) for i in range(SEGMENTS)]
    every = np.arange(len(hi))
    rows, keys = [np.repeat(every, BANDS)], [np.ascontiguousarray(bands[:, :BANDS]).ravel()]
    for r in range(BANDS):
        for j in range(lists[0].shape[1]):
            index = lists[r % SEGMENTS][:, j]
            there = index >= 0
            rows.append(every[there])
            keys.append(_joined([bands[there, BANDS + r].view(np.uint64), index[there].astype(np.uint64)], 0).view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


_SIGNED = "doc_id long, thash long, node long, hi long, lo long, bands array<long>, features array<int>"


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, node, hi, lo, bands, features); node is null where a text has no token.

    Rows with equal features share a node; the last two columns are given once by each task, and null
    where the task has given them for an earlier row of the node.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, given = Signer(), set()
        for b in sliced(batches):
            every = [signer.features(t) for t in b.column("text").to_pylist()]
            hi, lo = fingerprint_bits(summed_signs(every))
            none = np.array([len(f) == 0 for f in every])
            node = [None if not len(f) else xxhash.xxh3_64_intdigest(f.tobytes()) - (1 << 63) for f in every]
            first = [n is not None and n not in given and not given.add(n) for n in node]
            bands = band_keys(least_features([f if x else f[:0] for f, x in zip(every, first)]))
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    b.column("thash"),
                    pa.array(node, pa.int64()),
                    pa.array(hi, pa.int64(), mask=none),
                    pa.array(lo, pa.int64(), mask=none),
                    pa.array([k if x else None for k, x in zip(bands, first)], pa.list_(pa.int64())),
                    pa.array([hashed_set(f).view(np.int32) if x else None for f, x in zip(every, first)], pa.list_(pa.int32())),
                ],
                names=["doc_id", "thash", "node", "hi", "lo", "bands", "features"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("thash"), "text").mapInArrow(sign, _SIGNED)


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, node) of all keys of ``nodes`` (node, hi, lo, bands)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                node, hi, lo = (b.column(c).slice(start, 2000).to_numpy(zero_copy_only=False) for c in ("node", "hi", "lo"))
                bands = b.column("bands").slice(start, 2000).flatten().to_numpy(zero_copy_only=False).reshape(len(node), 2 * BANDS)
                rows, keys = keys_of(hi, lo, bands)
                yield pa.record_batch([pa.array(keys), pa.array(node[rows])], names=["key", "node"])

    return nodes.select("node", "hi", "lo", "bands").mapInArrow(explode, "key long, node long")


def _meeting(nodes: DataFrame) -> DataFrame:
    """(key, node, hi, lo), parted and sorted by key: the rows of keys that several nodes have.

    Most keys are one node's alone; these leave before fingerprints are sent along.
    """

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            key, node = (t.column(c).to_numpy() for c in ("key", "node"))
            alike = key[1:] == key[:-1]
            met = np.concatenate([[False], alike]) | np.concatenate([alike, [False]])
            yield pa.record_batch([pa.array(key[met]), pa.array(node[met])], names=["key", "node"])

    met = _keyed(nodes).repartition("key").sortWithinPartitions("key").mapInArrow(several, "key long, node long")
    full = met.join(nodes.select("node", "hi", "lo"), "node").select("key", "node", "hi", "lo")
    return full.repartition("key").sortWithinPartitions("key", "node")


def _close(hi_a, lo_a, hi_b, lo_b, most: int) -> np.ndarray:
    return np.bitwise_count(hi_a ^ hi_b).astype(np.int32) + np.bitwise_count(lo_a ^ lo_b) <= most


def bucket_edges(key: np.ndarray, node: np.ndarray, hi: np.ndarray, lo: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever pairs within ``most`` bits connect, in buckets of equal, sorted keys.

    Every row is compared with its bucket's first; each row that isn't close to it is compared with
    all rows of the bucket. Two close rows are thus joined directly or by way of the first. Where an
    edge to the first fails a later test, :func:`rival_edges` compares what it stood for.
    """
    n = len(key)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    head = np.repeat(starts, sizes)
    others = head != np.arange(n)
    ok = _close(hi, lo, hi[head], lo[head], most)
    linked = others & ok
    left, right = [node[head[linked]]], [node[linked]]
    rest = np.flatnonzero(others & ~ok)
    width = np.repeat(sizes, sizes)[rest]
    cum = np.cumsum(width)
    at = 0
    while at < len(rest):  # blocks of about a million comparisons
        to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + 1_000_000)))
        r, w = rest[at:to], width[at:to]
        a = np.repeat(r, w)
        b = np.repeat(head[r], w) + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
        good = (a != b) & _close(hi[a], lo[a], hi[b], lo[b], most)
        left.append(node[a[good]])
        right.append(node[b[good]])
        at = to
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pairs[0], pairs[1]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by key, cut anew so that no bucket goes on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        change = np.flatnonzero(key != key[-1])  # the last bucket may go on in the next batch
        end = int(change[-1]) + 1 if len(change) else 0
        if end:
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = []
        elif held and held[-1].column("key")[-1].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def candidate_edges(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), distinct: nodes that meet under a key and are close, up to what connects them (see bucket_edges)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            a, b = bucket_edges(*(t.column(c).to_numpy() for c in ("key", "node", "hi", "lo")), max_distance)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return _meeting(nodes).mapInArrow(scan, "a long, b long").filter("a <> b").distinct()


def _similar(edges: DataFrame, sets: DataFrame, min_jaccard: float) -> DataFrame:
    """Edges whose whole feature sets' Jaccard similarity is high enough."""
    a = sets.select(F.col("node").alias("a"), F.col("features").alias("fa"))
    b = sets.select(F.col("node").alias("b"), F.col("features").alias("fb"))
    both = F.size(F.array_intersect("fa", "fb"))
    return edges.join(a, "a").join(b, "b").filter(both >= F.lit(min_jaccard) * (F.size("fa") + F.size("fb") - both)).select("a", "b")


def similar_rows(sets: list[np.ndarray], min_jaccard: float, rare: int = 16, rows: int = 512, columns: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places i < j whose sets' Jaccard similarity is high enough, by blocks of ``rows``.

    Exact for all pairs: features of few sets are counted pair by pair, the others by matrix products.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    if n < 2 or not sizes.sum():
        return
    owner = np.repeat(np.arange(n), sizes)
    _, feature, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(feature, kind="stable")
    feature, owner = feature[order], owner[order]
    few = df[feature] <= rare
    f, o = feature[few], owner[few]
    left, right = [], []
    for step in range(1, rare):  # pairs of rows of one feature that lie so far apart
        same = np.flatnonzero(f[step:] == f[:-step]) if len(f) > step else np.zeros(0, np.int64)
        left.append(o[same])
        right.append(o[same + step])
    left, right = np.concatenate(left), np.concatenate(right)
    f, o = feature[~few], owner[~few]
    kinds, f = np.unique(f, return_inverse=True)
    cuts = np.searchsorted(f, np.arange(0, len(kinds) + columns, columns))
    for lo in range(0, n, rows):
        hi = min(n, lo + rows)
        here = (left >= lo) & (left < hi)
        common = np.bincount((left[here] - lo) * n + right[here], minlength=(hi - lo) * n).reshape(hi - lo, n).astype(np.float32)
        for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
            there = np.zeros((n, min(columns, len(kinds) - k * columns)), np.float32)
            there[o[x:y], f[x:y] - k * columns] = 1
            common += there[lo:hi] @ there.T
        union = sizes[lo:hi, None] + sizes[None, :] - common
        i, j = np.nonzero(common >= np.float32(min_jaccard) * union - 1e-3)
        good = (common[i, j].astype(np.int64) >= min_jaccard * union[i, j].astype(np.int64)) & (j > i + lo)
        yield i[good] + lo, j[good]


def rival_rows(key: np.ndarray, hi: np.ndarray, lo: np.ndarray, label: np.ndarray, most: int, block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, by place, within ``most`` bits and of unlike labels, in buckets of equal, sorted keys; in blocks."""
    n = len(key)
    ends = np.searchsorted(key, key, side="right")
    width = ends - np.arange(n) - 1
    cum = np.cumsum(width)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(cum, (cum[at - 1] if at else 0) + block)))
        w = width[at:to]
        a = np.repeat(np.arange(at, min(to, n)), w)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w)
        good = label[a] != label[b]
        a, b = a[good], b[good]
        good = _close(hi[a], lo[a], hi[b], lo[b], most)
        yield a[good], b[good]
        at = to


def rival_edges(nodes: DataFrame, max_distance: int, min_jaccard: float) -> DataFrame:
    """(a, b), distinct: verified pairs that meet under a key and whose labels differ.

    ``nodes`` has node, label and features besides what keys are made of. Features go only to rows
    that are close to another in their bucket, and are compared there.
    """

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            key, node, hi, lo, label = (t.column(c).to_numpy() for c in ("key", "node", "hi", "lo", "label"))
            met = np.zeros(len(key), bool)
            for a, b in rival_rows(key, hi, lo, label, max_distance):
                met[a] = met[b] = True
            yield pa.record_batch([pa.array(key[met]), pa.array(node[met])], names=["key", "node"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _buckets(batches):
            key, node, hi, lo, label = (t.column(c).to_numpy() for c in ("key", "node", "hi", "lo", "label"))
            features = t.column("features")
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for x, y in zip(starts, [*starts[1:], len(key)]):
                sets = [v.values.to_numpy(zero_copy_only=False) for v in features[x:y]]
                for a, b in similar_rows(sets, min_jaccard):
                    a, b = a + x, b + x
                    good = (label[a] != label[b]) & _close(hi[a], lo[a], hi[b], lo[b], max_distance)
                    a, b = node[a[good]], node[b[good]]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    keyed = _meeting(nodes).join(nodes.select("node", "label"), "node").select("key", "node", "hi", "lo", "label")
    met = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(close, "key long, node long")
    whole = met.join(nodes.select("node", "hi", "lo", "label", "features"), "node").select("key", "node", "hi", "lo", "label", "features")
    return whole.repartition("key").sortWithinPartitions("key", "node").mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for the nodes of ``edges`` (a, b).

    Alternates large-star and small-star steps, each round written to the checkpoint folder, until
    the edges are stars around their smallest nodes.
    """
    now = cut(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct())
    before = None
    while True:
        # Large star: every larger neighbour of a node is joined to the smallest of its neighbourhood.
        both = now.select(F.col("lo").alias("x"), F.col("hi").alias("y")).union(now.select("hi", "lo"))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("m").alias("lo"), F.col("y").alias("hi")).filter("lo < hi").distinct()
        # Small star: a node and its smaller neighbours are joined to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        now = cut(joined.select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).filter("lo < hi").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(now.select("lo", "lo").distinct())


def _groups(docs: DataFrame, max_distance: int, min_jaccard: float) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (node, label) of the nodes that are near another."""
    signed = settled(signatures(docs), "signatures")
    given = signed.filter("bands is not null")
    nodes = settled(given.groupBy("node").agg(F.min("hi").alias("hi"), F.min("lo").alias("lo"), F.first("bands").alias("bands")), "nodes")
    edges = settled(candidate_edges(nodes, max_distance), "edges")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if ends.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        ends = F.broadcast(ends)
    sets = settled(given.select("node", "features").join(ends, "node").groupBy("node").agg(F.first("features").alias("features")), "sets")
    similar = settled(_similar(edges, sets, min_jaccard), "similar")
    labels = components(similar)
    # A bucket's first row stood for pairs of it only where its edges hold. Whatever an edge that failed
    # leaves apart is compared pair by pair, with all that an end of it was joined to.
    by_a, by_b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    named = edges.join(by_a, "a", "left").join(by_b, "b", "left").select(F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    apart = named.filter("la <> lb").select(F.explode(F.array("la", "lb")).alias("label")).distinct()
    ended = nodes.join(sets, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rivals = settled(ended.join(apart, "label", "left_semi"), "rivals")
    if rivals.isEmpty():
        return signed, labels
    return signed, components(similar.union(rival_edges(rivals, max_distance, min_jaccard)))


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """(doc_id, group_id, group_size, keep), one row per distinct pair of doc_id and text.

    ``group_id`` is the smallest doc_id of the group, ``group_size`` counts its documents, and
    ``keep`` holds for the one that stays: of the smallest doc_id, then of the smallest text hash.
    A document like no other is a group of its own, and so is one whose text is null, empty or
    without any token. Repeated rows (equal doc_id and text) are one document. A null doc_id comes
    first. Only doc_id and text are read; other columns are ignored whatever their names. Whole
    texts are read, however long. An empty table gives no rows.
    """
    signed, labels = _groups(documents_only(docs), max_distance, min_jaccard)
    rows = signed.select("doc_id", "thash", "node").distinct()
    own = F.xxhash64(F.lit("alone"), F.coalesce("doc_id", F.lit(-1)), "thash")
    named = rows.join(labels, "node", "left").select(
        "doc_id", "thash", F.coalesce("label", "node", own).alias("label"), F.when(F.col("node").isNull(), own).alias("alone")
    )
    best = named.groupBy("label", "alone").agg(F.min(F.struct("doc_id", "thash")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    right = best.select(F.col("label").alias("l"), F.col("alone").alias("o"), "best", "group_size")
    joined = named.join(right, (named.label == right.l) & named.alone.eqNullSafe(right.o))
    return joined.select(
        "doc_id",
        F.col("best.doc_id").alias("group_id"),
        "group_size",
        (F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.thash") == F.col("thash"))).alias("keep"),
    )


def drop_near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, min_jaccard: float = MIN_JACCARD) -> DataFrame:
    """``docs`` without the rows that :func:`near_duplicates` doesn't keep, with the five columns of documents.

    Only the rows to drop meet the texts again: documents that are near no other aren't grouped.
    """
    docs = documents_only(docs)
    signed, labels = _groups(docs, max_distance, min_jaccard)
    named = signed.select("doc_id", "thash", "node").distinct()
    # Also rows of one node: their features are equal.
    grouped = named.filter("node is not null").join(labels, "node", "left").select("doc_id", "thash", F.coalesce("label", "node").alias("label"))
    best = grouped.groupBy("label").agg(F.min(F.struct("doc_id", "thash")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = grouped.join(best.drop("n"), "label").filter(
        ~(F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.thash") == F.col("thash")))
    ).select(F.col("doc_id").alias("gone_id"), F.col("thash").alias("gone_hash"))
    kept = docs.withColumn("__h", F.xxhash64("text")).join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("__h") == F.col("gone_hash")), "left_anti"
    )
    return kept.select(*DOCUMENT_COLUMNS)
