"""Undirected graphs as tables of edges (src, dst) in both directions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pairs import pair_overlap
from tessera.session import cut

#: A component of at most so many edges, counted first, is broadcast: its betweenness is found root by root in
#: Python workers that each hold it. A larger one goes level by level over joins; both ways give the same.
BROADCAST_EDGES = 50_000


def co_occurrence_edges(df: DataFrame, id: str, item: str, threshold: int) -> DataFrame:
    """(src, dst) in both directions of ids with at least ``threshold`` items in common."""
    return both_directions(pair_overlap(df, id, item, threshold).select(F.col("id1").alias("src"), F.col("id2").alias("dst")))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once; loops and nulls left out."""
    ends = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.filter("src <> dst").select(F.inline(ends)).distinct()


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after so many synchronous rounds: the most frequent label of the neighbours, the smallest of equally frequent ones."""
    labels = vertices(edges).withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = edges.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
        labels = cut(best.select(F.col("src").alias("id"), "label"))
    return labels


def communities(labels: DataFrame) -> DataFrame:
    """(members), sorted, of each label."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("members")).select("members")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached. Each round takes the labels of neighbours, then of labels."""
    now = cut(edges.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = edges.join(now.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        better = now.join(near, "id").select("id", F.least("component", "c").alias("component"))
        jump = better.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = cut(better.join(jump, "component").select("id", F.col("further").alias("component")))
        if new.join(now.withColumnRenamed("component", "old"), "id").filter("component <> old").isEmpty():
            return new
        now = new


def bfs(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, level, n_paths) from every root (id): distances, and how many shortest paths there are. A null is no root."""
    front = cut(roots.filter("id IS NOT NULL").select(F.col("id").alias("root"), "id", F.lit(0).alias("level"), F.lit(1.0).alias("n_paths")))
    seen, level = front, 0
    while not front.isEmpty():
        level += 1
        step = front.join(edges, front.id == edges.src).groupBy("root", F.col("dst").alias("id")).agg(F.sum("n_paths").alias("n_paths"))
        front = cut(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(level).alias("level"), "n_paths"))
        seen = cut(seen.union(front))
    return seen


def bfs_parents(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """(root, id, parent, level, share) of the shortest-path graph: the share of the paths to ``id`` that come by ``parent``."""
    up = tree.select("root", F.col("id").alias("parent"), (F.col("level") + 1).alias("level"), F.col("n_paths").alias("up"))
    out = up.join(edges.select(F.col("src").alias("parent"), F.col("dst").alias("id")), "parent")
    return out.join(tree, ["root", "id", "level"]).select("root", "id", "parent", "level", (F.col("up") / F.col("n_paths")).alias("share"))


def edge_betweenness(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(a, b, betweenness), a < b: over all pairs, the share of shortest paths through the edge.

    Level by level: paths are counted outwards from all roots at once, then credit flows back inwards.
    """
    roots = vertices(edges) if roots is None else roots
    tree = bfs(edges, roots)
    down = cut(bfs_parents(edges, tree))
    deepest = down.agg(F.max("level")).first()[0]
    flows, below = None, None
    for level in range(deepest or 0, 0, -1):
        now = down.filter(F.col("level") == level)
        if below is None:
            credit = now.withColumn("credit", F.col("share"))
        else:
            credit = now.join(below, ["root", "id"], "left").withColumn("credit", F.col("share") * (1 + F.coalesce("got", F.lit(0.0))))
        credit = cut(credit.select("root", "id", "parent", "credit"))
        below = credit.groupBy("root", F.col("parent").alias("id")).agg(F.sum("credit").alias("got"))
        part = credit.select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"), "credit")
        flows = part if flows is None else flows.union(part)
    if flows is None:
        kind = edges.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame([], f"a {kind}, b {kind}, betweenness double")
    return flows.groupBy("a", "b").agg((F.sum("credit") / 2).alias("betweenness"))


def _from_root(root, neighbours: dict) -> dict:
    """Credit of each edge (smaller, larger) for the shortest paths from one root."""
    level, paths, order, parents = {root: 0}, {root: 1.0}, [root], {root: []}
    for v in order:
        for w in neighbours.get(v, ()):
            if w not in level:
                level[w], paths[w], parents[w] = level[v] + 1, 0.0, []
                order.append(w)
            if level[w] == level[v] + 1:
                paths[w] += paths[v]
                parents[w].append(v)
    got, out = dict.fromkeys(order, 1.0), {}
    for w in reversed(order[1:]):
        for v in parents[w]:
            c = got[w] * paths[v] / paths[w]
            got[v] += c
            out[min(v, w), max(v, w)] = c
    return out


def _betweenness_of(edges: DataFrame, part: list[tuple]) -> DataFrame:
    """:func:`edge_betweenness` of a graph small enough to be sent to every worker; the roots are spread over these."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    neighbours: dict = {}
    for a, b in part:
        neighbours.setdefault(a, set()).add(b)
        neighbours.setdefault(b, set()).add(a)
    neighbours = {k: sorted(v) for k, v in neighbours.items()}
    roots = spark.createDataFrame([(x,) for x in sorted(neighbours)], f"root {kind}")

    def credits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for root in batch["root"]:
                for e, c in _from_root(root, neighbours).items():
                    total[e] = total.get(e, 0.0) + c
        yield pd.DataFrame([(a, b, c) for (a, b), c in total.items()], columns=["a", "b", "c"])

    spread = roots.repartition(max(1, min(len(neighbours) // 64, 200)))
    return spread.mapInPandas(credits, f"a {kind}, b {kind}, c double").groupBy("a", "b").agg((F.sum("c") / 2).alias("betweenness"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity) of a labelling (id, label): over pairs of one label, (A - k k' / M) / M, with M directed edges.

    The sum over pairs is taken from sums by label, so no pair without an edge is ever made. Without
    any edge it is null.
    """
    m = edges.agg(F.nullif(F.count(F.lit(1)).cast("double"), F.lit(0.0)).alias("m"))
    deg = degrees(edges).join(labels, "id").groupBy("label").agg(F.sum("degree").alias("k"), F.sum(F.col("degree") * F.col("degree")).alias("kk"))
    inside = edges.join(labels.toDF("src", "l1"), "src").join(labels.toDF("dst", "l2"), "dst").filter("l1 = l2 and src < dst").agg(F.count(F.lit(1)).alias("inside"))
    expected = deg.agg(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2).alias("expected"))
    value = (F.col("inside") - F.coalesce("expected", F.lit(0.0)) / F.col("m")) / F.col("m")
    return m.crossJoin(inside).crossJoin(expected).select(value.alias("modularity"))


def girvan_newman(edges: DataFrame) -> tuple[DataFrame, float]:
    """(id, label) of the partition before modularity first falls, and that modularity.

    The edge of largest betweenness (to 9 places; the smallest edge of equal ones) is cut until the
    modularity of the components on the whole graph is less than the one before. After a cut only the
    component that it touched is computed again.
    """
    kept = cut(edges)
    scores = _scores(kept)
    labels = components(kept)
    every = cut(vertices(edges))
    best = modularity(edges, labels.withColumnRenamed("component", "label")).first()[0] or 0.0
    result = labels
    while True:
        top = scores.orderBy(F.desc(F.round("betweenness", 9)), "a", "b").first()
        if top is None:
            return result, best
        hit = labels.filter(F.col("id") == F.lit(top["a"])).select(F.col("component").alias("c"))
        touched = labels.join(hit, labels.component == hit.c, "left_semi").select("id")
        kept = cut(kept.filter(~(((F.col("src") == F.lit(top["a"])) & (F.col("dst") == F.lit(top["b"]))) | ((F.col("src") == F.lit(top["b"])) & (F.col("dst") == F.lit(top["a"]))))))
        part = cut(kept.join(touched, kept.src == touched.id, "left_semi"))
        others = scores.join(touched, scores.a == touched.id, "left_anti")
        scores = cut(others.union(_scores(part)))
        found = cut(components(part).union(labels.join(touched, "id", "left_anti")))
        # An id that no edge is left at is a component of its own.
        labels = cut(every.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
        now = modularity(edges, labels.withColumnRenamed("component", "label")).first()[0]
        if now < best:
            return result, best
        best, result = now, labels


def _scores(edges: DataFrame) -> DataFrame:
    once = edges.filter("src < dst")
    rows = once.limit(BROADCAST_EDGES + 1).collect()
    if len(rows) > BROADCAST_EDGES:
        return cut(edge_betweenness(edges))
    if not rows:
        return edge_betweenness(edges)
    return cut(_betweenness_of(edges, [tuple(r) for r in rows]))
