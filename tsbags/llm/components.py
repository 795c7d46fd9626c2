"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a minimum per node and a join, so no component is ever gathered in one place; Spark splits the join of a
node with very many neighbours by itself. Each round ends in a reliable checkpoint. As soon as there are so few edges
that one task holds them easily, that task finishes them by union-find, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsbags.session import cut


#: Edges that one task finishes: 16 bytes each in Arrow, about 200 in its union-find.
TASK_EDGES = 500_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and the least node of each one's component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        parent[max(x, y)] = min(x, y)
    for x in range(len(parent)):  # a parent is never larger, so it is final already
        parent[x] = parent[parent[x]]
    return nodes, nodes[np.asarray(parent, dtype=np.int64)]


def _finished(edges: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(f["u"].to_numpy(), f["v"].to_numpy()) for f in frames]
        if parts:
            nodes, labels = union_find(*map(np.concatenate, zip(*parts, strict=True)))
            yield pd.DataFrame({"node": nodes, "label": labels})

    return edges.coalesce(1).mapInPandas(run, "node long, label long")


def _to_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge with the least neighbour m of u."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = F.least("u", "m")
    return _to_least(both).filter("v > u").select(F.col("v").alias("u"), m.alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _to_least(down)
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
        .filter("u <> v").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the edges (a, b); label: the least node of its component.

    Self loops and repeated edges don't matter; nodes without an edge to another node have no row.
    """
    now = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0] > TASK_EDGES:
        held, now = now, cut(_small_star(_large_star(now)))
        after = mark(now)
        # stars: every node but the least of its component has one edge, to that one; equal sums are only a hint of it
        if after == before and now.join(held, ["u", "v"], "left_anti").isEmpty():
            break
        before = after
    else:
        return _finished(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
