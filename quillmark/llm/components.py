"""Connected components of an edge list by alternating large-star and small-star steps.

Edges are (u, v) of one sortable type. Every step shuffles the edges once or twice by node; lineage is cut by a checkpoint each
round, and only a change count reaches the driver. A node's neighbours are reduced by min() with map-side combining, so that a
hub needs no group in memory; the join that follows splits hubs from the other nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


#: Edges of one node from which on it counts as a hub.
HUB_EDGES = 1_000_000


def lowered(edges: DataFrame, low: DataFrame, n_edges: int, hub_edges: int) -> DataFrame:
    """Edges (u, v) with their node's minimum m from ``low`` (u, m, degree).

    Hubs are joined by broadcast, so that no task gets all edges of one: at most n_edges / hub_edges nodes can be hubs.
    """
    if n_edges < hub_edges:
        return edges.join(low.drop("degree"), "u")
    hubs = low.where(F.col("degree") >= hub_edges)
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low.where(F.col("degree") < hub_edges).drop("degree"), "u")
    return edges.join(F.broadcast(hubs.drop("degree")), "u").unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60, hub_edges: int | None = None) -> DataFrame:
    """(node, root): for every node of an edge the smallest node that it reaches. Loops and repeated edges are allowed."""
    e = checkpointed(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, n_edges = None, e.count()
    for _ in range(max_rounds):
        least = max(hub_edges or HUB_EDGES, n_edges // 1000)  # so that no more than 2,000 nodes are hubs
        # large-star: every larger neighbour is linked to the smallest neighbour (or the node itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = lowered(both, low, n_edges, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: every smaller neighbour, and the node, is linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = lowered(large, low, n_edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n_edges = now, now[0]
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


class Forest:
    """Union-find over hashable keys, to reduce the links of one task to at most one per member."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def link(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self):
        for x in list(self.parent):
            if (r := self.find(x)) != x:
                yield x, r
