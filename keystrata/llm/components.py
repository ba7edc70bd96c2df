"""Connected components of links, by DataFrame operations on the links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import apart, cut, hand_out


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node that is reachable, for every node that has a link.

    Each round hooks every node's root to the smallest root next to it and then follows parents twice (pointer jumping),
    so the rounds grow with the logarithm of a component's width. A round's table replaces the last in the shared
    folder; only a count comes to the driver. Links between nodes that already share a root are dropped each round.
    """
    both = links.select("a", "b").where("a <> b")
    edges = cut(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        # edges are between roots; each larger root takes the smallest root that it touches
        hook = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        parents = cut(hook, "hooks")
        for _ in range(2):
            above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parents = parents.join(apart(above), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        parents = cut(parents, "parents")
        hop = parents.select(F.col("node").alias("component"), "up")
        labels = cut(hand_out(labels, "node", ["component"], hop, "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        a = parents.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        b = parents.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        x, y = F.coalesce("a_up", "a"), F.coalesce("b_up", "b")
        edges = cut(edges.join(apart(a), "a", "left").join(apart(b), "b", "left").where(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels
