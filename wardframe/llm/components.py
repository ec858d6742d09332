"""Connected components by contraction.

Every round hooks each node to its least neighbour and replaces the nodes of
the links by what they hook to, so at least half of the linked nodes vanish.
Rounds end when no link is left; the hooks of all rounds are then followed
back.  Each round reads and writes tables, a hot node's links are only ever
aggregated (on the map side first) or joined with one row per node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardframe.session import pin


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of the links
    (a, b)."""
    edges = pin(links.select("a", "b").where("a <> b"))
    empty = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
        hooks.append(hook)
        for end in ("a", "b"):
            edges = edges.join(hook, edges[end] == hook["node"]).drop(end, "node").withColumnRenamed("component", end)
        edges = pin(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not hooks:
        return empty
    found = hooks.pop()
    while hooks:
        hook = hooks.pop()
        later = found.select(F.col("node").alias("component"), F.col("component").alias("root"))
        found = hook.join(later, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return found
