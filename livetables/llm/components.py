"""Connected components of an edge list, as joins: every round replaces links by links to smaller neighbours.

A round is one large-star and one small-star step: each node's larger neighbours, then its smaller ones, are linked to the
smallest node seen there. Components keep together in every step, long chains shrink by more than half each round, and a node with very many neighbours is
only ever aggregated to its minimum and joined back. Rounds are written to the shared folder and the previous one is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from livetables.llm.base import Steps


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest among the node and its neighbours. Edges are (u, v), u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(steps: Steps, edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge in (a, b); root is the smallest node of its component."""
    now = steps.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        new = steps.keep(_small_star(_large_star(now)), "edges")
        changed = new.exceptAll(now).limit(1).count()
        steps.drop(now)
        now = new
        if not changed:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
