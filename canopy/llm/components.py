"""Connected components of an edge table, by alternating star contractions.

Each round points every node's larger neighbours at its smallest neighbour
(large star) and then its smaller neighbours likewise (small star); the
rounds end when the edges no longer change, which is after O(log^2 n)
rounds. A node's edges are never gathered: its minimum is a
pre-aggregated ``min`` joined back to the edges, a join whose hot keys
Spark can split. Every round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with u's least node m: (v, m), without loops."""
    return (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = _star(both.where("v > u"), least).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    hooked = _star(large, down)
    kept = down.select("u", F.col("m").alias("v"))
    return (hooked.union(kept).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (long columns u, v).

    ``root`` is the component's smallest node. Loops and repeated or
    reversed edges are allowed; a node with only loops is left out, as is
    every node without an edge. An empty table gives an empty table.
    """
    clean = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
             .where("u <> v").distinct())
    now, mark = written(clean, "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        now = written(_round(now), "edges")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
