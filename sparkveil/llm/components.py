"""Connected components of a large graph by alternating stars.

Each round replaces every node's neighbours by links to the smallest one seen
(large star: to larger neighbours, small star: to smaller ones), which needs
O(log n) rounds of aggregations and equi-joins and never gathers a component
in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_min(rows: DataFrame, least) -> DataFrame:
    """``rows`` (u, v) with m, the smallest value of u's group; the minima are staged, so that both join sides are plain shuffles that a skewed join can split."""
    minima = stage(rows.groupBy("u").agg(F.min("v").alias("m")).select("u", least.alias("m")), "minima")
    return rows.join(minima, "u"), minima


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: bigint); root is the component's smallest node.

    Nodes without an edge don't appear. Null ends, loops and repeated edges are
    ignored. An empty input gives an empty result. What comes back reads one
    staged table; all others are deleted.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = stage(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, minima = _with_min(both, F.least("u", "m"))
        large = stage(joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        unstage(minima)
        unstage(e)
        joined, minima = _with_min(large, F.col("m"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(minima.select("u", F.col("m").alias("v"))).distinct()
        e = stage(small, "small")
        unstage(minima)
        unstage(large)
        state = _state(e)
        if state == before:
            break
        before = state
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
