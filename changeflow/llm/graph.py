"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the smallest node reachable.

    Each round hangs larger neighbours, then smaller ones, under the smallest node known to both.
    A hub is never gathered: its minimum is a partially aggregated sum-up, and the join that hands
    it out is one whose hot keys adaptive execution splits. Rounds grow with the logarithm of the
    longest path. Null ends are dropped; a node linked only to itself is its own root.
    """
    ends = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    alone = ends.where("a = b").select("a", "b")
    edges = saved(
        ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.union(least).distinct(), "links")
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select("b", "b").union(alone).distinct().toDF("node", "root")
    found = edges.toDF("node", "root").union(roots)
    return found.groupBy("node").agg(F.min("root").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Number and check sum of the links: equal when a round changed nothing."""
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )
