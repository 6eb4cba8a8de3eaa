"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.session import cut_lineage


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node.

    Alternates large-star and small-star steps: each node hands its neighbours to the smallest one. Every step is a
    minimum per node (summed in partial aggregates) and a join that adaptive execution may split, so a node that holds
    a third of all links is no bottleneck. Each round is written to the shared folder. Links of a node to itself add it
    as a component of its own. An empty list gives an empty result.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 2**40)).first()
        if tuple(now) == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
                edges.select("b", "b").distinct().join(edges.where("a <> b").select(F.col("a").alias("_a")).distinct(),
                                                      F.col("_a") == edges["b"], "left_anti")
            ).groupBy("node").agg(F.min("component").alias("component"))
        state = tuple(now)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.union(edges.where("a = b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).union(low).distinct())
