"""Connected components of an edge table of any orderable node type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component (the smallest node reachable); nodes without another are not listed.

    Alternating large-star and small-star steps: group-bys with partial aggregation and joins. Each
    round is cut to the checkpoint folder, so that a lost executor repeats one round at most.
    """
    cur = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        nxt = cut(large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        centres = nxt.select(F.col("v").alias("u")).distinct()
        more = nxt.groupBy("u").count().where("count > 1").select("u").union(centres.join(nxt.select("u"), "u",
            "left_semi")).limit(1).count()
        cur = nxt
        if not more:
            return cur.select(F.col("u").alias("node"),
                F.col("v").alias("component")).union(centres.select(F.col("u").alias("node"), F.col("u").alias("component")))
