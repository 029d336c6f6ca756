"""Connected components by alternating stars, all steps as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sources.tables import saved


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node), for each node of an edge; nulls and loops link nothing.

    Each round hangs the neighbours of a node on the least of them, those above it and those below it in turn (large and small
    stars), which ends after a number of rounds that grows with the square of the logarithm of the longest path at most. A hot node is one
    row of an aggregate and one key of a join whose other side Spark can split.
    """
    rows = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = saved(rows.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    rows = saved(rows.filter("u <> v").distinct())
    before = None
    while True:
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = saved(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rows = saved(below.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(rows.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
