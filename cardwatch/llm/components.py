"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each step attaches the neighbours of a node to the smallest of them; a logarithmic number of rounds ends in stars.
Per node only a minimum is kept, so a node with very many links is never gathered; results of each
step are written, so a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.session import stage


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component) for every node with a link; component is its smallest reachable node."""
    edges = stage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
        if seen == now or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        large = stage(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-links")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
