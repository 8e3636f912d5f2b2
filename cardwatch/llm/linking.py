"""Links among nodes that share a key, without the pairs of a key.

A key shared by many nodes is not expanded. Its nodes are first paired with the smallest of them, then, where it still joins
several components, with one drawn by hash. What joins several components after that is left to the caller, who
compares nodes of different components: a pair inside one component cannot change the components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.llm.components import components
from cardwatch.session import stage


def merge(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of the links so far (stars stand for all that led to them) and new ones."""
    if found is not None:
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    return stage(components(links), "link-components")


def with_first(members: DataFrame, found: DataFrame | None) -> DataFrame:
    return members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()


def still_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """key, node, component, n: members of bands that join several components."""
    placed = stage(members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "link-placed")
    return several(placed)


def several(placed: DataFrame) -> DataFrame:
    per_key = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    return placed.join(stage(per_key.filter("low <> high").select("key", "n"), "link-several"), "key")


def with_drawn(members: DataFrame, found: DataFrame) -> DataFrame:
    inside = stage(still_open(members, found), "link-open")
    draw = F.struct(F.xxhash64("key", "node").alias("h"), F.col("node"), F.col("component"))
    drawn = stage(inside.groupBy("key").agg(F.min(draw).alias("d")).select("key", F.col("d.node").alias("one"), F.col("d.component").alias("its")), "link-drawn")
    pairs = inside.join(drawn, "key").filter("component <> its")
    return pairs.select(F.least("node", "one").alias("a"), F.greatest("node", "one").alias("b")).distinct()
