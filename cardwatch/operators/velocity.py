"""Trailing-window signals per attempt: device velocity, card reuse, network sharing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cardwatch.functions.timeline import trailing_distinct, trailing_sum
from cardwatch.operators.features import ENTITY

# Trailing windows of the per-attempt signals.
SIGNAL_WINDOW_MS = 60_000
NETWORK_WINDOW_MS = 600_000


def interarrival(entities: DataFrame) -> DataFrame:
    """Gap to the entity's previous attempt.

    Each attempt is compared inside its minute, and the first of a minute looks up the last
    attempt of the entity's previous busy minute, so the sort never spans a whole entity.
    """
    rows = entities.withColumn("minute", F.expr("at_ms div 60000"))
    minutes = rows.groupBy(*ENTITY, "minute").agg(F.max("at_ms").alias("minute_last"))
    before = W.partitionBy(*ENTITY).orderBy("minute")
    edges = minutes.select(*ENTITY, "minute", F.lag("minute_last").over(before).alias("previous_last"))
    inside = W.partitionBy(*ENTITY, "minute").orderBy("at_ms", "payment_id")
    return (
        rows.withColumn("previous_ms", F.lag("at_ms").over(inside))
        .join(edges, [*ENTITY, "minute"])
        .withColumn("gap_ms", F.col("at_ms") - F.coalesce(F.col("previous_ms"), F.col("previous_last")))
        .drop("minute", "previous_ms", "previous_last")
    )


def device_velocity(attempts: DataFrame, *, span_ms: int = SIGNAL_WINDOW_MS) -> DataFrame:
    """Attempts and failures from the same device in the trailing window, per attempt."""
    keys = ["source", "device"]
    marked = attempts.filter(F.col("device").isNotNull()).select(
        *keys, "at_ms", F.lit(1).cast("bigint").alias("attempts_in_window"),
        (F.col("outcome") == "failed").cast("bigint").alias("failures_in_window"),
    )
    totals = trailing_sum(marked, keys, "at_ms", span_ms, ["attempts_in_window", "failures_in_window"])
    return attempts.join(totals, [*keys, "at_ms"], "left")


def device_seen_before(attempts: DataFrame, *, span_ms: int = SIGNAL_WINDOW_MS) -> DataFrame:
    """Whether the device was ever seen before the trailing window began."""
    first = attempts.groupBy("source", "device").agg(F.min("at_ms").alias("device_first_ms"))
    joined = attempts.join(first, ["source", "device"], "left")
    return joined.withColumn("device_seen_before", F.col("device_first_ms") < F.col("at_ms") - span_ms).drop("device_first_ms")


def network_sharing(attempts: DataFrame, *, span_ms: int = NETWORK_WINDOW_MS) -> DataFrame:
    """Distinct devices on the attempt's network in the trailing window."""
    keys = ["source", "network"]
    devices = trailing_distinct(
        attempts.select(*keys, "device", "at_ms"), keys, "device", "at_ms", span_ms, "network_devices"
    )
    return attempts.join(devices, [*keys, "at_ms"], "left")


def card_reuse(events: DataFrame, attempts: DataFrame, *, span_ms: int = SIGNAL_WINDOW_MS) -> DataFrame:
    """Distinct payments that used the attempt's card in the trailing window (NULL without a card)."""
    keys = ["source", "card_id"]
    usable = lambda df: df.filter(F.coalesce(F.col("card_id"), F.lit("")) != "")
    rows = usable(events).select(*keys, "payment_id", "at_ms")
    asked = usable(attempts).select(*keys, "at_ms").withColumn("payment_id", F.lit(None).cast("string"))
    reuse = trailing_distinct(rows.unionByName(asked), keys, "payment_id", "at_ms", span_ms, "card_payments")
    return attempts.join(reuse, [*keys, "at_ms"], "left")


def recent_from_device(attempts: DataFrame, *, limit: int = 6) -> DataFrame:
    """The newest ``limit`` attempts of each device (the rank limit is applied before the shuffle)."""
    order = W.partitionBy("source", "device").orderBy(F.desc("first_ms"), "payment_id")
    return attempts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
