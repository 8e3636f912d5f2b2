"""Collapse of provider events to payment attempts, and resolution of attempts and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# How far along each outcome is.
OUTCOME_RANK = {"other": 0, "failed": 1, "authorized": 2, "captured": 3}

# Payment statuses in the order a payment moves through them.
STATUS_ORDER = ("created", "failed", "authorized", "captured", "refunded")

# What each webhook type says about the payment it names.
EVENT_STATUS = {
    "payment.authorized": "authorized",
    "payment.captured": "captured",
    "payment.failed": "failed",
    "order.paid": "captured",
    "refund.created": "refunded",
    "refund.processed": "refunded",
    "refund.speed_changed": "refunded",
}

_CARRIED = ("order_id", "amount_paise", "card_id", "session", "device", "network", "source")


def _lookup(key: Column, pairs: dict, default=None) -> Column:
    """Small fixed mapping as a conditional expression."""
    expr = None
    for name, value in pairs.items():
        expr = F.when(key == name, F.lit(value)) if expr is None else expr.when(key == name, F.lit(value))
    return expr.otherwise(F.lit(default))


def per_payment(observations: DataFrame, *, as_of_ms: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """One row per payment: earliest time, furthest outcome, first known decline reason.

    Rows after ``as_of_ms`` are dropped first, so a replay sees what the original pass saw.
    Everything else comes from the earliest event by (time, event id), whatever order rows
    arrive in. Rows without a payment id stay as they are. The aggregate buffers are of
    constant size, so one payment with very many events is combined before the shuffle.

    ``within`` names columns that are equal in all events of a payment, like the order whose number its id is made of: rows that
    lie together by these, as a join on them leaves them, are collapsed where they lie.
    """
    rows = observations if as_of_ms is None else observations.filter(F.col("at_ms") <= as_of_ms)
    rows = rows.withColumn("outcome_rank", _lookup(F.col("outcome"), OUTCOME_RANK, 0))
    keyed = F.coalesce(F.col("payment_id"), F.lit("")) != ""
    carried = [c for c in _CARRIED if c in rows.columns]
    moment = F.struct("at_ms", "event_id")

    collapsed = (
        rows.filter(keyed)
        .groupBy(*within, "scope", "payment_id")
        .agg(
            F.min("at_ms").alias("at_ms"),
            F.max("outcome_rank").alias("outcome_rank"),
            F.min_by(F.struct(*carried), moment).alias("head"),
            F.min_by("error_reason", F.when(F.col("error_reason").isNotNull(), moment)).alias("error_reason"),
            F.min_by("error_source", F.when(F.col("error_source").isNotNull(), moment)).alias("error_source"),
            F.count(F.lit(1)).alias("n_events"),
        )
    )
    columns = ["scope", "payment_id", "at_ms", "outcome_rank", *carried, "error_reason", "error_source", "n_events"]
    collapsed = collapsed.drop(*within).select(
        *[F.col(f"head.{c}").alias(c) if c in carried else F.col(c) for c in columns]
    )
    loose = rows.filter(~keyed).withColumn("n_events", F.lit(1).cast("bigint")).select(*columns)
    names = F.array(*[F.lit(n) for n in OUTCOME_RANK])
    return collapsed.unionByName(loose).withColumn("outcome", F.element_at(names, F.col("outcome_rank") + 1))


def payment_partials(observations: DataFrame) -> DataFrame:
    """What a set of events says about their payments, in a form that merges: one row per payment, and one per loose event."""
    carried = [c for c in _CARRIED if c in observations.columns]
    moment = [F.col("at_ms"), F.col("event_id")]
    known = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*moment, F.col(c).alias("value")))).alias(c)
    loose = F.when(F.coalesce(F.col("payment_id"), F.lit("")) == "", F.col("event_id")).alias("loose_id")
    return observations.groupBy("scope", "payment_id", loose).agg(
        F.min(F.struct(*moment, *carried)).alias("head"),
        F.max(_lookup(F.col("outcome"), OUTCOME_RANK, 0)).alias("outcome_rank"),
        known("error_reason"),
        known("error_source"),
        F.count(F.lit(1)).alias("n_events"),
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partial rows of the same payments as one each, still in a form that merges."""
    return partials.groupBy("scope", "payment_id", "loose_id").agg(
        F.min("head").alias("head"), F.max("outcome_rank").alias("outcome_rank"),
        *[F.min(c).alias(c) for c in ("error_reason", "error_source")], F.sum("n_events").alias("n_events"),
    )


def merge_before_and_after(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Payments that ``fresh`` touches: ``before`` merged from the known partial rows alone (null without any), ``after`` from both, in one aggregation."""
    rows = known.withColumn("_known", F.lit(True)).unionByName(fresh.withColumn("_known", F.lit(False)))
    merged = lambda of: F.struct(
        F.min(of("head")).alias("head"), F.max(of("outcome_rank")).alias("outcome_rank"),
        *[F.min(of(c)).alias(c) for c in ("error_reason", "error_source")], F.sum(of("n_events")).alias("n_events"),
    )
    found = rows.groupBy("scope", "payment_id", "loose_id").agg(merged(lambda c: F.when(F.col("_known"), F.col(c))).alias("before"), merged(F.col).alias("after"))
    return found.withColumn("before", F.when(F.col("before.n_events").isNotNull(), F.col("before")))


def finish_payments(merged: DataFrame, *keep: str) -> DataFrame:
    """Payments from partial rows that are merged already."""
    carried = [c for c in merged.schema["head"].dataType.names if c != "event_id"]
    names = F.array(*[F.lit(n) for n in OUTCOME_RANK])
    return merged.select(
        "scope", "payment_id", *keep, "outcome_rank", *[F.col(f"head.{c}").alias(c) for c in carried],
        F.col("error_reason.value").alias("error_reason"), F.col("error_source.value").alias("error_source"), "n_events",
    ).withColumn("outcome", F.element_at(names, F.col("outcome_rank") + 1))


def merge_payments(partials: DataFrame) -> DataFrame:
    """Payments from partial rows, as ``per_payment`` over all their events at once."""
    return finish_payments(merge_partials(partials))


def resolve_attempts(events: DataFrame) -> DataFrame:
    """State of each payment, whatever the order or number of deliveries.

    Each field comes from the event furthest along in the payment's life that carries it
    (ties: newest, then event type). A failure is kept even when the payment recovers.
    """
    status = _lookup(F.col("event_type"), EVENT_STATUS)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status) - 1, F.lit(-1))
    rows = events.filter(F.col("payment_id").isNotNull()).withColumn("rank", rank.cast("int"))
    order = F.struct("rank", "at_ms", "event_type", "event_id")
    is_failure = F.col("rank") == STATUS_ORDER.index("failed")

    def furthest(column: str, only: Column | None = None) -> Column:
        usable = F.col(column).isNotNull() if only is None else only & F.col(column).isNotNull()
        return F.max_by(column, F.when(usable, order)).alias(column)

    resolved = rows.groupBy("scope", "payment_id").agg(
        F.greatest(F.max("rank"), F.lit(0)).alias("status_rank"),
        furthest("order_id"),
        furthest("amount_paise"),
        furthest("method"),
        furthest("card_network"),
        furthest("card_issuer"),
        furthest("card_id"),
        furthest("error_code", is_failure),
        furthest("error_reason", is_failure),
        furthest("error_source", is_failure),
        F.max(F.when(is_failure, 1).otherwise(0)).alias("failed"),
        F.min("at_ms").alias("first_ms"),
        F.max("at_ms").alias("last_ms"),
        F.count(F.lit(1)).alias("event_count"),
        F.max(F.col("late").cast("int")).alias("late"),
        F.max(F.when(F.col("source") == "replay", 1).otherwise(0)).alias("replayed"),
    )
    names = F.array(*[F.lit(s) for s in STATUS_ORDER])
    return (
        resolved.withColumn("status", F.element_at(names, F.col("status_rank") + 1))
        .withColumn("failed", F.col("failed") == 1)
        .withColumn("late", F.col("late") == 1)
        .withColumn("source", F.when(F.col("replayed") == 1, "replay").otherwise("live"))
        .drop("status_rank", "replayed")
    )


def resolve_orders(attempts: DataFrame) -> DataFrame:
    """Outcome of each order over its resolved attempts, in one fixed-size aggregate."""
    settled = F.col("status").isin("captured", "refunded")
    first_known = F.min_by(
        "amount_paise", F.when(F.col("amount_paise").isNotNull(), F.struct("first_ms", "payment_id"))
    )
    grouped = attempts.filter(F.col("order_id").isNotNull()).groupBy("scope", "order_id").agg(
        F.max(settled.cast("int")).alias("settled"),
        F.min((F.col("status") == "failed").cast("int")).alias("all_failed"),
        F.sum(F.col("failed").cast("bigint")).alias("failure_count"),
        F.count(F.lit(1)).alias("attempt_count"),
        first_known.alias("amount_paise"),
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.max(F.when(F.col("source") == "replay", 1).otherwise(0)).alias("replayed"),
    )
    return grouped.select(
        "scope",
        "order_id",
        F.when(F.col("settled") == 1, "paid").when(F.col("all_failed") == 1, "failed").otherwise("pending").alias("outcome"),
        ((F.col("settled") == 1) & (F.col("failure_count") > 0)).alias("recovered"),
        "failure_count",
        "attempt_count",
        "amount_paise",
        "first_ms",
        "last_ms",
        F.when(F.col("replayed") == 1, "replay").otherwise("live").alias("source"),
    )


def flag_late(events: DataFrame, *, lateness_ms: int = 5 * 60_000) -> DataFrame:
    """Mark events older than (newest event seen in earlier arrivals - bound); keep every row.

    The running maximum is taken over arrival milliseconds inside one minute (at most 60 000
    rows) and over minutes per scope, never over the event rows themselves.
    """
    ticks = events.groupBy("scope", "received_ms").agg(F.max("at_ms").alias("tick_max"))
    ticks = ticks.withColumn("minute", F.expr("received_ms div 60000"))
    minutes = ticks.groupBy("scope", "minute").agg(F.max("tick_max").alias("minute_max"))
    before_minute = W.partitionBy("scope").orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    before_tick = W.partitionBy("scope", "minute").orderBy("received_ms").rowsBetween(W.unboundedPreceding, -1)
    seen = (
        ticks.join(
            minutes.select("scope", "minute", F.max("minute_max").over(before_minute).alias("earlier_max")),
            ["scope", "minute"],
        )
        .select(
            "scope",
            "received_ms",
            F.greatest(F.col("earlier_max"), F.max("tick_max").over(before_tick)).alias("seen_ms"),
        )
    )
    late = F.coalesce(F.col("at_ms") < F.col("seen_ms") - lateness_ms, F.lit(False))
    return events.join(seen, ["scope", "received_ms"]).withColumn("late", late).drop("seen_ms")
