"""The attempts table of the console: resolved payments with order state and incident link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.functions.views import display_status, incident_ref
from cardwatch.operators.attempts import flag_late, resolve_attempts, resolve_orders
from cardwatch.operators.features import exact_median
from cardwatch.operators.links import SENSOR, link_incidents


def resolved(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts and orders from canonical events (lateness judged over all arrivals)."""
    attempts = resolve_attempts(flag_late(events))
    return attempts, resolve_orders(attempts)


def attempt_rows(attempts: DataFrame, orders: DataFrame, placed: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row per attempt; the incident is the one its order overlaps."""
    keyed = orders.join(placed.select("order_id", *SENSOR), "order_id", "left")
    linked = link_incidents(keyed, incidents, id_column="order_id").select(
        "order_id", "recovered", "incident_id", "incident_severity", F.col("source").alias("order_source")
    )
    return attempts.join(linked, "order_id").select(
        "payment_id",
        "order_id",
        "amount_paise",
        "method",
        "card_network",
        display_status(F.col("status"), F.col("recovered")).alias("status"),
        F.col("order_source").alias("source"),
        "incident_id",
        incident_ref(F.col("incident_id")).alias("incident_ref"),
        "incident_severity",
        F.col("first_ms").alias("at_ms"),
    )


def attempt_filter(
    *,
    status: str | None = None,
    method: str | None = None,
    severity: str | None = None,
    text: str = "",
    from_ms: int | None = None,
    to_ms: int | None = None,
) -> Column:
    """Filter of the attempts table; severity ``none`` means outside any incident."""
    keep = F.lit(True)
    if status is not None:
        keep &= F.col("status") == status
    if method is not None:
        keep &= F.coalesce(F.col("method") == method, F.lit(False))
    if severity == "none":
        keep &= F.col("incident_severity").isNull()
    elif severity is not None:
        keep &= F.coalesce(F.col("incident_severity") == severity, F.lit(False))
    if text:
        searched = F.lower(F.concat_ws("\n", "payment_id", "order_id", "incident_ref"))
        keep &= F.contains(searched, F.lit(text.lower()))
    if from_ms is not None:
        keep &= F.col("at_ms") >= from_ms
    if to_ms is not None:
        keep &= F.col("at_ms") <= to_ms
    return keep


def attempt_kpis(rows: DataFrame) -> DataFrame:
    """Totals over the unfiltered table."""
    is_ = lambda s: F.sum((F.col("status") == s).cast("bigint")).alias(s)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), is_("captured"), is_("failed"), is_("recovered"),
        F.count("incident_id").alias("in_incident"),
    )


def attempt_page(rows: DataFrame, *, page: int, page_size: int) -> DataFrame:
    """One page, newest first (a bounded top-k, then an offset inside it)."""
    newest = rows.orderBy(F.desc("at_ms"), "payment_id").limit(page * page_size)
    return newest.orderBy(F.desc("at_ms"), "payment_id").offset((page - 1) * page_size)


def recent_orders(events: DataFrame, *, limit: int, source: str | None = None) -> DataFrame:
    """The newest orders by their latest event."""
    rows = events if source is None else events.filter(F.col("source") == source)
    named = rows.filter(F.coalesce(F.col("order_id"), F.lit("")) != "")
    latest = named.groupBy("order_id").agg(F.max("at_ms").alias("latest_ms"))
    return latest.orderBy(F.desc("latest_ms"), "order_id").limit(limit)


def typical_amount(captures: DataFrame, *, sample: int | None = None, minimum: int = 10) -> DataFrame:
    """Median of the captures of each source (of the ``sample`` newest ones, if given); NULL while there are too few."""
    from pyspark.sql import Window as W

    recent = captures.filter(F.col("amount_paise").isNotNull())
    if sample is not None:
        newest = W.partitionBy("source").orderBy(F.desc("at_ms"), "event_id")
        recent = recent.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= sample)
    medians = exact_median(recent.select("source", "amount_paise"), ["source"], "amount_paise", "median")
    counts = recent.groupBy("source").agg(F.count(F.lit(1)).alias("captures"))
    typical = F.when(F.col("captures") >= minimum, F.floor(F.col("median") + 0.5).cast("bigint"))
    return counts.join(medians, "source").select("source", "captures", typical.alias("typical_paise"))
