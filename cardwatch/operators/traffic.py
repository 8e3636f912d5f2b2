"""Shop-wide traffic context at one decision moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cardwatch.config import FeatureWindow
from cardwatch.functions.numeric import count_true, ratio
from cardwatch.operators.features import in_window


def session_totals(attempts: DataFrame) -> DataFrame:
    """Per session: attempts, captures, failures, gateway failures and distinct cards.

    Reduced per (session, card) first, so a session with very many rows is spread by card.
    """
    failed = F.col("outcome") == "failed"
    per_card = attempts.groupBy("scope", "session", "card_id").agg(
        F.count(F.lit(1)).alias("attempts"),
        count_true(F.col("outcome") == "captured").alias("captures"),
        count_true(failed).alias("failures"),
        count_true(failed & F.coalesce(F.col("error_source") == "gateway", F.lit(False))).alias("gateway_failures"),
    )
    return per_card.groupBy("scope", "session").agg(
        F.sum("attempts").alias("attempts"),
        F.sum("captures").alias("captures"),
        F.sum("failures").alias("failures"),
        F.sum("gateway_failures").alias("gateway_failures"),
        F.count("card_id").alias("cards"),
    )


def card_testing(sessions: DataFrame) -> DataFrame:
    """Flag sessions that only ever failed, over several cards, without the gateway to blame."""
    gateway_led = ratio(F.col("gateway_failures"), F.col("failures")) > 0.5
    flag = (F.col("attempts") >= 2) & (F.col("captures") == 0) & (F.col("cards") >= 2) & ~gateway_led
    return sessions.withColumn("card_testing", flag)


def traffic_context(
    attempts: DataFrame, *, as_of_ms: int, window: FeatureWindow = FeatureWindow()
) -> DataFrame:
    """One row per scope: volumes, approval, breadth of failure and the card-testing cohort."""
    recent = in_window(attempts, as_of_ms, window.window_ms)
    sessions = card_testing(session_totals(recent))
    named = F.col("session").isNotNull()
    failing = named & (F.col("failures") > 0)
    shop = sessions.groupBy("scope").agg(
        F.sum("attempts").alias("attempts"),
        F.sum("failures").alias("failures"),
        F.sum("captures").alias("captures"),
        F.sum("gateway_failures").alias("gateway_failures"),
        count_true(failing).alias("failing_sessions"),
        count_true(named).alias("active_sessions"),
        F.max(F.when(named, F.col("failures")).otherwise(0)).alias("worst_session_failures"),
        count_true(named & F.col("card_testing")).alias("card_testing_sessions"),
        F.sum(F.when(failing, F.col("attempts")).otherwise(0)).alias("failing_attempts"),
        F.sum(F.when(failing, F.col("captures")).otherwise(0)).alias("failing_captures"),
    )
    cards = (
        recent.filter(F.col("card_id").isNotNull())
        .groupBy("scope", "card_id")
        .agg(F.lit(1).alias("seen"))
        .groupBy("scope")
        .agg(F.count(F.lit(1)).alias("distinct_cards"))
    )
    context = shop.join(cards, "scope", "left")
    return context.select(
        "scope",
        "attempts",
        "failures",
        ratio(F.col("captures"), F.col("attempts")).alias("approval_rate"),
        ratio(F.col("gateway_failures"), F.col("failures")).alias("infra_failure_share"),
        "failing_sessions",
        "active_sessions",
        ratio(F.col("worst_session_failures"), F.col("failures")).alias("top_session_failure_share"),
        "card_testing_sessions",
        ratio(F.col("failing_captures"), F.col("failing_attempts")).alias("failing_session_approval_rate"),
        F.coalesce(F.col("distinct_cards"), F.lit(0).cast("bigint")).alias("distinct_cards"),
    )


def failing_issuers(attempts: DataFrame) -> DataFrame:
    """Distinct card issuers among failed attempts, per scope."""
    return (
        attempts.filter((F.col("outcome") == "failed") & F.col("card_issuer").isNotNull())
        .groupBy("scope", "card_issuer")
        .agg(F.lit(1).alias("seen"))
        .groupBy("scope")
        .agg(F.count(F.lit(1)).alias("distinct_failing_issuers"))
    )


def with_traffic(vectors: DataFrame, traffic: DataFrame) -> DataFrame:
    """Each vector next to its scope's context, columns prefixed with ``shop_``.

    The context has one row per scope. It is passed in as a written table, so the optimiser
    knows its size and broadcasts it only below the session's threshold; past that the join
    runs on the scope key with runtime skew splitting.
    """
    shop = traffic.select("scope", *[F.col(c).alias(f"shop_{c}") for c in traffic.columns if c != "scope"])
    return vectors.join(shop, "scope")
