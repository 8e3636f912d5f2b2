"""The eleven rules and the score, as one projection over the feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.config import Thresholds
from cardwatch.functions.numeric import clamp01, half_up, ratio

# How far each rule can move the score (used for rules that abstain).
RULE_WEIGHT = {
    "velocity": 0.2,
    "card_spread": 0.5,
    "card_spread_slow": 0.3,
    "card_probing": 0.3,
    "approval_collapse": 0.25,
    "reason_mix": 0.2,
    "small_amount_probing": 0.15,
    "machine_cadence": 0.1,
    "recovery": -0.4,
    "infrastructure_attribution": -0.5,
    "card_reuse": -0.25,
}

# An incident needs evidence from at least one of these rules.
DISCRIMINATING = ("card_spread", "card_spread_slow", "velocity", "small_amount_probing", "machine_cadence")

_NO_DATA, _UNCONFIRMED = "insufficient-data", "unconfirmed-estimate"


def _evidence(rule: str, code: str, observed: Column, threshold: float, weight: float) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(code).alias("code"),
        observed.cast("double").alias("observed"),
        F.lit(float(threshold)).alias("threshold"),
        F.lit(float(weight)).alias("weight"),
    )


def evaluate_rules(vectors: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Add ``evidence`` (what fired) and ``abstentions`` (what could not be judged)."""
    c = F.col
    attempts, failures, cards = c("attempts"), c("failures"), c("distinct_cards")
    declined = c("approval_rate") < 0.5
    some, few = attempts > 0, attempts < t.approval_minimum_attempts
    spread = ratio(cards, attempts)
    reuse = ratio(attempts, cards)
    never = F.lit(None).cast("string")

    # Rule names, evidence codes and weights.
    # rule -> (reason it cannot run, condition under which it fires, evidence it then gives)
    table: list[tuple[str, Column, Column, list[Column]]] = []

    def rule(name: str, silent: Column, fires: Column, *evidence: tuple[str, Column, float, float]) -> None:
        table.append((name, silent, fires, [_evidence(name, *e) for e in evidence]))

    rule("velocity", never, c("attempt_rate") > t.velocity_per_minute,
         ("attempt_rate_above_threshold", c("attempt_rate"), t.velocity_per_minute, 0.2))
    rule("card_spread",
         F.when(cards.isNull(), _UNCONFIRMED).when(~some, _NO_DATA),
         declined & (cards >= t.card_spread_minimum) & (spread >= t.cards_per_attempt),
         ("distinct_cards_above_threshold", cards, t.card_spread_minimum, 0.35),
         ("cards_per_attempt_above_threshold", spread, t.cards_per_attempt, 0.15))
    long_cards = c("distinct_cards_long_span")
    rule("card_spread_slow",
         F.when(long_cards.isNull() | cards.isNull(), _UNCONFIRMED).when(~some, _NO_DATA),
         declined & (cards < t.card_spread_minimum) & (long_cards >= t.card_spread_slow_minimum),
         ("distinct_cards_long_span_above_threshold", long_cards, t.card_spread_slow_minimum, 0.3))
    rule("card_probing", F.when(~some, _NO_DATA),
         declined & (c("max_orders_per_card") >= t.orders_per_card_probe),
         ("orders_per_card_above_threshold", c("max_orders_per_card"), t.orders_per_card_probe, 0.3))
    rule("approval_collapse", F.when(few, _NO_DATA), c("approval_rate") < t.approval_floor,
         ("approval_rate_below_floor", c("approval_rate"), t.approval_floor, 0.25))
    rule("reason_mix", F.when(failures == 0, _NO_DATA),
         (c("infra_failure_share") < t.infrastructure_share) & (c("reason_concentration") > t.reason_concentration),
         ("decline_reasons_concentrated", c("reason_concentration"), t.reason_concentration, 0.2))
    rule("small_amount_probing", F.when(~some, _NO_DATA), c("small_amount_share") > t.small_amount_share,
         ("small_amount_share_above_threshold", c("small_amount_share"), t.small_amount_share, 0.15))
    rule("machine_cadence", F.when(attempts < t.cadence_minimum_attempts, _NO_DATA),
         c("burstiness") < t.machine_cadence,
         ("inter_arrival_variation_low", c("burstiness"), t.machine_cadence, 0.1))
    rule("recovery", never, c("recovered_orders") > 0,
         ("orders_recovered_after_failure", c("recovered_orders"), 0, -0.4))
    rule("infrastructure_attribution", F.when(failures == 0, _NO_DATA),
         c("infra_failure_share") >= t.infrastructure_share,
         ("failures_attributed_to_gateway", c("infra_failure_share"), t.infrastructure_share, -0.5))
    rule("card_reuse",
         F.when(cards.isNull(), _UNCONFIRMED).when(few | (cards == 0), _NO_DATA),
         reuse >= t.attempts_per_card,
         ("cards_reused_across_attempts", reuse, t.attempts_per_card, -0.25))

    evidence = F.array(
        *[F.when(silent.isNull() & fires, e) for _, silent, fires, items in table for e in items]
    )
    abstentions = F.array(
        *[
            F.when(silent.isNotNull(), F.struct(F.lit(name).alias("rule"), silent.alias("reason")))
            for name, silent, _, _ in table
        ]
    )
    return vectors.withColumn("evidence", F.array_compact(evidence)).withColumn(
        "abstentions", F.array_compact(abstentions)
    )


def score(evaluated: DataFrame) -> DataFrame:
    """Score in [0, 1], the range it could take if silent rules spoke, and how sure it is."""
    total = lambda array, keep: F.aggregate(
        F.filter(array, keep), F.lit(0.0), lambda acc, item: acc + item
    )
    weights = F.transform("evidence", lambda e: e["weight"])
    weight_of = F.create_map(*[F.lit(x) for pair in RULE_WEIGHT.items() for x in pair])
    silent = F.transform("abstentions", lambda a: F.element_at(weight_of, a["rule"]))
    up, down = (lambda w: w >= 0), (lambda w: w < 0)
    sums = (
        evaluated.withColumn("_for", total(weights, up))
        .withColumn("_against", total(weights, down))
        .withColumn("_lower", clamp01(F.col("_for") + F.col("_against") + total(silent, down)))
        .withColumn("_upper", clamp01(F.col("_for") + F.col("_against") + total(silent, up)))
    )
    width = F.col("_upper") - F.col("_lower")
    return (
        sums.withColumn("score", half_up(clamp01(F.col("_for") + F.col("_against"))))
        .withColumn("score_lower", half_up(F.col("_lower")))
        .withColumn("score_upper", half_up(F.col("_upper")))
        .withColumn("band", F.when(width == 0, "high").when(width <= 0.25, "medium").otherwise("low"))
        .withColumn("incriminating", half_up(F.col("_for")))
        .withColumn("mitigating", half_up(F.col("_against")))
        .drop("_for", "_against", "_lower", "_upper")
    )


def fired_rules() -> Column:
    """Rules with incriminating evidence, in rule order, without repeats."""
    return F.array_distinct(
        F.transform(F.filter("evidence", lambda e: e["weight"] > 0), lambda e: e["rule"])
    )


def severity(score_column: Column, t: Thresholds = Thresholds()) -> Column:
    return (
        F.when(score_column >= t.severity_high, "high")
        .when(score_column >= t.severity_medium, "medium")
        .otherwise("low")
    )


def warrants_incident(t: Thresholds = Thresholds()) -> Column:
    """Enough score, enough certainty, and at least one discriminating rule."""
    telling = F.arrays_overlap(fired_rules(), F.array(*[F.lit(r) for r in DISCRIMINATING]))
    return (F.col("score") >= t.incident_floor) & (F.col("band") != "low") & telling
