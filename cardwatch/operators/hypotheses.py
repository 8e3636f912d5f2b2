"""Competing explanations of an entity's traffic and the decision they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.config import Thresholds
from cardwatch.functions.numeric import half_up, ratio

HYPOTHESES = ("attack", "outage", "retry_storm", "healthy_traffic", "insufficient_evidence")

# Explanations that identify an innocent cause.
BENIGN = ("outage", "retry_storm", "healthy_traffic")

# What a wrong call costs, per explanation (if we act, if we wait).
COUNTERFACTUAL = {
    "attack": ("blocked_a_real_shopper", "card_testing_continues_and_chargebacks_follow"),
    "outage": ("punished_customers_for_an_acquirer_outage", "nothing_extra_the_outage_is_not_ours_to_fix"),
    "retry_storm": ("stopped_a_merchant_collecting_money_it_is_owed", "nothing_extra_the_schedule_completes"),
    "healthy_traffic": ("turned_away_paying_customers_at_the_busiest_moment", "nothing_extra_this_is_the_business_working"),
    "insufficient_evidence": ("acted_on_something_nobody_understood", "an_analyst_spends_a_few_minutes_looking"),
}


def _expectations(t: Thresholds) -> dict[str, list[tuple[str, Column, int]]]:
    """What each explanation expects to see, with its weight."""
    c = F.col
    known = F.coalesce(c("distinct_cards"), F.lit(0))
    shaped = c("attempts") >= t.approval_minimum_attempts
    few_cards = known < t.card_spread_minimum
    gateway = c("shop_infra_failure_share") >= t.infrastructure_share
    failing = ratio(c("shop_failures"), c("shop_attempts"))
    concentrated = c("shop_top_session_failure_share") >= 0.5
    busy_and_fine = c("shop_approval_rate") >= 0.8
    # Reason codes and weights.
    return {
        "attack": [
            ("enough_attempts_to_have_a_shape", shaped, 3),
            ("many_distinct_cards", ~few_cards, 2),
            ("card_per_attempt_high", shaped & (ratio(known, c("attempts")) >= t.cards_per_attempt), 2),
            ("approval_collapsed", shaped & (c("approval_rate") < t.approval_floor), 1),
            ("failure_not_the_gateways", ~gateway, 2),
            ("not_ordinary_busy_traffic", shaped & (concentrated | (c("shop_approval_rate") < 0.5)), 2),
            ("small_amounts", c("small_amount_share") > t.small_amount_share, 1),
            ("shop_failing_with_nobody_to_blame", (failing >= 0.5) & ~gateway & (c("shop_approval_rate") < 0.3), 3),
        ],
        "outage": [
            ("gateway_blamed", gateway, 3),
            ("failure_is_widespread", gateway & (c("shop_failing_sessions") >= 5) & ~concentrated, 2),
            ("this_entity_blamed_the_gateway_too", gateway & (c("infra_failure_share") >= t.infrastructure_share), 2),
            ("no_card_walking", gateway & few_cards, 1),
        ],
        "retry_storm": [
            ("enough_attempts_to_have_a_shape", shaped, 3),
            ("cards_reused", shaped & (ratio(c("attempts"), known) >= t.attempts_per_card), 3),
            ("few_distinct_cards", shaped & (known > 0) & few_cards, 2),
            ("not_the_gateways_fault", ~gateway, 1),
            ("runs_on_a_timer", c("burstiness") < t.machine_cadence, 1),
            ("some_of_it_works", c("approval_rate") > 0.05, 1),
        ],
        "healthy_traffic": [
            ("most_payments_succeed", busy_and_fine, 3),
            ("many_shoppers", busy_and_fine & (c("shop_active_sessions") >= 20), 2),
            ("failure_is_thin_on_the_ground", failing < 0.2, 2),
            ("nobody_is_walking_a_card_list", few_cards, 1),
        ],
        "insufficient_evidence": [
            ("barely_any_activity", ~shaped, 3),
            ("counts_never_confirmed", c("distinct_cards").isNull(), 3),
            ("little_to_compare_against", c("shop_attempts") < 10, 2),
        ],
    }


def arbitrate(judged: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Add ``fits`` (best first), ``best``, ``runner_up`` and ``margin`` to vectors with traffic.

    Support is the met share of an explanation's expected weight; probabilities share out the
    supports. Decisions read the rounded numbers, and declaration order breaks ties.
    """
    supports, met_codes = {}, {}
    for name, expected in _expectations(t).items():
        total = sum(weight for _, _, weight in expected)
        met = sum((F.when(cond, F.lit(weight)).otherwise(0) for _, cond, weight in expected), F.lit(0))
        supports[name] = met / F.lit(float(total))
        met_codes[name] = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond, _ in expected]))
    rows = judged.select(
        "*",
        F.struct(*[supports[n].alias(n) for n in HYPOTHESES]).alias("_support"),
        F.struct(*[met_codes[n].alias(n) for n in HYPOTHESES]).alias("_met"),
    )
    everything = sum((F.col(f"_support.{n}") for n in HYPOTHESES), F.lit(0.0))
    fits = F.array(
        *[
            F.struct(
                half_up(
                    F.when(everything == 0, F.lit(1.0 / len(HYPOTHESES))).otherwise(
                        F.try_divide(F.col(f"_support.{n}"), everything)
                    )
                ).alias("probability"),
                F.lit(-i).alias("ord"),
                F.lit(n).alias("hypothesis"),
                half_up(F.col(f"_support.{n}")).alias("support"),
                F.col(f"_met.{n}").alias("met"),
            )
            for i, n in enumerate(HYPOTHESES)
        ]
    )
    rows = rows.withColumn("fits", F.sort_array(fits, asc=False)).drop("_support", "_met")
    return (
        rows.withColumn("best", F.col("fits")[0]["hypothesis"])
        .withColumn("runner_up", F.col("fits")[1]["hypothesis"])
        .withColumn("best_support", F.col("fits")[0]["support"])
        .withColumn("margin", half_up(F.col("fits")[0]["probability"] - F.col("fits")[1]["probability"]))
    )


def fit_of(hypothesis: str, field: str) -> Column:
    """One number of one explanation out of ``fits``."""
    return F.filter("fits", lambda f: f["hypothesis"] == hypothesis)[0][field]


def decide(arbitrated: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Add ``decision``, ``abstained`` and ``reasons``."""
    best, runner_up = F.col("best"), F.col("runner_up")
    unclear = best == "insufficient_evidence"
    narrow = F.col("margin") < t.arbitration_margin
    benign = best.isin(*BENIGN)
    weak = F.col("best_support") < t.containment_support
    unconfirmed = F.col("distinct_cards").isNull()
    decision = (
        F.when(unclear, "monitor")
        .when(narrow, "review")
        .when(benign, F.when(best == "outage", "monitor").otherwise("none"))
        .when(weak | unconfirmed, "review")
        .otherwise("contain")
    )
    # The reason codes.
    reasons = (
        F.when(unclear, F.array(F.lit("not_enough_to_judge")))
        .when(narrow, F.array(F.lit("margin_too_narrow"), F.concat(F.lit("runner_up_"), runner_up)))
        .when(benign, F.array(F.concat(F.lit("suppressed_by_"), best)))
        .when(weak, F.array(F.lit("attack_best_but_weakly_supported")))
        .when(unconfirmed, F.array(F.lit("counts_not_confirmed")))
        .otherwise(F.array(F.lit("attack_clearly_best_supported")))
    )
    return (
        arbitrated.withColumn("decision", decision)
        .withColumn("abstained", unclear | narrow)
        .withColumn("reasons", reasons)
    )


def counterfactual(decided: DataFrame) -> DataFrame:
    """Cost codes of a wrong call, for the best explanation and the runner-up."""
    def code(hypothesis: str, side: int) -> Column:
        expr = None
        for name, costs in COUNTERFACTUAL.items():
            hit = F.col(hypothesis) == name
            expr = F.when(hit, costs[side]) if expr is None else expr.when(hit, costs[side])
        return expr

    return (
        decided.withColumn("if_wrong_to_act", code("best", 0))
        .withColumn("if_wrong_to_wait", code("best", 1))
        .withColumn("runner_up_if_wrong_to_act", code("runner_up", 0))
        .withColumn("runner_up_if_wrong_to_wait", code("runner_up", 1))
    )


def combine_model(decided: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Let a model's ``risk`` move the decision: up to review, down from containment, or agree."""
    risk, acting = F.col("risk"), F.col("decision").isin("contain", "review")
    high = F.coalesce(risk >= t.model_high_risk, F.lit(False))
    low = F.coalesce(risk <= t.model_low_risk, F.lit(False))
    escalate = high & ~acting & ~F.col("best").isin(*BENIGN)
    soften = low & (F.col("decision") == "contain")
    agree = high & acting
    note = F.when(escalate, "model_flagged_high_risk").when(soften, "model_scores_low_risk").when(agree, "model_agrees_attack")
    influence = F.when(escalate, "escalated").when(soften, "deescalated").when(agree, "corroborated").otherwise("none")
    return (
        decided.withColumn("model_influence", influence)
        .withColumn("reasons", F.when(note.isNull(), F.col("reasons")).otherwise(F.array_append("reasons", note)))
        .withColumn("decision", F.when(escalate | soften, "review").otherwise(F.col("decision")))
    )


def model_flag(t: Thresholds = Thresholds()) -> Column:
    """Whether the model alone would raise a case."""
    return F.coalesce(F.col("risk") >= t.model_flag_risk, F.lit(False))
