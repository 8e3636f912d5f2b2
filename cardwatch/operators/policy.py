"""Policy: expected cost, action, refusals, approvals; backtests and explanations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.config import Policy
from cardwatch.functions.numeric import half_up


def expected_cost(policy: Policy = Policy()) -> tuple[Column, Column]:
    """Paise lost if we act on a shopper, and if we wait on an attack (never averaged)."""
    p = F.coalesce(F.col("attack_probability"), F.lit(0.0))
    remaining = F.least(F.greatest(F.col("attempts"), F.lit(1)), F.lit(10))
    act = F.floor((1 - p) * policy.blocked_shopper_paise + 0.5).cast("bigint")
    wait = F.floor(p * policy.chargeback_paise * remaining + 0.5).cast("bigint")
    return act, wait


def _allowlisted(policy: Policy) -> Column:
    lists = {"session": policy.allow_sessions, "device": policy.allow_devices, "network": policy.allow_networks}
    hit = F.lit(False)
    for kind, keys in lists.items():
        if keys:
            hit = hit | ((F.col("entity_kind") == kind) & F.col("entity_key").isin(*keys))
    return hit


def _refusals(policy: Policy) -> Column:
    c = F.col
    age_minutes = F.greatest(c("now_ms") - c("features_ms"), F.lit(0)) / 60_000
    share = F.try_divide((c("active_containments") + 1).cast("double"), c("shop_active_sessions"))
    # The refusal codes.
    checks = [
        ("feature_state_is_stale", age_minutes > policy.max_feature_age_minutes),
        ("counts_never_confirmed", F.lit(policy.require_confirmed_counts) & c("distinct_cards").isNull()),
        ("arbitration_abstained", F.lit(policy.refuse_when_abstained) & c("abstained")),
        ("too_many_active_containments", c("active_containments") >= policy.max_active_containments),
        ("hourly_containment_cap_reached", c("containments_last_hour") >= policy.max_containments_per_hour),
        (
            "would_contain_too_much_of_the_shop",
            (c("shop_active_sessions") >= policy.share_applies_above_sessions) & (share > policy.max_share_of_active_sessions),
        ),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


def policy_decide(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Add ``action``, ``policy_reasons``, ``refusals``, ``approvals_required``, ``expires_after_minutes``.

    Needs best, decision, abstained, attack_support, attack_probability, attempts,
    distinct_cards, shop_active_sessions, now_ms, features_ms, active_containments and
    containments_last_hour next to the entity.
    """
    act, wait = expected_cost(policy)
    support = F.coalesce(F.col("attack_support"), F.lit(0.0))
    wanted = F.when(support >= policy.contain, "contain").when(support >= policy.step_up, "step_up").otherwise("escalate")
    none = F.array().cast("array<string>")
    rows = (
        rows.withColumn("cost_if_act_paise", act)
        .withColumn("cost_if_wait_paise", wait)
        .withColumn("_blocked", _refusals(policy))
        .withColumn("_wanted", wanted)
    )
    c = F.col
    stopped, listed, other = F.lit(policy.kill_switch), _allowlisted(policy), c("best") != "attack"
    held_back = (F.size("_blocked") > 0) & c("_wanted").isin("contain", "step_up")
    inert = stopped | listed
    dual = c("cost_if_act_paise") > policy.dual_approval_above_paise
    takes_effect = ~inert & ~other & ~held_back
    contains = takes_effect & (c("_wanted") == "contain")
    supported = F.format_string("attack_supported_at_%.2f", half_up(support, 2))
    return (
        rows.withColumn(
            "action",
            F.when(inert, "observe")
            .when(other, F.when(c("decision") == "review", "escalate").otherwise("observe"))
            .when(held_back, "escalate")
            .otherwise(c("_wanted")),
        )
        # The reason codes.
        .withColumn(
            "policy_reasons",
            F.when(stopped, F.array(F.lit("kill_switch_engaged")))
            .when(listed, F.array(F.lit("entity_is_allowlisted")))
            .when(other, F.array(F.concat(F.lit("better_explanation_"), c("best"))))
            .when(held_back, F.array(F.lit("degraded_or_capped_so_escalated_instead")))
            .when(contains & dual & F.lit(policy.containment_needs_approval), F.array(supported, F.lit("impact_above_dual_approval_threshold")))
            .otherwise(F.array(supported)),
        )
        .withColumn(
            "refusals",
            F.when(stopped, F.array(F.lit("kill_switch_engaged")))
            .when(listed, F.array(F.lit("entity_is_allowlisted")))
            .when(other, F.array(F.concat(F.lit("suppressed_by_"), c("best"))))
            .otherwise(F.coalesce(c("_blocked"), none)),
        )
        .withColumn(
            "approvals_required",
            F.when(contains & F.lit(policy.containment_needs_approval), F.when(dual, 2).otherwise(1)).otherwise(0),
        )
        .withColumn(
            "expires_after_minutes",
            F.when(takes_effect & c("_wanted").isin("contain", "step_up"), F.lit(policy.default_minutes)),
        )
        .drop("_blocked", "_wanted")
    )


def pause_neutralise(decided: DataFrame) -> DataFrame:
    """While enforcement is paused every action becomes an observation that says so."""
    paused = F.coalesce(F.col("paused"), F.lit(False))
    return (
        decided.withColumn("refusals", F.when(paused, F.array_append("refusals", F.lit("enforcement_paused"))).otherwise(F.col("refusals")))
        .withColumn("action", F.when(paused, "observe").otherwise(F.col("action")))
        .withColumn("approvals_required", F.when(paused, 0).otherwise(F.col("approvals_required")))
        .withColumn("expires_after_minutes", F.when(~paused, F.col("expires_after_minutes")))
    )


def backtest(rows: DataFrame, current: Policy, candidate: Policy) -> DataFrame:
    """Both policies over the same rows and the same state, side by side."""
    out = ("action", "approvals_required")
    now = policy_decide(rows, current)
    kept = [*rows.columns, *[F.col(c).alias(f"current_{c}") for c in out]]
    then = policy_decide(now.select(*kept), candidate)
    return then.select(
        *rows.columns, *[f"current_{c}" for c in out], *[F.col(c).alias(f"proposed_{c}") for c in out],
        (F.col("current_action") != F.col("action")).alias("changed"),
    )


def backtest_summary(rows: DataFrame) -> DataFrame:
    was, will = F.col("current_action") == "contain", F.col("proposed_action") == "contain"
    n = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0).cast("bigint"))
    return rows.agg(
        F.count(F.lit(1)).alias("considered"),
        n(F.col("changed")).alias("changed"),
        n(will & ~was).alias("newly_contained"),
        n(was & ~will).alias("newly_released"),
    )


def mapped_action(decision: Column) -> Column:
    return F.when(decision.isin("contain", "review"), decision).otherwise("monitor")


def ceiling_action() -> Column:
    """Strongest action rules and policy support together."""
    wanted = mapped_action(F.col("decision"))
    supported = (F.col("action") == "contain") & (F.size("refusals") == 0)
    return F.when((wanted == "contain") & ~supported, "review").otherwise(wanted)


def alignment(final_action: Column) -> Column:
    """Whether the final recommendation agrees with rules, policy and model."""
    wanted = mapped_action(F.col("decision"))
    moved = F.col("model_influence").isin("escalated", "deescalated")
    lowered = (wanted == "contain") & (ceiling_action() != "contain")
    return F.when((final_action != wanted) | lowered | moved, "diverges").otherwise("aligned")


def _present(table: Sequence[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in table]))


def explain_claims(decided: DataFrame, *, reasons: int = 4, changes: int = 3) -> DataFrame:
    """Which claims hold for each entity, by identifier; wording belongs to the console.

    ``narrative`` keeps the reading order, ``top_reasons`` and ``top_changes`` are cut by
    priority. Claims about a rule match the rule that fired, not the name of its evidence.
    """
    c = F.col
    fired = lambda rule: F.exists("evidence", lambda e: (e["rule"] == rule) & (e["weight"] > 0))
    against = lambda rule: F.exists("evidence", lambda e: e["rule"] == rule)
    # a model that leaves the call to a person supports nothing
    spoke_not = F.coalesce(c("model_abstained"), F.lit(False)) if "model_abstained" in decided.columns else F.lit(False)
    n_for = F.size(F.filter("evidence", lambda e: e["weight"] > 0))
    n_against = F.size(F.filter("evidence", lambda e: e["weight"] < 0))
    # The claim identifiers, in reading order and by priority.
    narrative = [
        ("headline", c("best").isNotNull()),
        ("severity", F.lit(True)),
        ("top_reason", n_for >= 1),
        ("supporting_reason", n_for >= 2),
        ("mitigating", n_against >= 1),
        ("change_signal", c("change_fired")),
        ("model_opinion", c("risk").isNotNull()),
        ("runner_up", c("runner_up") != c("best")),
        ("time_to_detect", c("last_seen_ms").isNotNull()),
        ("decision", c("decision").isNotNull()),
    ]
    why = [
        ("distinct_cards", c("distinct_cards") > 1),
        ("attempt_volume", c("attempts") > 0),
        ("failure_concentration", c("failures") > 0),
        ("approval_collapse", fired("approval_collapse")),
        ("small_amount_probing", fired("small_amount_probing")),
        ("machine_cadence", fired("machine_cadence")),
        ("arbitration", c("best") == "attack"),
        ("model_corroborates", c("risk").isNotNull() & ~spoke_not),
        ("mitigating_recovery", against("recovery")),
        ("mitigating_infra", against("infrastructure_attribution")),
    ]
    what_if = [
        ("attempts_stop", F.lit(True)),
        ("cards_recover", c("failures") > 0),
        ("margin_narrows", (c("best") == "attack") & c("margin").isNotNull()),
        ("model_drops", c("risk").isNotNull()),
        ("features_stale", F.lit(True)),
        ("analyst_verdict", F.lit(True)),
    ]
    ranked = F.sort_array(
        F.transform(F.filter("evidence", lambda e: e["weight"] > 0), lambda e: F.struct(e["weight"].alias("w"), e["code"].alias("code"))), asc=False
    )
    return (
        decided.withColumn("narrative", _present(narrative))
        .withColumn("top_reasons", F.slice(_present(why), 1, reasons))
        .withColumn("top_changes", F.slice(_present(what_if), 1, changes))
        .withColumn("top_evidence", F.when(F.size(ranked) > 0, ranked[0]["code"]))
    )


def evidence_hash(decided: DataFrame) -> DataFrame:
    """Key of identical facts: evidence order does not matter, noise past six decimals neither."""
    micro = lambda x: F.floor(x * 1e6 + 0.5).cast("bigint").cast("string")
    items = F.array_sort(
        F.transform("evidence", lambda e: F.concat_ws(":", e["code"], micro(e["observed"]), micro(e["weight"])))
    )
    facts = F.concat_ws(
        "|", "entity_kind", "severity", micro(F.col("score")), F.concat_ws(",", items), "best", "runner_up", "decision"
    )
    return decided.withColumn("evidence_hash", F.substring(F.sha2(facts, 256), 1, 32))
