"""Queries: collapse, features, traffic, rules, score, explanations, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import (
    ABSTAINED_SQL, FIRED_SQL, WINDOW, csv, event_pass, fragment, q6, query, r6, with_,
)
from cardwatch.operators import hypotheses as H
from cardwatch.operators.attempts import per_payment
from cardwatch.operators.features import (
    ENTITY, activity, cadence, candidates, distinct_estimates, exact_median, features, in_window, stack_kinds, variety,
)
from cardwatch.operators.rules import evaluate_rules, fired_rules, score, severity, warrants_incident
from cardwatch.operators.traffic import session_totals, card_testing, traffic_context
from cardwatch.plans.detect import recent_observations
from cardwatch.session import stage
from cardwatch.sources.tables import newest_ms, observations

KEY = "scope, entity_kind, entity_key"


def _attempts(spark, sf_dir):
    """Attempts of the lookback: of the history before it, only what payments seen inside it still need."""
    as_of = newest_ms(spark, sf_dir)
    recent = recent_observations(observations(spark, sf_dir), as_of_ms=as_of, lookback_ms=WINDOW.lookback_ms)
    return per_payment(recent, as_of_ms=as_of), as_of


@query("per_payment", with_("pay", tail="SELECT scope, payment_id, at_ms, outcome, order_id, amount_paise, card_id, session, device, network, source, error_reason, error_source, n_events FROM pay"))
def _(spark, sf_dir):
    return per_payment(observations(spark, sf_dir)).select(
        "scope", "payment_id", "at_ms", "outcome", "order_id", "amount_paise", "card_id", "session", "device",
        "network", "source", "error_reason", "error_source", "n_events",
    )


_COUNTS = ("attempts", "failures", "captures", "distinct_cards", "distinct_sessions", "distinct_networks",
           "distinct_cards_long_span", "recovered_orders", "max_orders_per_card", "first_seen_ms", "last_seen_ms", "provenance")
_RATES = ("attempt_rate", "failure_rate", "approval_rate", "infra_failure_share", "small_amount_share",
          "reason_concentration", "recovery_rate", "burstiness", "median_amount_paise")
_feat_cols = ", ".join([KEY, *_COUNTS, *[f"{r6(c)} AS {c}" for c in _RATES]])


@query("features_all", with_("feat", tail=f"SELECT {_feat_cols} FROM feat"))
def _(spark, sf_dir):
    attempts, as_of = _attempts(spark, sf_dir)
    vectors = features(stage(attempts, "attempts"), as_of_ms=as_of, window=WINDOW, median=True)
    return vectors.select(*ENTITY, *_COUNTS, *[q6(c).alias(c) for c in _RATES])


@query("features_one", with_("feat", tail=f"SELECT {_feat_cols} FROM feat WHERE entity_kind = 'network' AND entity_key = 'n3'"))
def _(spark, sf_dir):
    # An attempt's network is its first event's, so the entity filter comes after the collapse.
    attempts, as_of = _attempts(spark, sf_dir)
    attempts = attempts.filter(F.col("network") == "n3")
    vectors = features(
        stage(attempts, "attempts"), as_of_ms=as_of, window=WINDOW, kinds=("network",), entity_key="n3", median=True
    )
    return vectors.select(*ENTITY, *_COUNTS, *[q6(c).alias(c) for c in _RATES])


def _entities(spark, sf_dir):
    attempts, as_of = _attempts(spark, sf_dir)
    return stack_kinds(in_window(attempts, as_of, WINDOW.lookback_ms)), as_of


def _act(name, columns, rates=()):
    cols = ", ".join([KEY, *columns, *[f"{r6(c)} AS {c}" for c in rates]])

    @query(name, with_("feat", tail=f"SELECT {cols} FROM feat"))
    def _(spark, sf_dir):
        entities, as_of = _entities(spark, sf_dir)
        return activity(entities, as_of, WINDOW).select(*ENTITY, *columns, *[q6(c).alias(c) for c in rates])


_act("attempt_rate", (), ("attempt_rate",))
_act("failure_rate", (), ("failure_rate",))
_act("attempts", ("attempts", "failures", "captures"))
_act("failures", ("failures",))
_act("approval_rate", (), ("approval_rate",))
_act("infrastructure_failure_share", (), ("infra_failure_share",))
_act("small_amount_share", (), ("small_amount_share",))
_act("first_seen", ("first_seen_ms",))
_act("last_seen", ("last_seen_ms",))
_act("first_last_seen", ("first_seen_ms", "last_seen_ms", "provenance"))


def _var(name, columns, rates=()):
    cols = ", ".join([KEY, *columns, *[f"{r6(c)} AS {c}" for c in rates]])

    @query(name, with_("feat", tail=f"SELECT {cols} FROM feat"))
    def _(spark, sf_dir):
        entities, as_of = _entities(spark, sf_dir)
        recent = activity(entities, as_of, WINDOW).select(*ENTITY)
        return variety(entities, as_of, WINDOW).join(recent, list(ENTITY), "left_semi").select(
            *ENTITY, *columns, *[q6(c).alias(c) for c in rates]
        )


_var("distinct_cards", ("distinct_cards",))
_var("distinct_sessions", ("distinct_sessions",))
_var("distinct_networks", ("distinct_networks",))
_var("distinct_cards_long_span", ("distinct_cards_long_span",))
_var("max_orders_per_card", ("max_orders_per_card",))
_var("recovery_rate", ("recovered_orders",), ("recovery_rate",))
_var("recovered_orders", ("recovered_orders",))
_var("reason_concentration", (), ("reason_concentration",))


@query("burstiness", with_("f_cad", tail=f"SELECT {KEY}, {r6('burstiness')} AS burstiness FROM f_cad"))
def _(spark, sf_dir):
    entities, as_of = _entities(spark, sf_dir)
    return cadence(entities, as_of, WINDOW).select(*ENTITY, q6("burstiness").alias("burstiness"))


@query("interarrival", with_("ent_w", tail=f"""
SELECT {KEY}, payment_id, at_ms, at_ms - lag(at_ms) OVER (PARTITION BY {KEY} ORDER BY at_ms, payment_id) AS gap_ms
FROM ent_w"""))
def _(spark, sf_dir):
    from cardwatch.operators.velocity import interarrival

    attempts, as_of = _attempts(spark, sf_dir)
    return interarrival(stack_kinds(in_window(attempts, as_of, WINDOW.window_ms))).select(*ENTITY, "payment_id", "at_ms", "gap_ms")


@query("median_amount", with_("feat", tail=f"SELECT {KEY}, {r6('median_amount_paise')} AS median_amount_paise FROM feat"))
def _(spark, sf_dir):
    entities, as_of = _entities(spark, sf_dir)
    recent = stage(in_window(entities, as_of, WINDOW.window_ms).select(*ENTITY, "amount_paise"), "amounts")
    return exact_median(recent, ENTITY, "amount_paise", "median_amount_paise").select(
        *ENTITY, q6("median_amount_paise").alias("median_amount_paise")
    )


@query("hll_estimates", with_("feat", tail=f"SELECT {KEY}, distinct_cards AS exact, TRUE AS within_bound FROM feat"))
def _(spark, sf_dir):
    """Sketch estimate against the exact count; the estimate must stay within three bounds."""
    attempts, as_of = _attempts(spark, sf_dir)
    vectors = features(stage(attempts, "attempts"), as_of_ms=as_of, window=WINDOW, sketches=True)
    e = distinct_estimates(vectors).select(*ENTITY, "distinct_cards.*")
    return e.select(*ENTITY, "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 3 * F.col("error_bound")).alias("within_bound"))


@query("rank_candidates", with_("feat", tail=f"""
SELECT {KEY}, failures, distinct_cards, attempts, position FROM (
  SELECT *, row_number() OVER (PARTITION BY scope, entity_kind ORDER BY failures DESC, distinct_cards DESC, attempts DESC, entity_key) AS position FROM feat)
WHERE position <= 40"""))
def _(spark, sf_dir):
    attempts, as_of = _attempts(spark, sf_dir)
    ranked = candidates(stage(attempts, "attempts"), as_of_ms=as_of, window=WINDOW, limit=40)
    return ranked.select(*ENTITY, "failures", "distinct_cards", "attempts", "position")


@query("stack_kinds", with_("ent", tail="SELECT entity_kind, count(*) AS rows_n, count(DISTINCT entity_key) AS keys_n FROM ent GROUP BY entity_kind"))
def _(spark, sf_dir):
    attempts = per_payment(observations(spark, sf_dir), as_of_ms=newest_ms(spark, sf_dir))
    per_key = stack_kinds(attempts).groupBy("entity_kind", "entity_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("entity_kind").agg(F.sum("n").alias("rows_n"), F.count(F.lit(1)).alias("keys_n"))


_TRAFFIC = ("attempts", "failures", "failing_sessions", "active_sessions", "card_testing_sessions", "distinct_cards")
_TRAFFIC_RATES = ("approval_rate", "infra_failure_share", "top_session_failure_share", "failing_session_approval_rate")


@query("traffic_context", with_("traf", tail="SELECT scope, " + ", ".join(
    [f"shop_{c} AS {c}" for c in _TRAFFIC] + [f"{r6('shop_' + c)} AS {c}" for c in _TRAFFIC_RATES]) + " FROM traf"))
def _(spark, sf_dir):
    attempts, as_of = _attempts(spark, sf_dir)
    context = traffic_context(stage(attempts, "attempts"), as_of_ms=as_of, window=WINDOW)
    return context.select("scope", *_TRAFFIC, *[q6(c).alias(c) for c in _TRAFFIC_RATES])


def _context_part(name):
    @query(name, with_("traf", tail=f"SELECT scope, {r6('shop_' + name)} AS {name} FROM traf"))
    def _(spark, sf_dir):
        attempts, as_of = _attempts(spark, sf_dir)
        context = traffic_context(stage(attempts, "attempts"), as_of_ms=as_of, window=WINDOW)
        return context.select("scope", q6(name).alias(name))


_context_part("top_session_failure_share")
_context_part("failing_session_approval_rate")


@query("session_agg", with_("sess", tail="SELECT * FROM sess"))
def _(spark, sf_dir):
    attempts, as_of = _attempts(spark, sf_dir)
    return session_totals(in_window(attempts, as_of, WINDOW.window_ms))


@query("card_testing_sessions", with_("sess", tail="SELECT scope, session, attempts, cards FROM sess WHERE attempts >= 2 AND captures = 0 AND cards >= 2 AND NOT (failures > 0 AND gateway_failures * 2 > failures)"))
def _(spark, sf_dir):
    attempts, as_of = _attempts(spark, sf_dir)
    flagged = card_testing(session_totals(in_window(attempts, as_of, WINDOW.window_ms)))
    return flagged.filter("card_testing").select("scope", "session", "attempts", "cards")


@query("vectors_x_traffic", with_("rules", tail=f"SELECT {KEY}, attempts, distinct_cards, shop_attempts, shop_failing_sessions, {r6('shop_approval_rate')} AS shop_approval_rate FROM rules"))
def _(spark, sf_dir):
    p = event_pass(spark, sf_dir)
    from cardwatch.operators.traffic import with_traffic

    return with_traffic(p.vectors, p.traffic).select(
        *ENTITY, "attempts", "distinct_cards", "shop_attempts", "shop_failing_sessions", q6("shop_approval_rate").alias("shop_approval_rate")
    )


@query("rules_eval", with_("rules", tail=f"SELECT {KEY}, {FIRED_SQL} AS fired, {ABSTAINED_SQL} AS abstained FROM rules"))
def _(spark, sf_dir):
    attempts, as_of = _attempts(spark, sf_dir)
    judged = evaluate_rules(features(stage(attempts, "attempts"), as_of_ms=as_of, window=WINDOW))
    return judged.select(
        *ENTITY,
        csv(F.array_distinct(F.transform("evidence", lambda e: e["rule"]))).alias("fired"),
        csv(F.transform("abstentions", lambda a: a["rule"])).alias("abstained"),
    )


_SCORE = ("score", "score_lower", "score_upper", "band", "incriminating", "mitigating")


@query("score", with_("scored", tail=f"SELECT {KEY}, {', '.join(_SCORE)} FROM scored"))
def _(spark, sf_dir):
    attempts, as_of = _attempts(spark, sf_dir)
    judged = score(evaluate_rules(features(stage(attempts, "attempts"), as_of_ms=as_of, window=WINDOW)))
    return judged.select(*ENTITY, *_SCORE)


_WARRANT_SQL = """score >= 0.4 AND band <> 'low' AND (r_card_spread = 1 OR r_card_spread_slow = 1 OR r_velocity = 1
  OR r_small_amount_probing = 1 OR r_machine_cadence = 1)"""
fragment("warranted", ("dec",), f"SELECT * FROM dec WHERE {_WARRANT_SQL}")


@query("warrants_incident", with_("scored", tail=f"SELECT {KEY}, {_WARRANT_SQL} AS warrants FROM scored"))
def _(spark, sf_dir):
    return event_pass(spark, sf_dir).decided.select(*ENTITY, warrants_incident().alias("warrants"))


@query("fired_rules", with_("scored", tail=f"SELECT {KEY}, fired, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM scored"))
def _(spark, sf_dir):
    return event_pass(spark, sf_dir).decided.select(*ENTITY, csv(fired_rules()).alias("fired"), severity(F.col("score")).alias("severity"))


@query("arbitrate", with_("arb", tail=f"SELECT {KEY}, best, runner_up, best_support, margin, attack_probability, attack_support FROM arb"))
def _(spark, sf_dir):
    return event_pass(spark, sf_dir).decided.select(
        *ENTITY, "best", "runner_up", "best_support", "margin",
        H.fit_of("attack", "probability").alias("attack_probability"), H.fit_of("attack", "support").alias("attack_support"),
    )


@query("decide", with_("dec", tail=f"SELECT {KEY}, score, best, decision, abstained, reasons FROM dec"))
def _(spark, sf_dir):
    return event_pass(spark, sf_dir).decided.select(*ENTITY, "score", "best", "decision", "abstained", csv("reasons").alias("reasons"))


_cost = lambda col, side: "CASE " + col + " " + " ".join(f"WHEN '{h}' THEN '{v[side]}'" for h, v in H.COUNTERFACTUAL.items()) + " END"


@query("counterfactual", with_("dec", tail=f"""SELECT {KEY}, best, {_cost('best', 0)} AS if_wrong_to_act, {_cost('best', 1)} AS if_wrong_to_wait,
  {_cost('runner_up', 0)} AS runner_up_if_wrong_to_act, {_cost('runner_up', 1)} AS runner_up_if_wrong_to_wait FROM dec"""))
def _(spark, sf_dir):
    return H.counterfactual(event_pass(spark, sf_dir).decided).select(
        *ENTITY, "best", "if_wrong_to_act", "if_wrong_to_wait", "runner_up_if_wrong_to_act", "runner_up_if_wrong_to_wait"
    )


# A stand-in risk derived from the vector itself, so the combination runs over every entity.
_RISK_SQL = "(CASE WHEN attempts = 0 THEN NULL ELSE failures::DOUBLE / attempts END)"


@query("combine_model", with_("dec", tail=f"""
SELECT {KEY}, CASE WHEN esc OR soft THEN 'review' ELSE decision END AS decision,
  CASE WHEN esc THEN 'escalated' WHEN soft THEN 'deescalated' WHEN agree THEN 'corroborated' ELSE 'none' END AS model_influence
FROM (SELECT *, risk >= 0.7 AND decision NOT IN ('contain', 'review') AND best NOT IN ('outage', 'retry_storm', 'healthy_traffic') AS esc,
  risk <= 0.15 AND decision = 'contain' AS soft, risk >= 0.7 AND decision IN ('contain', 'review') AS agree
  FROM (SELECT *, {_RISK_SQL} AS risk FROM dec))"""))
def _(spark, sf_dir):
    decided = event_pass(spark, sf_dir).decided.withColumn("risk", F.try_divide(F.col("failures").cast("double"), F.col("attempts")))
    return H.combine_model(decided).select(*ENTITY, "decision", "model_influence")


@query("model_flag", with_("feat", tail=f"SELECT {KEY}, {_RISK_SQL} >= 0.8 AS flagged FROM feat"))
def _(spark, sf_dir):
    entities, as_of = _entities(spark, sf_dir)
    vectors = activity(entities, as_of, WINDOW).withColumn("risk", F.try_divide(F.col("failures").cast("double"), F.col("attempts")))
    return vectors.select(*ENTITY, H.model_flag().alias("flagged"))
