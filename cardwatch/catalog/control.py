"""Queries: policy, containment, enforcement, audit, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import csv, event_pass, fragment, query, with_
from cardwatch.config import DAY_MS, Policy
from cardwatch.operators import audit as Au, containment as Co, policy as P
from cardwatch.operators.attempts import per_payment
from cardwatch.operators.features import ENTITY
from cardwatch.operators.rules import severity
from cardwatch.session import stage
from cardwatch.sources import tables as T

KEY = "scope, entity_kind, entity_key"

# --- containment -------------------------------------------------------------------------------

fragment("cont", ("inc", "clock"), f"""
SELECT *, CASE WHEN activated_ms IS NULL THEN CASE WHEN rejected THEN 'rejected' ELSE 'proposed' END
    WHEN released_ms IS NOT NULL THEN 'released' WHEN expires_ms <= as_of THEN 'expired' ELSE 'active' END AS status,
  CASE WHEN activated_ms IS NULL THEN CASE WHEN rejected THEN proposed_ms + 30000 END
    WHEN released_ms IS NOT NULL THEN released_ms WHEN expires_ms <= as_of THEN expires_ms END AS ended_ms
FROM (SELECT *, CASE WHEN activated_ms IS NOT NULL THEN activated_ms + CASE WHEN seed % 5 = 0 THEN 3600000 ELSE 1800000 END END AS expires_ms,
    CASE WHEN activated_ms IS NOT NULL AND seed % 5 = 2 THEN proposed_ms + 600000 END AS released_ms,
    CASE WHEN activated_ms IS NOT NULL AND seed % 5 = 0 THEN 1 ELSE 0 END AS extensions
  FROM (SELECT scope, incident_id, entity_kind, entity_key, decision, seed, md5('c:' || incident_id) AS containment_id, (seed % 2 + 1)::INT AS approvals_required, detected_ms AS proposed_ms, seed % 5 = 3 AS rejected,
      CASE WHEN seed % 5 = 3 THEN NULL WHEN seed % 2 = 0 THEN detected_ms + 60000 WHEN seed % 9 <> (seed // 9) % 9 THEN detected_ms + 120000 END AS activated_ms
    FROM inc WHERE decision IN ('contain', 'review'))), clock""")
_CONT = ("containment_id", "status", "approvals_required", "proposed_ms", "activated_ms", "expires_ms", "ended_ms", "extensions")


def _states(spark, sf_dir):
    return Co.containment_state(T.containment_log(spark, sf_dir), now_ms=T.newest_ms(spark, sf_dir))


def _containments(spark, sf_dir):
    who = T.containment_log(spark, sf_dir).filter("kind = 'proposed'").select(
        "containment_id", "incident_id", "scope", "entity_kind", "entity_key", "decision"
    )
    return who.join(_states(spark, sf_dir), "containment_id")


@query("containment_state", with_("cont", tail=f"SELECT {', '.join(_CONT)} FROM cont"))
def _(spark, sf_dir):
    return _states(spark, sf_dir).select(*_CONT)


@query("containment_expiry", with_("cont", tail="""
SELECT containment_id, CASE WHEN activated_ms IS NOT NULL AND released_ms IS NULL AND expires_ms <= proposed_ms + 2000000 THEN 'expired' ELSE s END AS status FROM (
SELECT *, CASE WHEN activated_ms IS NULL THEN CASE WHEN rejected THEN 'rejected' ELSE 'proposed' END WHEN released_ms IS NOT NULL THEN 'released' ELSE 'active' END AS s FROM cont)"""))
def _(spark, sf_dir):
    # Judge each containment 2000 s after its proposal: some are due by then, extended ones not.
    states = Co.containment_state(T.containment_log(spark, sf_dir), now_ms=0)
    shifted = states.withColumn("expires_ms", F.col("expires_ms") - F.col("proposed_ms"))
    return Co.expire_due(shifted, now_ms=2_000_000).select("containment_id", "status")


fragment("caps", ("cont",), """
SELECT a.containment_id, a.proposed_ms,
  (SELECT count(*) FROM cont b WHERE b.decision = 'contain' AND b.activated_ms <= a.proposed_ms AND coalesce(b.ended_ms, b.expires_ms) > a.proposed_ms) AS active_containments,
  (SELECT count(*) FROM cont b WHERE b.decision = 'contain' AND b.proposed_ms BETWEEN a.proposed_ms - 3600000 AND a.proposed_ms) AS containments_last_hour
FROM cont a WHERE a.decision = 'contain'""")


@query("containment_caps", with_("caps", tail="SELECT * FROM caps"))
def _(spark, sf_dir):
    contain = stage(_containments(spark, sf_dir).filter("decision = 'contain'"), "containments")
    return Co.containment_caps(contain).select("containment_id", "proposed_ms", "active_containments", "containments_last_hour")


fragment("enf", ("obs",), """
SELECT at_ms, CASE WHEN arg_max(event_id, event_id) % 3 = 0 THEN 'paused' ELSE 'resumed' END AS kind FROM obs WHERE outcome = 'authorized' GROUP BY at_ms""")


@query("enforcement_asof", with_("enf", "pay", tail="""
SELECT p.at_ms, coalesce(e.kind = 'paused', FALSE) AS paused FROM (SELECT DISTINCT at_ms FROM pay) p ASOF LEFT JOIN enf e ON p.at_ms >= e.at_ms"""))
def _(spark, sf_dir):
    moments = per_payment(T.observations(spark, sf_dir)).select("scope", "at_ms")
    return Co.enforcement_as_of(moments, T.enforcement_log(spark, sf_dir)).select("at_ms", "paused")


@query("blocked_attempts", with_("cont", "pay", "enf", tail="""
SELECT scope, payment_id, p.at_ms, blocked_by FROM (
  SELECT p.scope, p.payment_id, p.at_ms, arg_min(c.entity_kind, CASE c.entity_kind WHEN 'session' THEN 1 WHEN 'device' THEN 2 ELSE 3 END) AS blocked_by FROM pay p JOIN cont c ON c.decision = 'contain'
    AND p.at_ms >= c.activated_ms AND p.at_ms < coalesce(c.ended_ms, c.expires_ms)
    AND ((c.entity_kind = 'session' AND c.entity_key = p.session) OR (c.entity_kind = 'device' AND c.entity_key = p.device) OR (c.entity_kind = 'network' AND c.entity_key = p.network))
  GROUP BY ALL) p ASOF LEFT JOIN enf e ON p.at_ms >= e.at_ms WHERE coalesce(e.kind, 'resumed') <> 'paused'"""))
def _(spark, sf_dir):
    contain = stage(_containments(spark, sf_dir).filter("decision = 'contain'"), "containments")
    attempts = stage(per_payment(T.observations(spark, sf_dir)), "attempts")
    return Co.blocked_attempts(attempts, contain, T.enforcement_log(spark, sf_dir))


# --- policy --------------------------------------------------------------------------------------

fragment("pol_in", ("inc",), """
SELECT *, support AS attack_support, probability AS attack_probability, seed % 11 = 0 AS abstained, 10 + seed % 200 AS shop_active_sessions,
  detected_ms + (seed % 3) * 600000 AS now_ms, detected_ms AS features_ms, seed % 6 AS active_containments, seed % 12 AS containments_last_hour FROM inc""")


def _policy_rows(spark, sf_dir):
    seed = F.col("seed")
    return T.incidents(spark, sf_dir).select(
        "*", F.col("support").alias("attack_support"), F.col("probability").alias("attack_probability"), (seed % 11 == 0).alias("abstained"),
        (10 + seed % 200).alias("shop_active_sessions"), (F.col("detected_ms") + (seed % 3) * 600_000).alias("now_ms"),
        F.col("detected_ms").alias("features_ms"), (seed % 6).alias("active_containments"), (seed % 12).alias("containments_last_hour"),
    )


def _policy_sql(contain: float, step_up: float, source: str = "pol_in") -> str:
    return f"""SELECT *, CASE WHEN best <> 'attack' THEN CASE WHEN decision = 'review' THEN 'escalate' ELSE 'observe' END WHEN held THEN 'escalate' ELSE wanted END AS action,
  CASE WHEN best = 'attack' AND NOT held AND wanted = 'contain' THEN CASE WHEN cost_if_act_paise > 50000 THEN 2 ELSE 1 END ELSE 0 END AS approvals_required,
  CASE WHEN best = 'attack' AND NOT held AND wanted IN ('contain', 'step_up') THEN 30 END AS expires_after_minutes,
  CASE WHEN best <> 'attack' THEN 'suppressed_by_' || best ELSE blocked END AS refusals,
  CASE WHEN best <> 'attack' THEN 'better_explanation_' || best WHEN held THEN 'degraded_or_capped_so_escalated_instead'
    ELSE 'attack_supported_at_' || printf('%.2f', attack_support) || CASE WHEN wanted = 'contain' AND cost_if_act_paise > 50000 THEN ',impact_above_dual_approval_threshold' ELSE '' END END AS policy_reasons
FROM (SELECT *, blocked <> '' AND wanted IN ('contain', 'step_up') AS held FROM (
  SELECT *, floor((1 - attack_probability) * 120000 + 0.5)::BIGINT AS cost_if_act_paise,
    floor(attack_probability * 150000 * least(greatest(attempts, 1), 10) + 0.5)::BIGINT AS cost_if_wait_paise,
    CASE WHEN attack_support >= {contain}::DOUBLE THEN 'contain' WHEN attack_support >= {step_up}::DOUBLE THEN 'step_up' ELSE 'escalate' END AS wanted,
    concat_ws(',', CASE WHEN now_ms - features_ms > 900000 THEN 'feature_state_is_stale' END, CASE WHEN distinct_cards IS NULL THEN 'counts_never_confirmed' END,
      CASE WHEN abstained THEN 'arbitration_abstained' END, CASE WHEN active_containments >= 5 THEN 'too_many_active_containments' END,
      CASE WHEN containments_last_hour >= 10 THEN 'hourly_containment_cap_reached' END,
      CASE WHEN shop_active_sessions >= 20 AND (active_containments + 1)::DOUBLE / shop_active_sessions > 0.05 THEN 'would_contain_too_much_of_the_shop' END) AS blocked
  FROM {source}))"""


fragment("pol", ("pol_in",), _policy_sql(0.75, 0.55))
fragment("pol_b", ("pol_in",), _policy_sql(0.5, 0.3))


@query("expected_cost", with_("pol", tail="SELECT incident_id, cost_if_act_paise, cost_if_wait_paise FROM pol"))
def _(spark, sf_dir):
    act, wait = P.expected_cost()
    rows = _policy_rows(spark, sf_dir)
    return rows.select("incident_id", act.alias("cost_if_act_paise"), wait.alias("cost_if_wait_paise"))


_POL = ("incident_id", "action", "approvals_required", "expires_after_minutes")


@query("policy_decide", with_("pol", tail=f"SELECT {', '.join(_POL)}, refusals, policy_reasons FROM pol"))
def _(spark, sf_dir):
    d = P.policy_decide(_policy_rows(spark, sf_dir))
    return d.select(*_POL, csv("refusals").alias("refusals"), csv("policy_reasons").alias("policy_reasons"))


@query("pause_neutralise", with_("pol", "enf", tail="""
SELECT p.incident_id, CASE WHEN paused THEN 'observe' ELSE action END AS action, CASE WHEN paused THEN 0 ELSE approvals_required END AS approvals_required,
  CASE WHEN paused THEN concat_ws(',', nullif(refusals, ''), 'enforcement_paused') ELSE refusals END AS refusals
FROM (SELECT p.*, coalesce(e.kind = 'paused', FALSE) AS paused FROM pol p ASOF LEFT JOIN enf e ON p.detected_ms >= e.at_ms) p"""))
def _(spark, sf_dir):
    d = P.policy_decide(_policy_rows(spark, sf_dir)).withColumn("at_ms", F.col("detected_ms"))
    paused = Co.enforcement_as_of(d.select("scope", "at_ms"), T.enforcement_log(spark, sf_dir))
    out = P.pause_neutralise(d.join(paused, ["scope", "at_ms"], "left"))
    return out.select("incident_id", "action", "approvals_required", csv("refusals").alias("refusals"))


_CANDIDATE = Policy(version=2, contain=0.5, step_up=0.3)


def _backtest(spark, sf_dir):
    return P.backtest(_policy_rows(spark, sf_dir), Policy(), _CANDIDATE)


@query("policy_backtest", with_("pol", "pol_b", tail="SELECT incident_id, a.action AS current_action, b.action AS proposed_action, a.action <> b.action AS changed FROM pol a JOIN pol_b b USING (incident_id)"))
def _(spark, sf_dir):
    return _backtest(spark, sf_dir).select("incident_id", "current_action", "proposed_action", "changed")


@query("policy_backtest_summary", with_("pol", "pol_b", tail="""SELECT count(*) AS considered, count(*) FILTER (WHERE a.action <> b.action) AS changed,
  count(*) FILTER (WHERE b.action = 'contain' AND a.action <> 'contain') AS newly_contained, count(*) FILTER (WHERE a.action = 'contain' AND b.action <> 'contain') AS newly_released FROM pol a JOIN pol_b b USING (incident_id)"""))
def _(spark, sf_dir):
    return P.backtest_summary(_backtest(spark, sf_dir))


@query("ceiling_alignment", with_("pol", tail="""
SELECT incident_id, ceiling, CASE WHEN ceiling <> wanted_action THEN 'diverges' ELSE 'aligned' END AS alignment FROM (
  SELECT *, CASE WHEN decision = 'contain' AND NOT (action = 'contain' AND refusals = '') THEN 'review' WHEN decision IN ('contain', 'review') THEN decision ELSE 'monitor' END AS ceiling,
    CASE WHEN decision IN ('contain', 'review') THEN decision ELSE 'monitor' END AS wanted_action FROM pol)"""))
def _(spark, sf_dir):
    d = P.policy_decide(_policy_rows(spark, sf_dir)).withColumn("model_influence", F.lit("none"))
    d = d.withColumn("ceiling", P.ceiling_action())
    return d.select("incident_id", "ceiling", P.alignment(F.col("ceiling")).alias("alignment"))


_CEILING = "CASE WHEN decision = 'contain' AND NOT (action = 'contain' AND refusals = '') THEN 'review' WHEN decision IN ('contain', 'review') THEN decision ELSE 'monitor' END"


@query("ceiling_action", with_("pol", tail=f"SELECT incident_id, {_CEILING} AS ceiling FROM pol"))
def _(spark, sf_dir):
    return P.policy_decide(_policy_rows(spark, sf_dir)).select("incident_id", P.ceiling_action().alias("ceiling"))


@query("alignment", with_("pol", tail=f"""
SELECT incident_id, CASE WHEN {_CEILING} <> CASE WHEN decision IN ('contain', 'review') THEN decision ELSE 'monitor' END OR seed % 4 = 0 THEN 'diverges' ELSE 'aligned' END AS alignment FROM pol"""))
def _(spark, sf_dir):
    moved = F.when(F.col("seed") % 4 == 0, "escalated").otherwise("corroborated")
    d = P.policy_decide(_policy_rows(spark, sf_dir)).withColumn("model_influence", moved)
    return d.select("incident_id", P.alignment(P.ceiling_action()).alias("alignment"))


_reasons = "concat_ws(',', list_aggregate(list_slice(list_filter([{}], lambda x: x IS NOT NULL), 1, {}), 'string_agg', ','))"
_when = lambda pairs: ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs)
_why = [("distinct_cards", "distinct_cards > 1"), ("attempt_volume", "attempts > 0"), ("failure_concentration", "failures > 0"),
        ("approval_collapse", "r_approval_collapse = 1"), ("small_amount_probing", "r_small_amount_probing = 1"),
        ("machine_cadence", "r_machine_cadence = 1"), ("arbitration", "best = 'attack'"),
        ("model_corroborates", "attempts % 3 <> 0 AND attempts % 5 <> 0"), ("mitigating_recovery", "r_recovery = 1"),
        ("mitigating_infra", "r_infrastructure_attribution = 1")]
_codes = [("card_spread", "distinct_cards_above_threshold", 0.35, "distinct_cards"),
          ("card_spread", "cards_per_attempt_above_threshold", 0.15, "distinct_cards::DOUBLE / attempts"),
          ("velocity", "attempt_rate_above_threshold", 0.2, "attempt_rate"),
          ("card_spread_slow", "distinct_cards_long_span_above_threshold", 0.3, "distinct_cards_long_span"),
          ("card_probing", "orders_per_card_above_threshold", 0.3, "max_orders_per_card"),
          ("approval_collapse", "approval_rate_below_floor", 0.25, "approval_rate"),
          ("reason_mix", "decline_reasons_concentrated", 0.2, "reason_concentration"),
          ("small_amount_probing", "small_amount_share_above_threshold", 0.15, "small_amount_share"),
          ("machine_cadence", "inter_arrival_variation_low", 0.1, "burstiness"),
          ("recovery", "orders_recovered_after_failure", -0.4, "recovered_orders"),
          ("infrastructure_attribution", "failures_attributed_to_gateway", -0.5, "infra_failure_share"),
          ("card_reuse", "cards_reused_across_attempts", -0.25, "attempts::DOUBLE / distinct_cards")]
_top = "list_reverse_sort(list_filter([" + ", ".join(
    f"CASE WHEN r_{r} = 1 THEN {{'w': {w}::DOUBLE, 'c': '{c}'}} END" for r, c, w, _ in _codes if w > 0) + "], lambda x: x IS NOT NULL))[1].c"


_n = lambda sign: "len(list_filter([" + ", ".join(f"CASE WHEN r_{r} = 1 THEN 1 END" for r, _, w, _ in _codes if w * sign > 0) + "], lambda x: x IS NOT NULL))"
_story = [("headline", "best IS NOT NULL"), ("severity", "TRUE"), ("top_reason", f"{_n(1)} >= 1"), ("supporting_reason", f"{_n(1)} >= 2"), ("mitigating", f"{_n(-1)} >= 1"),
          ("change_signal", "failures % 2 = 1"), ("model_opinion", "attempts % 3 <> 0"), ("runner_up", "runner_up <> best"), ("time_to_detect", "TRUE"), ("decision", "decision IS NOT NULL")]
_if = [("attempts_stop", "TRUE"), ("cards_recover", "failures > 0"), ("margin_narrows", "best = 'attack' AND margin IS NOT NULL"), ("model_drops", "attempts % 3 <> 0"),
       ("features_stale", "TRUE"), ("analyst_verdict", "TRUE")]


@query("explain_claims", with_("dec", tail=f"""SELECT {KEY}, {_reasons.format(_when(_story), 10)} AS narrative, {_reasons.format(_when(_why), 4)} AS top_reasons,
  {_reasons.format(_when(_if), 3)} AS top_changes, {_top} AS top_evidence FROM dec"""))
def _(spark, sf_dir):
    """With a model that speaks for two entities in three, abstains for one in five, and a change signal for every second."""
    decided = (
        event_pass(spark, sf_dir).decided.withColumn("risk", F.when(F.col("attempts") % 3 != 0, F.col("score")))
        .withColumn("model_abstained", F.col("attempts") % 5 == 0)
        .withColumn("change_fired", F.col("failures") % 2 == 1)
    )
    out = P.explain_claims(decided)
    return out.select(*ENTITY, csv("narrative").alias("narrative"), csv("top_reasons").alias("top_reasons"), csv("top_changes").alias("top_changes"), "top_evidence")


_items = "list_sort(list_filter([" + ", ".join(
    f"CASE WHEN r_{r} = 1 THEN '{c}:' || floor(({o}) * 1e6 + 0.5)::BIGINT || ':' || floor(({w})::DOUBLE * 1e6 + 0.5)::BIGINT END" for r, c, w, o in _codes) + "], lambda x: x IS NOT NULL))"


@query("evidence_hash", with_("dec", tail=f"""
SELECT {KEY}, substr(sha256(concat_ws('|', entity_kind, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END, floor(score * 1e6 + 0.5)::BIGINT,
  coalesce(list_aggregate({_items}, 'string_agg', ','), ''), best, runner_up, decision)), 1, 32) AS evidence_hash FROM dec"""))
def _(spark, sf_dir):
    decided = event_pass(spark, sf_dir).decided.withColumn("severity", severity(F.col("score")))
    return P.evidence_hash(decided).select(*ENTITY, "evidence_hash")


# --- audit -----------------------------------------------------------------------------------------

fragment("chains", ("obs",), "SELECT payment_id AS chain_id, count(*) AS n, min(event_id) % 7 AS how FROM obs GROUP BY payment_id")


@query("audit_verify", with_("chains", tail="""
SELECT chain_id, reason, reason IS NULL AS valid, CASE reason WHEN 'hash-mismatch' THEN 2 WHEN 'sequence-gap' THEN 3 WHEN 'out-of-order' THEN 3
  WHEN 'broken-link' THEN CASE WHEN how = 5 THEN 1 ELSE 3 END END::BIGINT AS diverges_at_seq, n - CASE WHEN how = 2 AND n >= 2 THEN 1 ELSE 0 END AS entries FROM (
  SELECT *, CASE WHEN how = 1 AND n >= 2 THEN 'hash-mismatch' WHEN how = 2 AND n >= 3 THEN 'sequence-gap' WHEN how = 3 AND n >= 3 THEN 'broken-link'
    WHEN how = 4 AND n >= 3 THEN 'out-of-order' WHEN how = 5 THEN 'broken-link' END AS reason FROM chains)"""))
def _(spark, sf_dir):
    log = stage(T.audit_log(spark, sf_dir), "audit")
    return Au.verify_chain(log).select("chain_id", "reason", "valid", "diverges_at_seq", "entries")


fragment("entries", ("obs", "chains"), """
SELECT chain_id, how, row_number() OVER (PARTITION BY payment_id ORDER BY at_ms, event_id) AS seq, at_ms, session AS actor_id, 'payment.' || outcome AS kind,
  'payment' AS subject_type, payment_id AS subject_id, '{"amount":' || amount_paise || ',"card":"' || card_id || '"}' AS payload, event_id FROM obs JOIN chains ON payment_id = chain_id""")


_tampered = "seq = 2 AND how IN (1, 3)"
fragment("log", ("entries",), f"SELECT chain_id, seq, at_ms, actor_id, kind, subject_type, subject_id, CASE WHEN {_tampered} THEN '{{\"amount\":1}}' ELSE payload END AS payload FROM entries WHERE NOT (seq = 2 AND how = 2)")


@query("audit_hash", with_("log", tail="""
SELECT chain_id, seq, sha256('["' || concat_ws('","', at_ms, actor_id, kind, subject_type, subject_id, replace(payload, '"', '\\"'), '1') || '",null,null,null,"' || repeat('0', 64) || '"]') AS hash FROM log"""))
def _(spark, sf_dir):
    # Every entry hashed against one fixed previous hash, so the value depends on its content only.
    return T.audit_log(spark, sf_dir).select("chain_id", "seq", Au.content_hash(F.lit(Au.GENESIS)).alias("hash"))


@query("audit_filter", with_("log", tail="SELECT chain_id, seq, at_ms, kind FROM log WHERE at_ms >= 1704500000000 AND at_ms <= 1706000000000 AND kind = 'payment.failed' AND contains(lower(concat_ws(chr(10), kind, actor_id, subject_type, subject_id, payload)), 'c1')"))
def _(spark, sf_dir):
    keep = Au.audit_filter(from_ms=1_704_500_000_000, to_ms=1_706_000_000_000, kind="payment.failed", text="C1")
    return T.audit_log(spark, sf_dir).filter(keep).select("chain_id", "seq", "at_ms", "kind")


@query("audit_by_day", with_("log", tail="SELECT at_ms // 86400000 AS day, count(*) AS entries, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM log GROUP BY ALL"))
def _(spark, sf_dir):
    return Au.audit_by_day(T.audit_log(spark, sf_dir))


def _subjects(spark, sf_dir):
    """Log rows about incidents and containments, from their own moves."""
    inc = T.incidents(spark, sf_dir).select("detected_ms", F.lit("incident").alias("subject_type"), F.col("incident_id").alias("subject_id"), F.col("status").alias("kind"))
    con = T.containment_log(spark, sf_dir).select(F.col("at_ms").alias("detected_ms"), F.lit("containment").alias("subject_type"), F.col("containment_id").alias("subject_id"), "kind")
    return inc.unionByName(con).withColumnRenamed("detected_ms", "at_ms")


@query("audit_for_incident", with_("inc", tail="""
SELECT incident_id, 'incident' AS subject_type, status AS kind, detected_ms AS at_ms FROM inc
UNION ALL SELECT incident_id, 'containment', k, t FROM (SELECT incident_id, unnest([{'k': 'proposed', 't': detected_ms}, {'k': 'approved', 't': detected_ms + 60000}, {'k': 'approved', 't': detected_ms + 120000}]
  || CASE seed % 5 WHEN 3 THEN [{'k': 'rejected', 't': detected_ms + 30000}] WHEN 2 THEN [{'k': 'released', 't': detected_ms + 600000}] WHEN 4 THEN [] ELSE [{'k': 'extended', 't': detected_ms + 300000}] END, recursive := TRUE)
  FROM inc WHERE decision IN ('contain', 'review'))"""))
def _(spark, sf_dir):
    owned = T.containment_log(spark, sf_dir).filter("kind = 'proposed'").select("incident_id", "containment_id")
    out = Au.audit_for_incidents(_subjects(spark, sf_dir), T.incidents(spark, sf_dir), owned)
    return out.select("incident_id", "subject_type", "kind", "at_ms")


@query("lockout", with_("pay", "clock", tail=f"""
SELECT session, count(*) = 3 AND bool_and(outcome = 'failed') AS locked FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY at_ms DESC, payment_id) AS n FROM pay, clock WHERE at_ms > as_of - {14 * DAY_MS})
WHERE n <= 3 GROUP BY session"""))
def _(spark, sf_dir):
    attempts = per_payment(T.observations(spark, sf_dir))
    return Au.lockout(attempts, key="session", now_ms=T.newest_ms(spark, sf_dir), window_ms=14 * DAY_MS, n=3)
