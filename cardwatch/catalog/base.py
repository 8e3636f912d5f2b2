"""Query registry: each entry is a Spark query and, where SQL can say it, the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch.config import DAY_MS, FeatureWindow
from cardwatch.plans.detect import Pass, detection_pass
from cardwatch.sources.tables import newest_ms, observations

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The event stream is sparse, so its windows are days instead of minutes.
WINDOW = FeatureWindow(window_ms=7 * DAY_MS, half_life_ms=DAY_MS, long_span_ms=14 * DAY_MS)
IDLE_MS = DAY_MS


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def q6(column: str | Column) -> Column:
    """Six decimals, rounded the same way the SQL side does it."""
    col = F.col(column) if isinstance(column, str) else column
    return (F.floor(col * 1e6 + 0.5) / F.lit(1e6)).cast("double")


def csv(column: str | Column) -> Column:
    return F.concat_ws(",", F.col(column) if isinstance(column, str) else column)


def event_pass(spark: SparkSession, sf_dir: str, **options) -> Pass:
    """Detection over the event stream, as of just after its newest event."""
    return detection_pass(
        observations(spark, sf_dir), as_of_ms=newest_ms(spark, sf_dir), window=WINDOW, **options
    )


# ---------------------------------------------------------------------------------------------
# SQL building blocks (DuckDB dialect). Each fragment names the fragments it needs.

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def fragment(name: str, needs: tuple[str, ...], body: str) -> None:
    FRAGMENTS[name] = (needs, body)


def with_(*names: str, tail: str) -> str:
    """A WITH clause holding the named fragments and everything they need, then ``tail``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in FRAGMENTS[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = ",\n".join(f"{n} AS ({FRAGMENTS[n][1]})" for n in ordered)
    return f"WITH RECURSIVE {parts}\n{tail}"


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"


def r3(expr: str) -> str:
    return f"floor(({expr}) * 1e3 + 0.5) / 1e3"


def div0(top: str, bottom: str) -> str:
    return f"(CASE WHEN ({bottom}) = 0 THEN 0.0 ELSE ({top})::DOUBLE / ({bottom})::DOUBLE END)"


W, HL, LONG = WINDOW.window_ms, WINDOW.half_life_ms, WINDOW.long_span_ms

fragment("obs", (), """
SELECT 'shop' AS scope, event_id, (epoch_us(ts) // 1000) AS at_ms,
  'o' || user_id || '_' || ((epoch_us(ts) // 1000) // 259200000) AS order_id,
  'p' || user_id || '_' || ((epoch_us(ts) // 1000) // 86400000) AS payment_id,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'captured' WHEN 'signup' THEN 'authorized' ELSE 'other' END AS outcome,
  floor(value * 100 + 0.5)::BIGINT AS amount_paise,
  'c' || (regexp_extract(props, '([0-9]+)', 1)::INT % 40) AS card_id,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'gateway' WHEN 1 THEN 'bank' ELSE 'customer' END END AS error_source,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'card_declined' WHEN 1 THEN 'invalid_card' WHEN 2 THEN 'insufficient_funds' ELSE 'gateway_timeout' END END AS error_reason,
  's' || user_id AS session, 'd' || (user_id % 37) AS device, 'n' || (user_id % 11) AS network,
  CASE WHEN event_id % 10 = 0 THEN 'replay' ELSE 'live' END AS source,
  (epoch_us(ts) // 1000) + (event_id % 7) * 60000 AS received_ms
FROM events""")

fragment("clock", (), "SELECT (epoch_us(max(ts)) // 1000) + 1000 AS as_of FROM events")

fragment("pay", ("obs",), """
SELECT scope, payment_id, min(at_ms) AS at_ms,
  max(CASE outcome WHEN 'failed' THEN 1 WHEN 'authorized' THEN 2 WHEN 'captured' THEN 3 ELSE 0 END) AS outcome_rank,
  CASE max(CASE outcome WHEN 'failed' THEN 1 WHEN 'authorized' THEN 2 WHEN 'captured' THEN 3 ELSE 0 END)
    WHEN 0 THEN 'other' WHEN 1 THEN 'failed' WHEN 2 THEN 'authorized' ELSE 'captured' END AS outcome,
  first(order_id ORDER BY at_ms, event_id) AS order_id,
  first(amount_paise ORDER BY at_ms, event_id) AS amount_paise,
  first(card_id ORDER BY at_ms, event_id) AS card_id,
  first(session ORDER BY at_ms, event_id) AS session,
  first(device ORDER BY at_ms, event_id) AS device,
  first(network ORDER BY at_ms, event_id) AS network,
  first(source ORDER BY at_ms, event_id) AS source,
  first(error_reason ORDER BY at_ms, event_id) FILTER (WHERE error_reason IS NOT NULL) AS error_reason,
  first(error_source ORDER BY at_ms, event_id) FILTER (WHERE error_source IS NOT NULL) AS error_source,
  count(*) AS n_events
FROM obs GROUP BY scope, payment_id""")

fragment("ent", ("pay",), """
SELECT *, 'session' AS entity_kind, session AS entity_key FROM pay
UNION ALL SELECT *, 'device', device FROM pay
UNION ALL SELECT *, 'network', network FROM pay""")

fragment("ent_w", ("ent", "clock"), f"""
SELECT ent.* FROM ent, clock WHERE at_ms <= as_of AND at_ms >= as_of - {W}""")

_dec = f"(CASE WHEN as_of - at_ms <= 0 THEN 1.0 ELSE pow(2.0, -(as_of - at_ms) / {float(HL)}) END)"
fragment("f_act", ("ent_w", "clock"), f"""
SELECT scope, entity_kind, entity_key,
  sum({_dec}) / {W / 60000} AS attempt_rate,
  coalesce(sum({_dec}) FILTER (WHERE outcome = 'failed'), 0) / {W / 60000} AS failure_rate,
  count(*) AS attempts, count(*) FILTER (WHERE outcome = 'failed') AS failures,
  count(*) FILTER (WHERE outcome = 'captured') AS captures,
  count(*) FILTER (WHERE outcome = 'failed' AND error_source = 'gateway') AS gateway_failures,
  {div0("count(*) FILTER (WHERE amount_paise <= 5000)", "count(amount_paise)")} AS small_amount_share,
  median(amount_paise) AS median_amount_paise,
  count(DISTINCT card_id) AS distinct_cards, count(DISTINCT session) AS distinct_sessions,
  count(DISTINCT network) AS distinct_networks,
  min(at_ms) AS first_seen_ms, max(at_ms) AS last_seen_ms,
  CASE WHEN bool_or(source = 'replay') THEN 'replay' ELSE 'live' END AS provenance
FROM ent_w, clock GROUP BY scope, entity_kind, entity_key""")
fragment("f_long", ("ent", "clock"), f"""
SELECT scope, entity_kind, entity_key, count(DISTINCT card_id) AS distinct_cards_long_span
FROM ent, clock WHERE at_ms <= as_of AND at_ms >= as_of - {LONG} GROUP BY ALL""")
fragment("f_reason", ("ent_w",), """
SELECT scope, entity_kind, entity_key, sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE AS reason_concentration FROM (
  SELECT scope, entity_kind, entity_key, coalesce(error_reason, 'unknown') AS reason, count(*) AS n
  FROM ent_w WHERE outcome = 'failed' GROUP BY ALL) GROUP BY ALL""")
fragment("f_order", ("ent_w",), """
SELECT scope, entity_kind, entity_key, count(*) AS orders, count(*) FILTER (WHERE f AND c) AS recovered_orders FROM (
  SELECT scope, entity_kind, entity_key, order_id, bool_or(outcome = 'failed') AS f, bool_or(outcome = 'captured') AS c
  FROM ent_w GROUP BY ALL) GROUP BY ALL""")
fragment("f_card", ("ent_w",), """
SELECT scope, entity_kind, entity_key, max(n) AS max_orders_per_card FROM (
  SELECT scope, entity_kind, entity_key, card_id, count(DISTINCT order_id) AS n FROM ent_w GROUP BY ALL) GROUP BY ALL""")
fragment("f_cad", ("ent_w",), """
SELECT scope, entity_kind, entity_key, CASE WHEN count(*) < 3 OR avg(gap) = 0 THEN 0.0 ELSE stddev_pop(gap) / avg(gap) END AS burstiness FROM (
  SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY scope, entity_kind, entity_key ORDER BY at_ms) AS gap FROM ent_w) GROUP BY ALL""")
fragment("feat", ("f_act", "f_long", "f_reason", "f_order", "f_card", "f_cad"), f"""
SELECT scope, entity_kind, entity_key, attempt_rate, failure_rate, attempts, failures, captures,
  {div0("captures", "attempts")} AS approval_rate,
  {div0("gateway_failures", "failures")} AS infra_failure_share,
  small_amount_share, median_amount_paise, distinct_cards, distinct_sessions, distinct_networks,
  distinct_cards_long_span, coalesce(reason_concentration, 0.0) AS reason_concentration,
  recovered_orders, {div0("recovered_orders", "orders")} AS recovery_rate, max_orders_per_card, burstiness,
  first_seen_ms, last_seen_ms, provenance
FROM f_act JOIN f_long USING (scope, entity_kind, entity_key)
  LEFT JOIN f_reason USING (scope, entity_kind, entity_key)
  JOIN f_order USING (scope, entity_kind, entity_key)
  JOIN f_card USING (scope, entity_kind, entity_key)
  JOIN f_cad USING (scope, entity_kind, entity_key)""")

fragment("pay_w", ("pay", "clock"), f"SELECT pay.* FROM pay, clock WHERE at_ms <= as_of AND at_ms >= as_of - {W}")
fragment("sess", ("pay_w",), """
SELECT scope, session, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'captured') AS captures,
  count(*) FILTER (WHERE outcome = 'failed') AS failures,
  count(*) FILTER (WHERE outcome = 'failed' AND error_source = 'gateway') AS gateway_failures,
  count(DISTINCT card_id) AS cards FROM pay_w GROUP BY ALL""")
fragment("traf", ("sess", "pay_w"), f"""
SELECT scope, sum(attempts)::BIGINT AS shop_attempts, sum(failures)::BIGINT AS shop_failures,
  {div0("sum(captures)", "sum(attempts)")} AS shop_approval_rate,
  {div0("sum(gateway_failures)", "sum(failures)")} AS shop_infra_failure_share,
  count(*) FILTER (WHERE failures > 0) AS shop_failing_sessions, count(*) AS shop_active_sessions,
  {div0("max(failures)", "sum(failures)")} AS shop_top_session_failure_share,
  count(*) FILTER (WHERE attempts >= 2 AND captures = 0 AND cards >= 2 AND NOT (failures > 0 AND gateway_failures * 2 > failures)) AS shop_card_testing_sessions,
  {div0("sum(captures) FILTER (WHERE failures > 0)", "coalesce(sum(attempts) FILTER (WHERE failures > 0), 0)")} AS shop_failing_session_approval_rate,
  (SELECT count(DISTINCT card_id) FROM pay_w p WHERE p.scope = sess.scope) AS shop_distinct_cards
FROM sess GROUP BY scope""")

# Rule flags: 1 fired, 0 quiet, -1 abstained.
fragment("rules", ("feat", "traf"), """
SELECT feat.*, traf.* EXCLUDE (scope),
  CASE WHEN attempt_rate > 1.5 THEN 1 ELSE 0 END AS r_velocity,
  CASE WHEN attempts = 0 THEN -1 WHEN approval_rate < 0.5 AND distinct_cards >= 8 AND distinct_cards::DOUBLE / attempts >= 0.7 THEN 1 ELSE 0 END AS r_card_spread,
  CASE WHEN attempts = 0 THEN -1 WHEN approval_rate < 0.5 AND distinct_cards < 8 AND distinct_cards_long_span >= 12 THEN 1 ELSE 0 END AS r_card_spread_slow,
  CASE WHEN attempts = 0 THEN -1 WHEN approval_rate < 0.5 AND max_orders_per_card >= 4 THEN 1 ELSE 0 END AS r_card_probing,
  CASE WHEN attempts < 6 THEN -1 WHEN approval_rate < 0.2 THEN 1 ELSE 0 END AS r_approval_collapse,
  CASE WHEN failures = 0 THEN -1 WHEN infra_failure_share < 0.5 AND reason_concentration > 0.45 THEN 1 ELSE 0 END AS r_reason_mix,
  CASE WHEN attempts = 0 THEN -1 WHEN small_amount_share > 0.6 THEN 1 ELSE 0 END AS r_small_amount_probing,
  CASE WHEN attempts < 6 THEN -1 WHEN burstiness < 0.35 THEN 1 ELSE 0 END AS r_machine_cadence,
  CASE WHEN recovered_orders > 0 THEN 1 ELSE 0 END AS r_recovery,
  CASE WHEN failures = 0 THEN -1 WHEN infra_failure_share >= 0.5 THEN 1 ELSE 0 END AS r_infrastructure_attribution,
  CASE WHEN attempts < 6 OR distinct_cards = 0 THEN -1 WHEN attempts::DOUBLE / distinct_cards >= 2 THEN 1 ELSE 0 END AS r_card_reuse
FROM feat JOIN traf USING (scope)""")

RULES = ("velocity", "card_spread", "card_spread_slow", "card_probing", "approval_collapse", "reason_mix",
         "small_amount_probing", "machine_cadence", "recovery", "infrastructure_attribution", "card_reuse")
_pos = [("velocity", (0.2,)), ("card_spread", (0.35, 0.15)), ("card_spread_slow", (0.3,)), ("card_probing", (0.3,)),
        ("approval_collapse", (0.25,)), ("reason_mix", (0.2,)), ("small_amount_probing", (0.15,)), ("machine_cadence", (0.1,))]
_neg = [("recovery", -0.4), ("infrastructure_attribution", -0.5), ("card_reuse", -0.25)]
_rise = [("card_spread", 0.5), ("card_spread_slow", 0.3), ("card_probing", 0.3), ("approval_collapse", 0.25),
         ("reason_mix", 0.2), ("small_amount_probing", 0.15), ("machine_cadence", 0.1)]


def _add(items) -> str:
    return "(0.0::DOUBLE" + "".join(f" + CASE WHEN {c} THEN ({w})::DOUBLE ELSE 0.0::DOUBLE END" for c, w in items) + ")"


_for = _add([(f"r_{n} = 1", w) for n, ws in _pos for w in ws])
_against = _add([(f"r_{n} = 1", w) for n, w in _neg])
_up = _add([(f"r_{n} = -1", w) for n, w in _rise])
_down = _add([(f"r_{n} = -1", w) for n, w in _neg])
_clamp = lambda e: f"greatest(0.0, least(1.0, {e}))"
FIRED_SQL = "concat_ws(','," + ",".join(f"CASE WHEN r_{n} = 1 THEN '{n}' END" for n in RULES) + ")"
INCRIMINATING_SQL = "concat_ws(','," + ",".join(f"CASE WHEN r_{n} = 1 THEN '{n}' END" for n in RULES[:8]) + ")"
ABSTAINED_SQL = "concat_ws(','," + ",".join(f"CASE WHEN r_{n} = -1 THEN '{n}' END" for n in RULES) + ")"

fragment("scored", ("rules",), f"""
SELECT *, {r3(_clamp("w_for + w_against"))} AS score, {r3("lo")} AS score_lower, {r3("hi")} AS score_upper,
  CASE WHEN hi - lo = 0 THEN 'high' WHEN hi - lo <= 0.25 THEN 'medium' ELSE 'low' END AS band,
  {r3("w_for")} AS incriminating, {r3("w_against")} AS mitigating
FROM (SELECT *, {_clamp("w_for + w_against + w_down")} AS lo, {_clamp("w_for + w_against + w_up")} AS hi
  FROM (SELECT *, {_for} AS w_for, {_against} AS w_against, {_up} AS w_up, {_down} AS w_down,
    {INCRIMINATING_SQL} AS fired FROM rules))""")

_met = lambda items: "(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w in items) + ")"
_fail = div0("shop_failures", "shop_attempts")
_H = {
    "attack": ([("attempts >= 6", 3), ("distinct_cards >= 8", 2), (f"attempts >= 6 AND {div0('distinct_cards', 'attempts')} >= 0.7", 2),
                ("attempts >= 6 AND approval_rate < 0.2", 1), ("shop_infra_failure_share < 0.5", 2),
                ("attempts >= 6 AND (shop_top_session_failure_share >= 0.5 OR shop_approval_rate < 0.5)", 2),
                ("small_amount_share > 0.6", 1),
                (f"{_fail} >= 0.5 AND shop_infra_failure_share < 0.5 AND shop_approval_rate < 0.3", 3)], 16),
    "outage": ([("shop_infra_failure_share >= 0.5", 3),
                ("shop_infra_failure_share >= 0.5 AND shop_failing_sessions >= 5 AND shop_top_session_failure_share < 0.5", 2),
                ("shop_infra_failure_share >= 0.5 AND infra_failure_share >= 0.5", 2),
                ("shop_infra_failure_share >= 0.5 AND distinct_cards < 8", 1)], 8),
    "retry_storm": ([("attempts >= 6", 3), (f"attempts >= 6 AND {div0('attempts', 'distinct_cards')} >= 2", 3),
                     ("attempts >= 6 AND distinct_cards > 0 AND distinct_cards < 8", 2), ("shop_infra_failure_share < 0.5", 1),
                     ("burstiness < 0.35", 1), ("approval_rate > 0.05", 1)], 11),
    "healthy_traffic": ([("shop_approval_rate >= 0.8", 3), ("shop_approval_rate >= 0.8 AND shop_active_sessions >= 20", 2),
                         (f"{_fail} < 0.2", 2), ("distinct_cards < 8", 1)], 8),
    "insufficient_evidence": ([("attempts < 6", 3), ("distinct_cards IS NULL", 3), ("shop_attempts < 10", 2)], 8),
}
_sup = ", ".join(f"{_met(items)} / {float(total)}::DOUBLE AS s_{n}" for n, (items, total) in _H.items())
_all = "(" + " + ".join(f"s_{n}" for n in _H) + ")"
_fits = ", ".join(
    f"{{'p': {r3(f'CASE WHEN {_all} = 0 THEN 0.2 ELSE s_{n} / {_all} END')}, 'o': {-i}, 'h': '{n}', 's': {r3('s_' + n)}}}"
    for i, n in enumerate(_H)
)
fragment("arb", ("scored",), f"""
SELECT *, fits[1].h AS best, fits[2].h AS runner_up, fits[1].s AS best_support, {r3("fits[1].p - fits[2].p")} AS margin,
  list_filter(fits, lambda f: f.h = 'attack')[1].p AS attack_probability,
  list_filter(fits, lambda f: f.h = 'attack')[1].s AS attack_support
FROM (SELECT *, list_reverse_sort([{_fits}]) AS fits FROM (SELECT *, {_sup} FROM scored))""")
fragment("dec", ("arb",), """
SELECT *, CASE WHEN best = 'insufficient_evidence' THEN 'monitor' WHEN margin < 0.08 THEN 'review'
    WHEN best = 'outage' THEN 'monitor' WHEN best IN ('retry_storm', 'healthy_traffic') THEN 'none'
    WHEN best_support < 0.7 THEN 'review' ELSE 'contain' END AS decision,
  best = 'insufficient_evidence' OR margin < 0.08 AS abstained,
  CASE WHEN best = 'insufficient_evidence' THEN 'not_enough_to_judge'
    WHEN margin < 0.08 THEN 'margin_too_narrow,runner_up_' || runner_up
    WHEN best IN ('outage', 'retry_storm', 'healthy_traffic') THEN 'suppressed_by_' || best
    WHEN best_support < 0.7 THEN 'attack_best_but_weakly_supported' ELSE 'attack_clearly_best_supported' END AS reasons
FROM arb""")

# Canonical events, lateness, resolved attempts and orders, incidents.
fragment("canon", ("obs",), """
SELECT scope, event_id, CASE outcome WHEN 'failed' THEN 'payment.failed' WHEN 'captured' THEN 'payment.captured' WHEN 'authorized' THEN 'payment.authorized'
    ELSE CASE WHEN event_id % 20 = 0 THEN 'refund.created' ELSE 'payment.pending' END END AS event_type,
  order_id, payment_id, amount_paise, CASE event_id % 3 WHEN 0 THEN 'upi' WHEN 1 THEN 'card' END AS method,
  CASE WHEN outcome = 'failed' THEN 'E' || (event_id % 5) END AS error_code, error_reason, error_source,
  CASE WHEN event_id % 2 = 0 THEN 'visa' ELSE 'rupay' END AS card_network,
  CASE WHEN event_id % 4 <> 0 THEN 'bank' || (event_id % 6) END AS card_issuer, card_id, at_ms, received_ms, source, session, device, network, outcome
FROM obs""")
fragment("late", ("canon",), """
SELECT *, coalesce(at_ms < max(at_ms) OVER (PARTITION BY scope ORDER BY received_ms RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 300000, FALSE) AS late,
  CASE event_type WHEN 'payment.failed' THEN 1 WHEN 'payment.authorized' THEN 2 WHEN 'payment.captured' THEN 3 WHEN 'refund.created' THEN 4 ELSE -1 END AS rank
FROM canon""")
_far = lambda c, extra="": f"first({c} ORDER BY rank DESC, at_ms DESC, event_type DESC, event_id DESC) FILTER (WHERE {c} IS NOT NULL{extra}) AS {c}"
fragment("att", ("late",), f"""
SELECT scope, payment_id, {", ".join(_far(c) for c in ("order_id", "amount_paise", "method", "card_network", "card_issuer", "card_id"))},
  {", ".join(_far(c, " AND rank = 1") for c in ("error_code", "error_reason", "error_source"))},
  bool_or(rank = 1) AS failed, min(at_ms) AS first_ms, max(at_ms) AS last_ms, count(*) AS event_count, bool_or(late) AS late,
  CASE greatest(max(rank), 0) WHEN 0 THEN 'created' WHEN 1 THEN 'failed' WHEN 2 THEN 'authorized' WHEN 3 THEN 'captured' ELSE 'refunded' END AS status,
  CASE WHEN bool_or(source = 'replay') THEN 'replay' ELSE 'live' END AS source
FROM late GROUP BY scope, payment_id""")
fragment("ord", ("att",), """
SELECT scope, order_id, CASE WHEN bool_or(status IN ('captured', 'refunded')) THEN 'paid' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'pending' END AS outcome,
  bool_or(status IN ('captured', 'refunded')) AND count(*) FILTER (WHERE failed) > 0 AS recovered,
  count(*) FILTER (WHERE failed) AS failure_count, count(*) AS attempt_count,
  first(amount_paise ORDER BY first_ms, payment_id) FILTER (WHERE amount_paise IS NOT NULL) AS amount_paise,
  min(first_ms) AS first_ms, max(last_ms) AS last_ms, CASE WHEN bool_or(source = 'replay') THEN 'replay' ELSE 'live' END AS source
FROM att GROUP BY scope, order_id""")
# Attempts with the pseudonyms of their order.
fragment("att_k", ("att", "obs"), """
SELECT att.*, k.session, k.device, k.network FROM att
JOIN (SELECT DISTINCT payment_id, session, device, network FROM obs) k USING (payment_id)""")
fragment("ord_k", ("ord", "obs"), """
SELECT ord.*, k.session, k.device, k.network FROM ord
JOIN (SELECT DISTINCT order_id, session, device, network FROM obs) k USING (order_id)""")

_cyc = lambda values, idx: f"[{', '.join(repr(v) for v in values)}][({idx}) % {len(values)} + 1]"
from cardwatch.sources import tables as _t  # noqa: E402

fragment("inc", ("obs",), f"""
SELECT scope, source, md5(source || ':' || entity_kind || ':' || entity_key || ':' || day) AS incident_id, entity_kind, entity_key,
  {_cyc(_t.STATUSES, 'seed')} AS status,
  CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity, score,
  {_cyc(_t.EXPLANATIONS, 'seed // 5')} AS best, {_cyc(_t.FIRED, 'seed // 25')} AS fired, {_cyc(_t.DECISIONS, 'seed // 3')} AS decision,
  seed % 101 / 100.0::DOUBLE AS support, seed % 101 / 100.0::DOUBLE AS probability,
  first_ms, first_ms + (seed % 50) * 60000 AS detected_ms, last_ms, last_ms + 1800000 AS expires_ms,
  failures * 2 AS attempts, failures, CASE WHEN seed % 7 <> 0 THEN cards END AS distinct_cards, 'u' || (seed % 9) AS assignee_id, seed
FROM (SELECT *, floor(failures * 1000 / (failures + 1.0::DOUBLE)) / 1000.0::DOUBLE AS score FROM (
  SELECT scope, source, entity_kind, entity_key, at_ms // 86400000 AS day, count(*) AS failures, count(DISTINCT card_id) AS cards,
    min(event_id) AS seed, min(at_ms) AS first_ms, max(at_ms) AS last_ms
  FROM (SELECT *, 'session' AS entity_kind, session AS entity_key FROM obs UNION ALL SELECT *, 'device', device FROM obs UNION ALL SELECT *, 'network', network FROM obs)
  WHERE outcome = 'failed' GROUP BY ALL))""")

fragment("lines", (), """
SELECT 'shop' AS scope, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 100 + 0.5)::BIGINT, l_returnflag) AS event_id,
  'o' || l_orderkey AS order_id, 'p' || l_orderkey || '-' || l_linenumber AS payment_id,
  CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'authorized' ELSE 'captured' END AS outcome,
  floor(l_extendedprice * 100 + 0.5)::BIGINT AS amount_paise, 'c' || (l_partkey % 97) AS card_id,
  (epoch_us(l_shipdate) // 1000) + l_linenumber * 3600000 AS at_ms, CASE WHEN l_orderkey % 10 = 0 THEN 'replay' ELSE 'live' END AS source
FROM lineitem""")
fragment("checkouts", (), """
SELECT 'shop' AS scope, 'o' || o_orderkey AS order_id, 's' || o_custkey AS session, 'd' || (o_custkey % 211) AS device, 'n' || c_nationkey AS network,
  floor(o_totalprice * 100 + 0.5)::BIGINT AS amount_paise, CASE WHEN o_orderkey % 10 = 0 THEN 'replay' ELSE 'live' END AS source,
  epoch_us(o_orderdate) // 1000 AS created_ms
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
