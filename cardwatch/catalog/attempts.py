"""Queries: attempts, orders, joins and per-attempt signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import fragment, query, with_
from cardwatch.functions import views as V
from cardwatch.operators import links as L, velocity as Vel
from cardwatch.operators.attempts import flag_late, per_payment, resolve_attempts, resolve_orders
from cardwatch.operators.traffic import failing_issuers
from cardwatch.plans import attempts_view as A
from cardwatch.session import stage
from cardwatch.sources import tables as T

_ATT = ("payment_id", "order_id", "status", "amount_paise", "method", "card_network", "card_issuer", "card_id",
        "error_code", "error_reason", "error_source", "failed", "first_ms", "last_ms", "event_count", "late", "source")


@query("resolve_attempt", with_("att", tail=f"SELECT {', '.join(_ATT)} FROM att"))
def _(spark, sf_dir):
    return resolve_attempts(flag_late(T.canonical_events(spark, sf_dir))).select(*_ATT)


_ORD = ("order_id", "outcome", "recovered", "failure_count", "attempt_count", "amount_paise", "first_ms", "last_ms", "source")


@query("resolve_order", with_("ord", tail=f"SELECT {', '.join(_ORD)} FROM ord"))
def _(spark, sf_dir):
    return A.resolved(T.canonical_events(spark, sf_dir))[1].select(*_ORD)


@query("late_flag", with_("late", tail="SELECT event_id, at_ms, received_ms, late FROM late"))
def _(spark, sf_dir):
    return flag_late(T.canonical_events(spark, sf_dir)).select("event_id", "at_ms", "received_ms", "late")


@query("failing_issuers", with_("canon", tail="SELECT scope, count(DISTINCT card_issuer) AS distinct_failing_issuers FROM canon WHERE outcome = 'failed' GROUP BY scope"))
def _(spark, sf_dir):
    events = T.canonical_events(spark, sf_dir).withColumn("outcome", F.when(F.col("event_type") == "payment.failed", "failed"))
    return failing_issuers(events)


@query("join_observations", with_("lines", "checkouts", tail="SELECT event_id, order_id, payment_id, outcome, l.amount_paise, at_ms, session, device, network FROM lines l LEFT JOIN (SELECT order_id, session, device, network FROM checkouts) USING (order_id)"))
def _(spark, sf_dir):
    joined = L.join_observations(T.lineitem_events(spark, sf_dir), T.checkout_sessions(spark, sf_dir))
    return joined.select("event_id", "order_id", "payment_id", "outcome", "amount_paise", "at_ms", "session", "device", "network")


@query("join_sensor", with_("ord", "checkouts", "lines", tail="""
SELECT order_id, n_events, session, device, network, created_ms FROM (SELECT order_id, count(*) AS n_events FROM lines GROUP BY order_id)
LEFT JOIN checkouts USING (order_id)"""))
def _(spark, sf_dir):
    orders = T.lineitem_events(spark, sf_dir).groupBy("order_id").agg(F.count(F.lit(1)).alias("n_events"))
    return orders.join(T.checkout_sessions(spark, sf_dir), "order_id", "left").select(
        "order_id", "n_events", "session", "device", "network", "created_ms"
    )


_FROM, _TO = 820_454_400_000, 1_009_843_200_000  # 1996-01-01 .. 2002-01-01


@query("join_entity_orders", with_("lines", "checkouts", tail=f"""
SELECT DISTINCT order_id FROM checkouts WHERE network = 'n3' AND order_id IN (
  SELECT order_id FROM lines WHERE source = 'live' AND at_ms BETWEEN {_FROM} AND {_TO})"""))
def _(spark, sf_dir):
    return L.entity_orders(
        T.lineitem_events(spark, sf_dir), T.checkout_sessions(spark, sf_dir), "network", "n3", "live", _FROM, _TO
    )


_NOW = 1_009_843_200_000


@query("unresolved_checkouts", with_("lines", "checkouts", tail=f"""
SELECT order_id, created_ms, ({_NOW} - created_ms) // 60000 AS age_minutes FROM checkouts
WHERE created_ms < {_NOW} - 300000 AND order_id NOT IN (SELECT order_id FROM lines)"""))
def _(spark, sf_dir):
    return L.unresolved_checkouts(
        T.checkout_sessions(spark, sf_dir), T.lineitem_events(spark, sf_dir), now_ms=_NOW
    ).select("order_id", "created_ms", "age_minutes")


def _placed(spark, sf_dir):
    """Order -> pseudonyms for the event stream (constant within an order)."""
    return T.observations(spark, sf_dir).select("order_id", "payment_id", "session", "device", "network")


def _event_orders(spark, sf_dir):
    attempts, orders = A.resolved(T.canonical_events(spark, sf_dir))
    placed = _placed(spark, sf_dir).select("order_id", "session", "device", "network").distinct()
    return attempts, orders, placed


fragment("linked", ("ord_k", "inc"), """
SELECT o.order_id, o.source, o.recovered, h.incident_id, h.entity_kind AS incident_kind, h.severity AS incident_severity FROM ord_k o LEFT JOIN (
  SELECT order_id, incident_id, entity_kind, severity, row_number() OVER (PARTITION BY order_id ORDER BY
      CASE entity_kind WHEN 'session' THEN 0 WHEN 'device' THEN 1 ELSE 2 END, detected_ms, incident_id) AS n
  FROM (SELECT o.order_id, i.* FROM ord_k o JOIN inc i ON o.source = i.source AND o.last_ms >= i.first_ms AND o.first_ms <= i.last_ms
    AND ((i.entity_kind = 'session' AND i.entity_key = o.session) OR (i.entity_kind = 'device' AND i.entity_key = o.device) OR (i.entity_kind = 'network' AND i.entity_key = o.network)))
) h ON h.order_id = o.order_id AND h.n = 1""")


@query("link_incident", with_("linked", tail="SELECT order_id, source, incident_id, incident_kind, incident_severity FROM linked"))
def _(spark, sf_dir):
    _, orders, placed = _event_orders(spark, sf_dir)
    keyed = orders.join(placed, "order_id", "left")
    return L.link_incidents(keyed, T.incidents(spark, sf_dir), id_column="order_id").select(
        "order_id", "source", "incident_id", "incident_kind", "incident_severity"
    )


fragment("rows_", ("att", "linked"), """
SELECT payment_id, order_id, amount_paise, method, card_network,
  CASE WHEN status = 'captured' THEN CASE WHEN recovered THEN 'recovered' ELSE 'captured' END WHEN status IN ('failed', 'authorized', 'refunded') THEN status ELSE 'pending' END AS status,
  linked.source, incident_id, 'INC-' || upper(substr(incident_id, 1, 4)) AS incident_ref, incident_severity, first_ms AS at_ms
FROM att JOIN linked USING (order_id)""")


def _rows(spark, sf_dir):
    attempts, orders, placed = _event_orders(spark, sf_dir)
    staged = stage(attempts, "resolved")
    return A.attempt_rows(staged, resolve_orders(staged), placed, T.incidents(spark, sf_dir))


_ROW = ("payment_id", "order_id", "amount_paise", "method", "card_network", "status", "source", "incident_id", "incident_ref", "incident_severity", "at_ms")


@query("attempt_rows", with_("rows_", tail=f"SELECT {', '.join(_ROW)} FROM rows_"))
def _(spark, sf_dir):
    return _rows(spark, sf_dir).select(*_ROW)


@query("display_status", with_("rows_", tail="SELECT status, count(*) AS attempts_n FROM rows_ GROUP BY status"))
def _(spark, sf_dir):
    return _rows(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("attempts_n"))


@query("attempt_filter", with_("rows_", tail="SELECT payment_id, status, incident_severity, at_ms FROM rows_ WHERE status = 'failed' AND method = 'card' AND incident_severity = 'medium' AND contains(lower(concat_ws(chr(10), payment_id, order_id, incident_ref)), 'p1')"))
def _(spark, sf_dir):
    keep = A.attempt_filter(status="failed", method="card", severity="medium", text="P1")
    return _rows(spark, sf_dir).filter(keep).select("payment_id", "status", "incident_severity", "at_ms")


@query("attempt_kpis", with_("rows_", tail="""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'captured') AS captured, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'recovered') AS recovered, count(incident_id) AS in_incident FROM rows_"""))
def _(spark, sf_dir):
    return A.attempt_kpis(_rows(spark, sf_dir))


@query("attempt_page", with_("rows_", tail="SELECT payment_id, status, at_ms FROM rows_ ORDER BY at_ms DESC, payment_id LIMIT 25 OFFSET 50"))
def _(spark, sf_dir):
    return A.attempt_page(_rows(spark, sf_dir), page=3, page_size=25).select("payment_id", "status", "at_ms")


@query("recent_orders", with_("canon", tail="SELECT order_id, max(at_ms) AS latest_ms FROM canon GROUP BY order_id ORDER BY latest_ms DESC, order_id LIMIT 100"))
def _(spark, sf_dir):
    return A.recent_orders(T.canonical_events(spark, sf_dir), limit=100)


fragment("typ", ("canon",), """
SELECT source, count(*) AS captures, CASE WHEN count(*) >= 10 THEN floor(median(amount_paise) + 0.5)::BIGINT END AS typical_paise FROM canon
WHERE outcome = 'captured' GROUP BY source""")


def _typical(spark, sf_dir):
    captured = T.canonical_events(spark, sf_dir).filter(F.col("event_type") == "payment.captured")
    return A.typical_amount(captured.select("source", "amount_paise", "at_ms", "event_id"))


@query("typical_amount", with_("typ", tail="SELECT * FROM typ"))
def _(spark, sf_dir):
    return _typical(spark, sf_dir)


@query("classify_amount", with_("att", "typ", tail="""
SELECT payment_id, amount_paise, CASE WHEN typical_paise IS NULL OR amount_paise IS NULL THEN 'unknown' WHEN amount_paise < typical_paise * 0.5 THEN 'below'
  WHEN amount_paise > typical_paise * 1.5 THEN 'above' ELSE 'typical' END AS amount_vs_typical FROM att LEFT JOIN typ USING (source)"""))
def _(spark, sf_dir):
    attempts = resolve_attempts(flag_late(T.canonical_events(spark, sf_dir)))
    # One row per source: written, so the join knows how small it is.
    typical = stage(_typical(spark, sf_dir), "typical")
    return attempts.join(typical, "source", "left").select(
        "payment_id", "amount_paise", V.classify_amount(F.col("typical_paise"), F.col("amount_paise")).alias("amount_vs_typical")
    )


_DAY = 86_400_000


@query("device_velocity", with_("pay", tail="""
SELECT payment_id, at_ms, count(*) OVER w AS attempts_in_window, (count(*) FILTER (WHERE outcome = 'failed') OVER w) AS failures_in_window
FROM pay WINDOW w AS (PARTITION BY source, device ORDER BY at_ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)"""))
def _(spark, sf_dir):
    attempts = stage(per_payment(T.observations(spark, sf_dir)), "attempts")
    return Vel.device_velocity(attempts, span_ms=_DAY).select("payment_id", "at_ms", "attempts_in_window", "failures_in_window")


@query("device_seen_before", with_("pay", tail="SELECT payment_id, min(at_ms) OVER (PARTITION BY source, device) < at_ms - 86400000 AS device_seen_before FROM pay"))
def _(spark, sf_dir):
    attempts = stage(per_payment(T.observations(spark, sf_dir)), "attempts")
    return Vel.device_seen_before(attempts, span_ms=_DAY).select("payment_id", "device_seen_before")


@query("network_sharing", with_("pay", tail="""
SELECT payment_id, at_ms, (SELECT count(DISTINCT b.device) FROM pay b WHERE b.source = a.source AND b.network = a.network AND b.at_ms BETWEEN a.at_ms - 86400000 AND a.at_ms) AS network_devices FROM pay a"""))
def _(spark, sf_dir):
    attempts = stage(per_payment(T.observations(spark, sf_dir)), "attempts")
    return Vel.network_sharing(attempts, span_ms=_DAY).select("payment_id", "at_ms", "network_devices")


@query("card_reuse_window", with_("pay", "obs", tail="""
SELECT payment_id, at_ms, (SELECT count(DISTINCT b.payment_id) FROM obs b WHERE b.source = a.source AND b.card_id = a.card_id AND b.at_ms BETWEEN a.at_ms - 86400000 AND a.at_ms) AS card_payments FROM pay a"""))
def _(spark, sf_dir):
    events = T.observations(spark, sf_dir)
    return Vel.card_reuse(events, stage(per_payment(events), "attempts"), span_ms=_DAY).select("payment_id", "at_ms", "card_payments")


@query("recent_from_device", with_("att_k", tail="""SELECT device, source, payment_id, status, first_ms, position FROM (
  SELECT *, row_number() OVER (PARTITION BY source, device ORDER BY first_ms DESC, payment_id) AS position FROM att_k) WHERE position <= 6"""))
def _(spark, sf_dir):
    attempts = resolve_attempts(flag_late(T.canonical_events(spark, sf_dir)))
    placed = _placed(spark, sf_dir).select("payment_id", "session", "device", "network").distinct()
    return Vel.recent_from_device(attempts.join(placed, "payment_id")).select(
        "device", "source", "payment_id", "status", "first_ms", "position"
    )


fragment("touched", ("inc", "obs"), """
SELECT i.incident_id, i.entity_kind, o.session, o.device, o.card_id, o.payment_id, o.outcome FROM inc i JOIN obs o ON o.source = i.source AND o.at_ms BETWEEN i.first_ms AND i.last_ms
  AND ((i.entity_kind = 'session' AND i.entity_key = o.session) OR (i.entity_kind = 'device' AND i.entity_key = o.device) OR (i.entity_kind = 'network' AND i.entity_key = o.network))""")


@query("entity_distincts", with_("touched", tail="SELECT incident_id, count(DISTINCT device) AS devices, count(DISTINCT session) AS sessions FROM touched GROUP BY incident_id"))
def _(spark, sf_dir):
    return L.entity_distincts(T.incidents(spark, sf_dir), T.observations(spark, sf_dir))


@query("entity_graph", with_("touched", tail="""
SELECT incident_id, 'card' AS edge, card_id AS node, count(DISTINCT payment_id) AS n, bool_or(outcome = 'captured') AS captured FROM touched GROUP BY incident_id, card_id
UNION ALL SELECT incident_id, 'session', session, count(DISTINCT card_id), NULL FROM touched WHERE entity_kind = 'network' GROUP BY incident_id, session"""))
def _(spark, sf_dir):
    return L.entity_graph(T.incidents(spark, sf_dir), T.observations(spark, sf_dir))


@query("mix_label", with_("lines", "checkouts", tail="""
SELECT order_id, c.session IN (SELECT session FROM checkouts JOIN lines USING (order_id) WHERE outcome = 'failed' AND lines.amount_paise > 9000000) AS is_abuse, count(*) AS events_n
FROM lines l JOIN checkouts c USING (order_id) GROUP BY ALL"""))
def _(spark, sf_dir):
    parts = L.join_observations(T.lineitem_events(spark, sf_dir), T.checkout_sessions(spark, sf_dir)).filter(F.col("session").isNotNull())
    # joined once and written: the check of identifiers, the attackers and the labels read it; a session is a part of its own
    parts = stage(parts.select("order_id", "payment_id", "session", "outcome", "amount_paise", F.col("session").alias("part")), "parts")
    attackers = parts.filter((F.col("outcome") == "failed") & (F.col("amount_paise") > 9_000_000)).select("session")
    return L.compose_labelled(parts, attackers).groupBy("order_id", "is_abuse").agg(F.count(F.lit(1)).alias("events_n"))
