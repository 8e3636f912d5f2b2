"""Queries: console reports and evaluation over labelled traffic."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import WINDOW, csv, event_pass, fragment, q6, query, r6, with_
from cardwatch.catalog.attempts import _event_orders
from cardwatch.catalog.incidents import _moves, titled
from cardwatch.config import DAY_MS, HOUR_MS
from cardwatch.functions.views import card_token
from cardwatch.operators import evaluation as Ev, reports as R
from cardwatch.operators.attempts import flag_late, resolve_attempts, resolve_orders
from cardwatch.operators.features import ENTITY
from cardwatch.operators.hypotheses import counterfactual
from cardwatch.operators.links import link_incidents
from cardwatch.plans.detect import detection_pass
from cardwatch.session import stage
from cardwatch.sources import tables as T

KEY = "scope, entity_kind, entity_key"
WEEK, MONTH = 7 * DAY_MS, 30 * DAY_MS


def _attempts(spark, sf_dir):
    return resolve_attempts(flag_late(T.canonical_events(spark, sf_dir)))


@query("incident_status_counts", with_("inc", tail="SELECT scope, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in R.STATUSES) + " FROM inc GROUP BY scope"))
def _(spark, sf_dir):
    return R.status_counts(T.incidents(spark, sf_dir))


_TILES = ("critical", "high", "medium", "low", "resolved")
fragment("tiled", ("inc",), "SELECT *, CASE WHEN status = 'resolved' THEN 'resolved' WHEN status <> 'expired' THEN CASE WHEN severity = 'high' AND score >= 0.9 THEN 'critical' ELSE severity END END AS tile FROM inc")


@query("severity_tiles", with_("tiled", tail="SELECT scope, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE tile = '{t}') AS {t}, {r6(f'(count(*) FILTER (WHERE tile = {chr(39)}{t}{chr(39)}))::DOUBLE / count(*)')} AS {t}_share" for t in _TILES) + " FROM tiled GROUP BY scope"))
def _(spark, sf_dir):
    tiles = R.severity_tiles(T.incidents(spark, sf_dir))
    return tiles.select("scope", "total", *_TILES, *[q6(f"{t}_share").alias(f"{t}_share") for t in _TILES])


@query("overview_kpis", with_("att", "inc", "clock", tail=f"""
SELECT v.*, s.* EXCLUDE (scope), {r6('(attempts - prior_attempts)::DOUBLE / nullif(prior_attempts, 0)')} AS attempts_delta, greatest(attempts - failed, 0) AS safe FROM (
  SELECT scope, count(*) FILTER (WHERE first_ms >= as_of - {WEEK}) AS attempts, count(*) FILTER (WHERE first_ms < as_of - {WEEK}) AS prior_attempts,
    count(*) FILTER (WHERE first_ms >= as_of - {WEEK} AND status = 'captured') AS captured, count(*) FILTER (WHERE first_ms >= as_of - {WEEK} AND status = 'failed') AS failed
  FROM att, clock WHERE first_ms >= as_of - {2 * WEEK} GROUP BY scope) v
JOIN (SELECT scope, count(*) FILTER (WHERE status IN ('open', 'under_review')) AS active_incidents, count(*) FILTER (WHERE status = 'under_review') AS under_review,
    count(*) FILTER (WHERE status = 'contained') AS contained, count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) AS total_incidents,
    max(score) FILTER (WHERE status IN ('open', 'under_review')) AS risk,
    ['low', 'medium', 'high'][max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) FILTER (WHERE status IN ('open', 'under_review'))] AS risk_level
  FROM inc GROUP BY scope) s USING (scope)"""))
def _(spark, sf_dir):
    k = R.overview_kpis(_attempts(spark, sf_dir), T.incidents(spark, sf_dir), now_ms=T.newest_ms(spark, sf_dir), window_ms=WEEK)
    return k.withColumn("attempts_delta", q6("attempts_delta"))


@query("top_reasons", with_("inc_v", tail="SELECT title, count(*) AS incidents FROM inc_v GROUP BY title ORDER BY incidents DESC, title LIMIT 5"))
def _(spark, sf_dir):
    return R.top_reasons(titled(spark, sf_dir))


def _trend_fragment(name: str, window: int, bucket: int) -> None:
    fragment(name, ("att", "inc", "clock"), f"""
SELECT 'shop' AS scope, b AS bucket_ms, (SELECT count(*) FROM att, clock WHERE first_ms >= as_of - {window} AND first_ms // {bucket} * {bucket} = b) AS events,
  (SELECT count(*) FROM att, clock WHERE first_ms >= as_of - {window} AND status = 'failed' AND first_ms // {bucket} * {bucket} = b) AS failures,
  (SELECT count(*) FROM inc, clock WHERE detected_ms >= as_of - {window} AND detected_ms // {bucket} * {bucket} = b) AS incidents,
  coalesce((SELECT max(score) FROM inc, clock WHERE detected_ms >= as_of - {window} AND detected_ms // {bucket} * {bucket} = b), 0.0) AS risk
FROM (SELECT unnest(range((as_of - {window}) // {bucket} * {bucket}, as_of // {bucket} * {bucket} + 1, {bucket})) AS b FROM clock)""")


_trend_fragment("trend", MONTH, DAY_MS)
_trend_fragment("trend_day", DAY_MS, HOUR_MS)


def _trend(spark, sf_dir, window=MONTH):
    return R.risk_trend(_attempts(spark, sf_dir), T.incidents(spark, sf_dir), now_ms=T.newest_ms(spark, sf_dir), window_ms=window)


@query("risk_trend", with_("trend", tail="SELECT * FROM trend"))
def _(spark, sf_dir):
    return _trend(spark, sf_dir)


@query("risk_trend_hourly", with_("trend_day", tail="SELECT * FROM trend_day"))
def _(spark, sf_dir):
    return _trend(spark, sf_dir, DAY_MS)


fragment("blocks", ("trend",), f"""
SELECT scope, (i // size)::INT AS block, min(bucket_ms) AS from_ms, max(bucket_ms) + {DAY_MS} AS to_ms, sum(events)::BIGINT AS attempts, sum(failures)::BIGINT AS failed, sum(incidents)::BIGINT AS incidents, max(risk) AS risk
FROM (SELECT *, row_number() OVER (ORDER BY bucket_ms) - 1 AS i, (count(*) OVER () + 7) // 8 AS size FROM trend) GROUP BY ALL""")


@query("trend_blocks", with_("blocks", tail="SELECT * FROM blocks"))
def _(spark, sf_dir):
    return R.trend_blocks(_trend(spark, sf_dir))


@query("trend_incidents", with_("blocks", "inc", tail="SELECT b.scope, block, incident_id, detected_ms FROM inc JOIN blocks b ON detected_ms >= from_ms AND detected_ms < to_ms"))
def _(spark, sf_dir):
    return R.trend_incidents(R.trend_blocks(_trend(spark, sf_dir)), T.incidents(spark, sf_dir), bucket_ms=DAY_MS)


@query("burst_shape", with_("trend", tail="""
, marked AS (SELECT *, events > 0 AND events >= max(events) OVER () / 2.0 AS busy, row_number() OVER (ORDER BY bucket_ms) AS i FROM trend),
runs AS (SELECT count(*) AS length, min(bucket_ms) AS a, max(bucket_ms) AS b, sum(events) AS e FROM (SELECT *, i - row_number() OVER (ORDER BY i) AS g FROM marked WHERE busy) GROUP BY g),
best AS (SELECT * FROM runs ORDER BY length DESC, a LIMIT 1), tot AS (SELECT count(*) AS periods, count(*) FILTER (WHERE events > 0) AS active, sum(events) AS e, count(*) FILTER (WHERE busy) AS spikes FROM marked)
SELECT 'shop' AS scope, CASE WHEN active = 0 THEN 'empty' WHEN length <= 3 AND best.e / tot.e >= 0.6 THEN 'one_burst' WHEN spikes > length AND spikes <= 6 THEN 'busy_periods' ELSE 'spread' END AS shape,
  a AS run_from_ms, b AS run_to_ms, length AS run_length, spikes, active, periods FROM tot LEFT JOIN best ON TRUE""".lstrip()))
def _(spark, sf_dir):
    return R.burst_shape(_trend(spark, sf_dir))


@query("prior_period", with_("att", tail=f"""
SELECT *, {r6('(attempts - prior_attempts)::DOUBLE / prior_attempts')} AS delta FROM (
  SELECT a.*, b.attempts AS prior_attempts FROM (SELECT scope, first_ms // {DAY_MS} AS period, count(*) AS attempts, count(*) FILTER (WHERE status = 'failed') AS failed FROM att GROUP BY ALL) a
  LEFT JOIN (SELECT scope, first_ms // {DAY_MS} AS period, count(*) AS attempts FROM att GROUP BY ALL) b ON b.scope = a.scope AND b.period = a.period - 1)"""))
def _(spark, sf_dir):
    return R.prior_period(_attempts(spark, sf_dir)).withColumn("delta", q6("delta"))


@query("recent_incidents", with_("inc", tail="SELECT incident_id, detected_ms FROM inc ORDER BY detected_ms DESC, incident_id LIMIT 5"))
def _(spark, sf_dir):
    return R.sort_incidents(T.incidents(spark, sf_dir)).select("incident_id", "detected_ms").limit(5)


@query("recent_activity", with_("canon", tail="SELECT event_id, event_type, at_ms FROM canon ORDER BY at_ms DESC, event_id DESC LIMIT 8"))
def _(spark, sf_dir):
    return T.canonical_events(spark, sf_dir).orderBy(F.desc("at_ms"), F.desc("event_id")).limit(8).select("event_id", "event_type", "at_ms")


@query("oldest_waiting", with_("inc", tail="SELECT scope, detected_ms, incident_id, severity FROM inc WHERE status IN ('open', 'under_review') ORDER BY detected_ms, incident_id LIMIT 1"))
def _(spark, sf_dir):
    return R.oldest_waiting(T.incidents(spark, sf_dir))


@query("incident_filter", with_("inc_v", tail="SELECT incident_id, title, severity FROM inc_v WHERE status IN ('open', 'contained') AND CASE WHEN severity = 'high' AND score >= 0.9 THEN 'critical' ELSE severity END = 'medium' AND contains(lower(concat_ws(chr(10), title, incident_id, entity_key)), 'card')"))
def _(spark, sf_dir):
    keep = R.incident_filter(tab="active", bucket="medium", search=" Card ")
    return titled(spark, sf_dir).filter(keep).select("incident_id", "title", "severity")


@query("notify_filter", with_("inc", tail="""
SELECT user_id, (SELECT count(*) FROM inc i WHERE (i.source = 'live' OR simulated) AND CASE i.severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END >= min_rank) AS notifiable,
  (SELECT count(*) FROM inc i WHERE (i.source = 'live' OR simulated) AND CASE i.severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END >= min_rank AND i.detected_ms > seen_ms) AS unread
FROM (SELECT 'u' || n_nationkey AS user_id, n_nationkey % 3 AS min_rank, n_nationkey % 2 = 0 AS simulated, 1704067200000 + n_nationkey * 86400000 AS seen_ms FROM nation)"""))
def _(spark, sf_dir):
    k = F.col("n_nationkey")
    prefs = T.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("u"), k).alias("user_id"), T._cycle(("low", "medium", "high"), k).alias("min_severity"),
        (k % 2 == 0).alias("simulated"), (F.lit(1_704_067_200_000) + k.cast("bigint") * DAY_MS).alias("seen_ms"),
    )
    return R.notifications(T.incidents(spark, sf_dir), prefs)


@query("incident_timeline", with_("inc", "moves", tail="""
SELECT incident_id, first_ms AS at_ms, 'first_attempt' AS entry FROM inc UNION ALL SELECT incident_id, detected_ms, 'detected' FROM inc UNION ALL SELECT incident_id, at_ms, to_status FROM moves"""))
def _(spark, sf_dir):
    return R.incident_timeline(T.incidents(spark, sf_dir), _moves(spark, sf_dir).withColumnRenamed("to_status", "kind"))


@query("captured_value", with_("linked", "att", tail="""
SELECT incident_id, count(*) AS orders, coalesce(sum(paid), 0)::BIGINT AS captured_paise FROM (SELECT DISTINCT incident_id, order_id FROM linked WHERE incident_id IS NOT NULL)
LEFT JOIN (SELECT order_id, sum(amount_paise) AS paid FROM att WHERE status = 'captured' GROUP BY order_id) USING (order_id) GROUP BY incident_id"""))
def _(spark, sf_dir):
    attempts, orders, placed = _event_orders(spark, sf_dir)
    staged = stage(attempts, "resolved")
    links = link_incidents(resolve_orders(staged).join(placed, "order_id", "left"), T.incidents(spark, sf_dir), id_column="order_id")
    return R.captured_value(links, staged)


@query("raw_event_view", with_("late", tail="SELECT event_id, event_type, source, order_id, payment_id, amount_paise, method, error_code, error_reason, error_source, card_network, card_issuer, right(card_id, 8) AS card_fingerprint, at_ms, late FROM late"))
def _(spark, sf_dir):
    e = flag_late(T.canonical_events(spark, sf_dir))
    return e.select(
        "event_id", "event_type", "source", "order_id", "payment_id", "amount_paise", "method", "error_code", "error_reason", "error_source",
        "card_network", "card_issuer", card_token(F.col("card_id")).alias("card_fingerprint"), "at_ms", "late",
    )


_shown = {"whole": "floor(({o}) + 0.5)::BIGINT::VARCHAR", "percent": "floor(({o}) * 100 + 0.5)::BIGINT::VARCHAR", "one": "(floor(({o}) * 10 + 0.5)::BIGINT // 10) || '.' || (floor(({o}) * 10 + 0.5)::BIGINT % 10)"}


def _phrase_sql() -> str:
    from cardwatch.catalog.control import _codes

    parts = []
    for rule, code, _, observed in _codes:
        before, after = R.PHRASES[code][0].replace("%%", "%").split("%s")
        shown = _shown[R.PHRASES[code][1]].format(o=observed)
        parts.append(f"SELECT {KEY}, '{code}' AS code, '{before}' || {shown} || '{after}' AS text FROM rules WHERE r_{rule} = 1")
    return " UNION ALL ".join(parts)


@query("evidence_text", with_("rules", tail=_phrase_sql()))
def _(spark, sf_dir):
    return R.evidence_text(event_pass(spark, sf_dir).decided, ENTITY).select(*ENTITY, "code", "text")


# --- ingestion and latency ---------------------------------------------------------------------

fragment("inbox", ("late",), """
SELECT *, CASE WHEN event_id % 25 = 0 THEN 'pending' WHEN event_id % 97 = 0 THEN 'dead' ELSE 'processed' END AS status, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS delivery_count,
  CASE WHEN event_id % 25 <> 0 AND event_id % 97 <> 0 THEN received_ms + (event_id % 50) * 10 - 20 END AS processed_ms,
  CASE WHEN source = 'replay' THEN CASE WHEN event_id % 4 <> 0 THEN 'f' || (event_id % 3) END END AS family FROM late""")


@query("ingestion_metrics", with_("inbox", "clock", tail=f"""
SELECT scope, count(*) FILTER (WHERE source = 'live') AS events_stored, count(*) FILTER (WHERE source = 'replay') AS replayed_events, sum(delivery_count - 1)::BIGINT AS duplicate_deliveries,
  count(*) FILTER (WHERE status = 'pending') AS pending_depth, count(*) FILTER (WHERE status = 'dead') AS dead_depth, count(*) FILTER (WHERE late) AS late_events,
  max(received_ms) AS last_received_ms, min(received_ms) FILTER (WHERE status = 'pending') AS oldest_pending_ms, {r6('avg(greatest(processed_ms - received_ms, 0))')} AS mean_processing_ms, max(at_ms) AS newest_event_ms,
  {r6("sum(delivery_count - 1)::DOUBLE / (count(*) FILTER (WHERE source = 'live') + sum(delivery_count - 1))")} AS duplicate_rate,
  {r6('count(*) FILTER (WHERE received_ms >= any_value_as_of - 300000) / 5.0')} AS events_per_minute, max(any_value_as_of) - min(received_ms) FILTER (WHERE status = 'pending') AS oldest_pending_age_ms
FROM (SELECT inbox.*, as_of AS any_value_as_of FROM inbox, clock) GROUP BY scope"""))
def _(spark, sf_dir):
    m = R.ingestion_metrics(flag_late(T.inbox(spark, sf_dir)), now_ms=T.newest_ms(spark, sf_dir))
    for c in ("mean_processing_ms", "duplicate_rate", "events_per_minute"):
        m = m.withColumn(c, q6(c))
    return m


@query("queue_depth", with_("inbox", tail="SELECT scope, count(*) FILTER (WHERE status = 'pending') AS pending_depth, count(*) FILTER (WHERE status = 'dead') AS dead_depth FROM inbox GROUP BY scope"))
def _(spark, sf_dir):
    m = R.ingestion_metrics(T.inbox(spark, sf_dir).withColumn("late", F.lit(False)), now_ms=0)
    return m.select("scope", "pending_depth", "dead_depth")


@query("latency_percentiles", """
WITH s AS (SELECT event_type, floor(value * 100 + 0.5)::BIGINT AS v FROM events)
SELECT event_type, """ + ", ".join(f"(list_sort(list(v)))[greatest(ceil(count(*) * {p}::DOUBLE), 1)::INT] AS {n}" for n, p in R.PERCENTILES.items()) + " FROM s GROUP BY event_type")
def _(spark, sf_dir):
    samples = T.table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("v"))
    return R.latency_percentiles(samples, ["event_type"], "v")


# --- labelled traffic ------------------------------------------------------------------------------

_FAMILIES = 6
_CLASS_SQL = "CASE scope WHEN 'f0' THEN 'attack' WHEN 'f1' THEN 'attack' WHEN 'f2' THEN 'operational' ELSE 'benign' END"


def _labelled(spark, sf_dir):
    """Event stream split into labelled families (one scope each), by shopper."""
    obs = T.observations(spark, sf_dir)
    user = F.substring("session", 2, 20).cast("bigint")
    return obs.withColumn("scope", F.concat(F.lit("f"), user % _FAMILIES))


def _classes(decided):
    kind = F.when(F.col("scope").isin("f0", "f1"), "attack").when(F.col("scope") == "f2", "operational").otherwise("benign")
    return decided.select("scope").distinct().withColumn("classification", kind)


def _family_pass(spark, sf_dir):
    return detection_pass(_labelled(spark, sf_dir), as_of_ms=T.newest_ms(spark, sf_dir), window=WINDOW)


_by_family = lambda sql: sql.replace("'shop' AS scope, event_id", f"'f' || (user_id % {_FAMILIES}) AS scope, event_id")
fragment("fam", ("dec",), f"""
SELECT *, classification <> 'attack' AND contain > 0 AS false_positive, classification = 'attack' AND contain = 0 AND NOT best_attack > entities / 2.0 AS false_negative,
  classification = 'attack' AND contain = 0 AND best_attack > entities / 2.0 AS escalated FROM (
  SELECT scope, {_CLASS_SQL} AS classification, count(*) AS entities, count(*) FILTER (WHERE decision = 'contain') AS contain, count(*) FILTER (WHERE decision = 'review') AS review,
    count(*) FILTER (WHERE decision = 'monitor') AS monitor, count(*) FILTER (WHERE decision = 'none') AS "none", count(*) FILTER (WHERE best = 'attack') AS best_attack, count(*) FILTER (WHERE abstained) AS abstentions
  FROM dec GROUP BY scope)""")


@query("scenario_metrics", _by_family(with_("fam", tail="SELECT * FROM fam")))
def _(spark, sf_dir):
    decided = stage(_family_pass(spark, sf_dir).decided.select("scope", "decision", "best", "abstained"), "decided")
    return Ev.scenario_metrics(decided, _classes(decided))


@query("metrics_totals", _by_family(with_("fam", tail=f"""
SELECT sum(entities)::BIGINT AS entities, count(*) FILTER (WHERE classification <> 'attack') AS benign_families, count(*) FILTER (WHERE false_positive) AS false_positives,
  count(*) FILTER (WHERE classification = 'attack') AS attack_families, count(*) FILTER (WHERE classification = 'attack' AND contain > 0) AS attacks_contained,
  count(*) FILTER (WHERE escalated) AS attacks_escalated, count(*) FILTER (WHERE false_negative) AS attacks_missed, {r6('sum(abstentions)::DOUBLE / sum(entities)')} AS abstention_rate FROM fam""")))
def _(spark, sf_dir):
    decided = stage(_family_pass(spark, sf_dir).decided.select("scope", "decision", "best", "abstained"), "decided")
    totals = Ev.metrics_totals(Ev.scenario_metrics(decided, _classes(decided)))
    return totals.withColumn("abstention_rate", q6("abstention_rate"))


_POOLS = (64, 32, 16, 8, 4)
_by_pool = lambda sql: sql.replace("'shop' AS scope, event_id", "'pool' || pool AS scope, event_id").replace(
    "'c' || (regexp_extract(props, '([0-9]+)', 1)::INT % 40) AS card_id", "'c' || (event_id % pool) AS card_id").replace(
    "FROM events)", f"FROM events, (VALUES {', '.join(f'({p})' for p in _POOLS)}) pools(pool))", 1)


@query("pool_sweep", _by_pool(with_("fam", tail=f"""
SELECT scope, {r6('contain::DOUBLE / entities')} AS contain_share, {r6('best_attack::DOUBLE / entities')} AS recognised_share,
  CASE WHEN contain > 0 THEN 'contained' WHEN best_attack > entities / 2.0 THEN 'recognised' ELSE 'lost' END AS verdict FROM fam""")))
def _(spark, sf_dir):
    pools = F.explode(F.array(*[F.lit(p) for p in _POOLS]))
    obs = T.observations(spark, sf_dir).withColumn("pool", pools)
    obs = obs.withColumn("scope", F.concat(F.lit("pool"), "pool")).withColumn("card_id", F.concat(F.lit("c"), F.col("event_id") % F.col("pool")))
    p = detection_pass(obs, as_of_ms=T.newest_ms(spark, sf_dir), window=WINDOW)
    decided = stage(p.decided.select("scope", "decision", "best", "abstained"), "decided")
    classes = decided.select("scope").distinct().withColumn("classification", F.lit("attack"))
    s = Ev.pool_sweep(Ev.scenario_metrics(decided, classes))
    return s.select("scope", q6("contain_share").alias("contain_share"), q6("recognised_share").alias("recognised_share"), "verdict")


@query("scenario_verdict", _by_family(with_("dec", "warranted", tail=f"""
SELECT scope, classification, best, decision, opened, raised, CASE WHEN classification = 'attack' THEN best = 'attack' AND decision IN ('contain', 'review') ELSE best <> 'attack' AND decision NOT IN ('contain', 'review') END AS passed FROM (
  SELECT c.scope, {_CLASS_SQL.replace('CASE scope', 'CASE c.scope')} AS classification, coalesce(best, 'insufficient_evidence') AS best, coalesce(decision, 'none') AS decision, coalesce(opened, 0) AS opened, coalesce(raised, 0) AS raised
  FROM (SELECT DISTINCT scope FROM dec) c LEFT JOIN (
    SELECT scope, count(*) OVER (PARTITION BY scope) AS opened, count(*) FILTER (WHERE decision IN ('contain', 'review')) OVER (PARTITION BY scope) AS raised, best, decision,
      row_number() OVER (PARTITION BY scope ORDER BY CASE decision WHEN 'contain' THEN 3 WHEN 'review' THEN 2 WHEN 'monitor' THEN 1 ELSE 0 END DESC, score DESC, entity_kind DESC, entity_key DESC) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY scope, first_seen_ms, last_seen_ms, attempts ORDER BY CASE entity_kind WHEN 'session' THEN 1 WHEN 'device' THEN 2 ELSE 3 END, entity_key) AS v FROM warranted) WHERE v = 1) d ON d.scope = c.scope AND n = 1)""")))
def _(spark, sf_dir):
    decided = stage(_family_pass(spark, sf_dir).decided, "decided")
    return Ev.scenario_verdict(decided, _classes(decided))


@query("comparison_cases", _by_family(with_("dec", tail="""
SELECT scope, entity_kind, entity_key, attempts, failures, distinct_cards, best, decision, reasons FROM (SELECT *, row_number() OVER (PARTITION BY scope, entity_kind ORDER BY failures DESC, attempts DESC, entity_key) AS n FROM dec) WHERE n = 1""")))
def _(spark, sf_dir):
    cases = counterfactual(Ev.comparison_cases(_family_pass(spark, sf_dir).decided))
    return cases.select("scope", "entity_kind", "entity_key", "attempts", "failures", "distinct_cards", "best", "decision", csv("reasons").alias("reasons"))
