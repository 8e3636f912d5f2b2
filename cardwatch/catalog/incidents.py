"""Queries: tiles, change detection, incidents and their presentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.catalog.base import (
    WINDOW,
    HL, IDLE_MS, csv, div0, event_pass, fragment, q6, query, r3, r6, with_,
)
from cardwatch.config import DAY_MS, ChangeOptions, ShopSpikeLimits
from cardwatch.functions import views as V
from cardwatch.operators import change as C, incidents as I, tiles as Ti
from cardwatch.operators.attempts import per_payment
from cardwatch.operators.features import ENTITY, stack_kinds
from cardwatch.operators.rules import fired_rules, severity
from cardwatch.session import own_folder, stage
from cardwatch.sources import tables as T
from cardwatch.sources.versions import SnapshotTable

KEY = "scope, entity_kind, entity_key"


def _attempts(spark, sf_dir):
    return per_payment(T.observations(spark, sf_dir))


# --- tiles -----------------------------------------------------------------------------------

_TILE = ("attempts", "failures", "captures", "gateway_failures", "infra_failures", "small_amounts", "amount_sum_paise", "amounts")
_tile_sums = """count(*) AS attempts, count(*) FILTER (WHERE outcome = 'failed') AS failures, count(*) FILTER (WHERE outcome = 'captured') AS captures,
  count(*) FILTER (WHERE outcome = 'failed' AND error_source = 'gateway') AS gateway_failures,
  count(*) FILTER (WHERE outcome = 'failed' AND error_source IN ('gateway', 'bank')) AS infra_failures,
  count(*) FILTER (WHERE amount_paise <= 5000) AS small_amounts, coalesce(sum(amount_paise), 0)::BIGINT AS amount_sum_paise, count(amount_paise) AS amounts"""
fragment("tile", ("ent",), f"SELECT {KEY}, at_ms // 60000 * 60000 AS minute_ms, {_tile_sums}, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM ent GROUP BY ALL")


@query("tileize", with_("tile", tail="SELECT * FROM tile"))
def _(spark, sf_dir):
    tiles = Ti.tileize(_attempts(spark, sf_dir))
    return tiles.select(*ENTITY, "minute_ms", *_TILE, "first_ms", "last_ms")


@query("merge_tiles", with_("ent", tail=f"""
SELECT a.*, recovered_orders, {r6('reason_concentration')} AS reason_concentration, {r6('burstiness')} AS burstiness FROM (
  SELECT {KEY}, min(at_ms // 60000 * 60000) AS minute_ms, {_tile_sums} FROM ent GROUP BY ALL) a
JOIN (SELECT {KEY}, count(*) FILTER (WHERE f AND c) AS recovered_orders FROM (SELECT {KEY}, order_id, bool_or(outcome = 'failed') AS f, bool_or(outcome = 'captured') AS c FROM ent GROUP BY ALL) GROUP BY ALL) o USING ({KEY})
JOIN (SELECT {KEY}, coalesce(sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE, 0.0) AS reason_concentration FROM (
  SELECT {KEY}, coalesce(error_reason, 'unknown') AS reason, count(*) FILTER (WHERE outcome = 'failed') AS n FROM ent GROUP BY ALL) GROUP BY ALL) r USING ({KEY})
JOIN (SELECT {KEY}, CASE WHEN count(*) < 3 OR avg(gap) = 0 THEN 0.0 ELSE stddev_pop(gap) / avg(gap) END AS burstiness FROM (
  SELECT *, at_ms - lag(at_ms) OVER (PARTITION BY {KEY} ORDER BY at_ms) AS gap FROM ent) GROUP BY ALL) b USING ({KEY})"""
    .replace("sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE", "CASE WHEN sum(n) = 0 THEN 0.0 ELSE sum(n * n)::DOUBLE / (sum(n) * sum(n))::DOUBLE END")))
def _(spark, sf_dir):
    attempts = stage(_attempts(spark, sf_dir), "attempts")
    merged = Ti.merge_tiles(Ti.tileize(attempts), Ti.tile_values(attempts))
    return merged.select(
        *ENTITY, "minute_ms", *_TILE, "recovered_orders",
        q6("reason_concentration").alias("reason_concentration"), q6("burstiness").alias("burstiness"),
    )


@query("hll_merge", with_("ent", tail=f"SELECT {KEY}, count(DISTINCT card_id) AS exact, TRUE AS within_bound FROM ent GROUP BY ALL"))
def _(spark, sf_dir):
    """Union of the minute sketches against the exact count of the entity's whole history."""
    attempts = stage(_attempts(spark, sf_dir), "attempts")
    entities = stack_kinds(attempts)
    exact = entities.select(*ENTITY, "card_id").distinct().groupBy(*ENTITY).agg(F.count("card_id").alias("exact"))
    sketch = Ti.tileize(attempts).groupBy(*ENTITY).agg(F.hll_sketch_estimate(F.hll_union_agg("card_id_sketch")).alias("estimate"))
    bound = F.greatest(3 * F.ceil(F.col("estimate") * 1.04 / 64), F.lit(1))
    return exact.join(sketch, list(ENTITY)).select(*ENTITY, "exact", (F.abs(F.col("estimate") - F.col("exact")) <= bound).alias("within_bound"))


@query("decayed_from_tiles", with_("tile", "clock", tail=f"""
SELECT {KEY}, {r6(f"sum(CASE WHEN minute_ms + 30000 <= as_of THEN failures * pow(2.0, -(as_of - minute_ms - 30000) / {float(HL)}) ELSE 0 END)")} AS decayed_failures FROM tile, clock GROUP BY ALL"""))
def _(spark, sf_dir):
    tiles = Ti.tileize(_attempts(spark, sf_dir), sketches=False)
    out = Ti.decayed_from_tiles(tiles, "failures", as_of_ms=T.newest_ms(spark, sf_dir), half_life_ms=HL)
    return out.select(*ENTITY, q6("decayed_failures").alias("decayed_failures"))


def _tile_window(name, span_ms):
    @query(name, with_("tile", "clock", tail=f"""
SELECT {KEY}, sum(attempts)::BIGINT AS attempts, sum(failures)::BIGINT AS failures, sum(amount_sum_paise)::BIGINT AS amount_sum_paise,
  {r6(f"sum(failures * pow(2.0, -(till - minute_ms - 30000) / {float(HL)}))")} AS decayed_failures
FROM (SELECT tile.*, (as_of // 60000 + 1) * 60000 AS till FROM tile, clock) WHERE minute_ms >= till - {span_ms} AND minute_ms < till GROUP BY ALL"""))
    def _(spark, sf_dir):
        levels = Ti.tile_levels(Ti.tileize(_attempts(spark, sf_dir), sketches=False), half_life_ms=HL)
        till = (T.newest_ms(spark, sf_dir) // 60_000 + 1) * 60_000
        found = Ti.window_sums(levels, from_ms=till - span_ms, to_ms=till, half_life_ms=HL)
        return found.select(*ENTITY, "attempts", "failures", "amount_sum_paise", q6("decayed_failures").alias("decayed_failures"))


_tile_window("tile_window_6h", 6 * 3_600_000)
_tile_window("tile_window_30d", 30 * DAY_MS)


@query("sliding_features", with_("tile", tail=f"""
SELECT *, {r6(div0('captures', 'attempts'))} AS approval_rate FROM (SELECT {KEY}, minute_ms, (sum(attempts) OVER w)::BIGINT AS attempts, (sum(failures) OVER w)::BIGINT AS failures, (sum(captures) OVER w)::BIGINT AS captures
FROM tile WINDOW w AS (PARTITION BY {KEY} ORDER BY minute_ms RANGE BETWEEN {DAY_MS} PRECEDING AND CURRENT ROW))"""))
def _(spark, sf_dir):
    tiles = Ti.tileize(_attempts(spark, sf_dir), sketches=False)
    s = Ti.sliding(tiles, span_ms=DAY_MS)
    return s.select(*ENTITY, "minute_ms", "attempts", "failures", "captures", q6("approval_rate").alias("approval_rate"))


# --- change detection --------------------------------------------------------------------------

_START, _BUCKET = 1_704_067_200_000, 6 * 3_600_000
# Lower limits than the defaults, so that the flat event stream has alarms to compare.
_SHARP = ChangeOptions(control_limit=1.5, slack=0.25, decision_interval=2.0)
fragment("series", ("obs", "clock"), f"""
SELECT network, i AS bucket, count(o.at_ms) AS n FROM (SELECT DISTINCT network FROM obs) k
CROSS JOIN (SELECT unnest(range(0, ((as_of - {_START} + {_BUCKET} - 1) // {_BUCKET})::BIGINT)) AS i FROM clock)
LEFT JOIN (SELECT network, at_ms, (at_ms - {_START}) // {_BUCKET} AS i FROM obs, clock WHERE at_ms >= {_START} AND at_ms < as_of) o USING (network, i)
GROUP BY ALL""")
fragment("base", ("series",), """
SELECT network, avg(n) AS mean, greatest(stddev_samp(n), 0.5) AS sd FROM series WHERE bucket < 30 GROUP BY network""")
fragment("lims", ("base",), """
SELECT *, 1.5 * sd * sqrt(0.2::DOUBLE / 1.8::DOUBLE) AS el, 2.0 * sd AS cl, 0.25 * sd AS slack FROM base""")
fragment("walk", ("series", "lims"), """
SELECT network, 29::BIGINT AS i, mean AS ewma, 0.0::DOUBLE AS s, 0::BIGINT AS since FROM lims
UNION ALL SELECT w.network, w.i + 1, 0.2::DOUBLE * n + 0.8::DOUBLE * w.ewma, greatest(0.0, w.s + n - mean - slack),
  CASE WHEN w.s = 0 AND n - mean - slack > 0 THEN w.i + 1 ELSE w.since END
FROM walk w JOIN series x ON x.network = w.network AND x.bucket = w.i + 1 JOIN lims l ON l.network = w.network""")


def _series(spark, sf_dir):
    return C.bucket_series(
        T.observations(spark, sf_dir), from_ms=_START, to_ms=T.newest_ms(spark, sf_dir), bucket_ms=_BUCKET, keys=("network",)
    )


@query("bucket_series", with_("series", tail="SELECT network, bucket, n FROM series"))
def _(spark, sf_dir):
    return _series(spark, sf_dir)


@query("change_ewma", with_("walk", "lims", tail=f"""
SELECT l.network, {r6('mean')} AS mean, {r6('sd')} AS deviation, {r6('el')} AS ewma_limit, e.i IS NOT NULL AS ewma_fired, e.i AS ewma_at, coalesce({r3('e.ewma - mean')}, 0.0) AS ewma_statistic
FROM lims l LEFT JOIN (SELECT w.network, w.i, w.ewma, row_number() OVER (PARTITION BY w.network ORDER BY w.i) AS k FROM walk w JOIN lims USING (network) WHERE w.i >= 30 AND w.ewma - mean > el) e ON e.network = l.network AND k = 1"""))
def _(spark, sf_dir):
    out = C.detect_change(_series(spark, sf_dir), _SHARP, keys=("network",))
    return out.select("network", q6("mean").alias("mean"), q6("deviation").alias("deviation"), q6("ewma_limit").alias("ewma_limit"), "ewma_fired", "ewma_at", "ewma_statistic")


@query("change_cusum", with_("walk", "lims", tail=f"""
SELECT l.network, {r6('cl')} AS cusum_limit, e.i IS NOT NULL AS cusum_fired, e.i AS cusum_at, coalesce({r3('e.s')}, 0.0) AS cusum_statistic, coalesce(e.i - e.since + 1, 0) AS cusum_buckets
FROM lims l LEFT JOIN (SELECT w.network, w.i, w.s, w.since, row_number() OVER (PARTITION BY w.network ORDER BY w.i) AS k FROM walk w JOIN lims USING (network) WHERE w.i >= 30 AND w.s > cl) e ON e.network = l.network AND k = 1"""))
def _(spark, sf_dir):
    out = C.detect_change(_series(spark, sf_dir), _SHARP, keys=("network",))
    return out.select("network", q6("cusum_limit").alias("cusum_limit"), "cusum_fired", "cusum_at", "cusum_statistic", "cusum_buckets")


@query("change_detect", with_("walk", "lims", tail="""
SELECT l.network, coalesce(bool_or(w.i >= 30 AND w.ewma - mean > 4 * el), FALSE) AS ewma_fired, coalesce(bool_or(w.i >= 30 AND w.s > 6 * cl), FALSE) AS cusum_fired
FROM lims l JOIN walk w USING (network) GROUP BY l.network"""))
def _(spark, sf_dir):
    options = ChangeOptions(control_limit=6.0, slack=0.25, decision_interval=12.0)
    return C.detect_change(_series(spark, sf_dir), options, keys=("network",)).select("network", "ewma_fired", "cusum_fired")


# --- incidents -----------------------------------------------------------------------------------

fragment("evals", ("ent",), f"""
SELECT *, score >= 0.4 AS warrants FROM (SELECT {KEY}, (at_ms // {DAY_MS} + 1) * {DAY_MS} AS at_ms, max(at_ms) AS activity_ms, min(at_ms) AS first_seen_ms, count(*) AS attempts,
  floor(count(*) FILTER (WHERE outcome = 'failed') * 1000 / count(*)) / 1000.0::DOUBLE AS score FROM ent GROUP BY {KEY}, at_ms // {DAY_MS})""")


def _evaluations(spark, sf_dir):
    """One evaluation per entity and day: its failure share as the score."""
    days = stack_kinds(_attempts(spark, sf_dir)).groupBy(*ENTITY, F.expr(f"(at_ms div {DAY_MS} + 1) * {DAY_MS}").alias("day_end")).agg(
        F.max("at_ms").alias("activity_ms"), F.min("at_ms").alias("first_seen_ms"), F.count(F.lit(1)).alias("attempts"),
        F.sum((F.col("outcome") == "failed").cast("bigint")).alias("failures"),
    )
    score = F.floor(F.col("failures") * 1000 / F.col("attempts")) / F.lit(1000.0)
    return days.withColumn("score", score).withColumn("warrants", score >= 0.4).withColumnRenamed("day_end", "at_ms")


fragment("clustered", ("evals",), f"""
SELECT {KEY}, entity_kind || ':' || entity_key || ':' || first(first_seen_ms ORDER BY at_ms) AS incident_key,
  CASE WHEN stretch < last_stretch THEN 'expired' ELSE 'open' END AS status,
  CASE WHEN last(score ORDER BY at_ms) >= 0.7 THEN 'high' WHEN last(score ORDER BY at_ms) >= 0.5 THEN 'medium' ELSE 'low' END AS severity,
  last(score ORDER BY at_ms) AS score, first(first_seen_ms ORDER BY at_ms) AS first_ms, min(at_ms) AS detected_ms, max(activity_ms) AS last_ms,
  max(activity_ms) + {IDLE_MS} AS expires_ms, count(*) AS observations, last(attempts ORDER BY at_ms) AS attempts
FROM (SELECT *, max(stretch) OVER (PARTITION BY {KEY}) AS last_stretch, min(CASE WHEN warrants THEN at_ms END) OVER (PARTITION BY {KEY}, stretch) AS opened FROM (
  SELECT *, sum(CASE WHEN broke THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY at_ms) AS stretch FROM (
    SELECT *, coalesce(activity_ms > max(activity_ms) OVER (PARTITION BY {KEY} ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {IDLE_MS}, FALSE) AS broke FROM evals)))
WHERE at_ms >= opened GROUP BY {KEY}, stretch, last_stretch""")
_CL = (*ENTITY, "incident_key", "status", "severity", "score", "first_ms", "detected_ms", "last_ms", "expires_ms", "observations", "attempts")


def _clustered(spark, sf_dir):
    return I.cluster_incidents(_evaluations(spark, sf_dir), idle_ms=IDLE_MS)


@query("incident_sessions", with_("clustered", tail=f"SELECT {', '.join(_CL)} FROM clustered"))
def _(spark, sf_dir):
    return _clustered(spark, sf_dir).select(*_CL)


@query("fold_incident", with_("clustered", tail=f"SELECT {KEY}, incident_key, observations, score, expires_ms FROM clustered WHERE observations > 1"))
def _(spark, sf_dir):
    return _clustered(spark, sf_dir).filter("observations > 1").select(*ENTITY, "incident_key", "observations", "score", "expires_ms")


@query("drop_duplicate_views", with_("clustered", tail=f"""SELECT {', '.join(_CL)} FROM (SELECT *, row_number() OVER (PARTITION BY scope, first_ms, last_ms, attempts
  ORDER BY CASE entity_kind WHEN 'session' THEN 1 WHEN 'device' THEN 2 ELSE 3 END, detected_ms, entity_key) AS n FROM clustered) WHERE n = 1"""))
def _(spark, sf_dir):
    return I.drop_duplicate_views(_clustered(spark, sf_dir)).select(*_CL)


@query("expire_idle", with_("clustered", "clock", tail=f"SELECT incident_key, CASE WHEN status IN ('resolved', 'expired') OR expires_ms >= as_of THEN status ELSE 'expired' END AS status FROM clustered, clock"))
def _(spark, sf_dir):
    return I.expire_idle(_clustered(spark, sf_dir), now_ms=T.newest_ms(spark, sf_dir)).select("incident_key", "status")


@query("open_incident", with_("warranted", "clock", tail=f"""
SELECT {KEY}, entity_kind || ':' || entity_key || ':' || first_seen_ms AS incident_key, 'open' AS status, score,
  CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity,
  first_seen_ms AS first_ms, as_of AS detected_ms, last_seen_ms AS last_ms, last_seen_ms + 1800000 AS expires_ms, 1::BIGINT AS observations, attempts, decision, fired FROM warranted, clock"""))
def _(spark, sf_dir):
    p = event_pass(spark, sf_dir)
    return I.open_incidents(p.decided, as_of_ms=p.as_of_ms).select(
        *ENTITY, "incident_key", "status", "score", "severity", "first_ms", "detected_ms", "last_ms", "expires_ms", "observations",
        "attempts", "decision", csv(fired_rules()).alias("fired"),
    )


@query("raise_filter", with_("clustered", "evals", "dec", tail=f"""
SELECT incident_key, decision FROM (SELECT c.incident_key, d.decision FROM clustered c JOIN dec d USING ({KEY}))
WHERE decision IN ('contain', 'review') OR incident_key IN (SELECT incident_key FROM clustered WHERE status = 'open')"""))
def _(spark, sf_dir):
    p = event_pass(spark, sf_dir)
    found = stage(_clustered(spark, sf_dir), "clustered")
    stored = found.filter("status = 'open'")
    decided = found.join(p.decided.select(*ENTITY, "decision"), list(ENTITY))
    return I.raise_filter(decided, stored).select("incident_key", "decision")


@query("exclude_known", with_("inc", tail=f"""
SELECT incident_id FROM inc a WHERE NOT EXISTS (SELECT 1 FROM inc b WHERE b.status IN ('open', 'contained') AND b.source = a.source AND b.entity_kind = a.entity_kind
  AND b.entity_key = a.entity_key AND b.first_ms = a.first_ms AND b.last_ms = a.last_ms AND b.attempts = a.attempts)"""))
def _(spark, sf_dir):
    found = T.incidents(spark, sf_dir)
    return I.exclude_known(found, found.filter(F.col("status").isin("open", "contained"))).select("incident_id")


def _snapshot(spark, name, rows, key):
    """A stored table that holds the rows."""
    made = SnapshotTable(spark, own_folder(spark, name), rows.schema, key)
    made.put(rows)
    return made


@query("snk_upsert_incidents", with_("inc", tail="""
SELECT coalesce(a.incident_id, b.incident_id) AS incident_id, coalesce(a.status, b.status) AS status, coalesce(a.first_ms, b.first_ms) AS first_ms,
  coalesce(a.detected_ms, b.detected_ms) AS detected_ms, CASE WHEN b.incident_id IS NOT NULL THEN b.last_ms ELSE a.last_ms END AS last_ms,
  CASE WHEN b.incident_id IS NOT NULL THEN b.score ELSE a.score END AS score,
  CASE WHEN a.incident_id IS NULL THEN 'opened' WHEN b.incident_id IS NULL THEN 'kept' ELSE 'updated' END AS change
FROM (SELECT * FROM inc WHERE entity_kind <> 'network') a
FULL OUTER JOIN (SELECT incident_id, 'open' AS status, first_ms + 1 AS first_ms, detected_ms + 5000 AS detected_ms, last_ms + 1000 AS last_ms, least(score + 0.125, 1.0) AS score FROM inc WHERE severity <> 'medium') b
ON a.incident_id = b.incident_id"""))
def _(spark, sf_dir):
    columns = ("incident_id", "status", "first_ms", "detected_ms", "last_ms", "score")
    rows = T.incidents(spark, sf_dir)
    stored = rows.filter("entity_kind <> 'network'").select(*columns)
    found = rows.filter("severity <> 'medium'").select(
        "incident_id", F.lit("open").alias("status"), (F.col("first_ms") + 1).alias("first_ms"),
        (F.col("detected_ms") + 5000).alias("detected_ms"), (F.col("last_ms") + 1000).alias("last_ms"),
        F.least(F.col("score") + 0.125, F.lit(1.0)).alias("score"),
    )
    """The stored table is written, changed by the finds, and read back; what changed is told from both versions."""
    table = _snapshot(spark, "incidents", stored, "incident_id")
    before = stage(table.read(), "stored")
    I.store_incidents(table, found)
    old, new = before.select("incident_id", F.lit(True).alias("old")), table.read()
    changed = found.select("incident_id", F.lit(True).alias("hit"))
    marked = new.join(old, "incident_id", "left").join(changed, "incident_id", "left")
    return marked.select(*columns, F.when(F.col("old").isNull(), "opened").when(F.col("hit"), "updated").otherwise("kept").alias("change"))


_STATUS_SQL = "['open', 'under_review', 'contained', 'resolved', 'expired']"
fragment("moves", ("inc",), f"""
SELECT incident_id, 1 AS step, detected_ms AS at_ms, 'open' AS from_status, status AS to_status, assignee_id AS actor_id FROM inc
UNION ALL SELECT incident_id, 2, detected_ms + 60000, status, {_STATUS_SQL}[seed // 7 % 5 + 1], assignee_id FROM inc""")


def _moves(spark, sf_dir):
    inc = T.incidents(spark, sf_dir)
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.col("detected_ms").alias("at_ms"), F.lit("open").alias("from_status"), F.col("status").alias("to_status")),
        F.struct(F.lit(2).alias("step"), (F.col("detected_ms") + 60_000).alias("at_ms"), F.col("status").alias("from_status"),
                 T._cycle(T.STATUSES, F.floor(F.col("seed") / 7).cast("bigint")).alias("to_status")),
    )
    return inc.select("incident_id", F.col("assignee_id").alias("actor_id"), F.inline(steps))


@query("transition_check", with_("moves", tail="""
SELECT incident_id, step, from_status, to_status, 'not-allowed' AS problem FROM moves
WHERE (from_status, to_status) NOT IN (VALUES ('open', 'under_review'), ('open', 'contained'), ('open', 'resolved'), ('open', 'expired'), ('under_review', 'contained'),
  ('under_review', 'resolved'), ('under_review', 'expired'), ('contained', 'under_review'), ('contained', 'resolved'))"""))
def _(spark, sf_dir):
    return I.illegal_transitions(_moves(spark, sf_dir)).select("incident_id", "step", "from_status", "to_status", "problem")


@query("join_actor_names", with_("moves", tail="SELECT incident_id, step, actor_id, n_name AS actor_name FROM moves LEFT JOIN (SELECT 'u' || n_nationkey AS actor_id, n_name FROM nation) USING (actor_id)"))
def _(spark, sf_dir):
    from cardwatch.operators.links import with_actor_names

    return with_actor_names(_moves(spark, sf_dir), T.actors(spark, sf_dir)).select("incident_id", "step", "actor_id", "actor_name")


_SPIKE = ShopSpikeLimits(infra_max=0.5)


@query("shop_spike", with_("dec", "clock", "obs", tail=f"""
SELECT s.scope, card_testing, explained, rule_incidents, card_testing AND rule_incidents = 0 AND NOT explained AS raised, score,
  CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity, 'network:shop_wide:' || first_ms AS incident_key, first_ms,
  as_of AS detected_ms, as_of AS last_ms, as_of + 1800000 AS expires_ms, 'open' AS status, 'attack' AS best, 'review' AS decision, 'shop_wide_card_testing' AS reasons FROM (
  SELECT scope, any_value(shop_attempts >= 15 AND shop_infra_failure_share <= 0.5 AND ((shop_approval_rate <= 0.1 AND shop_distinct_cards >= 15 AND shop_failing_sessions >= 5) OR shop_card_testing_sessions >= 5)) AS card_testing,
    count(*) FILTER (WHERE best IN ('outage', 'retry_storm', 'healthy_traffic')) * 2 > count(*) AS explained,
    count(*) FILTER (WHERE score >= 0.4 AND band <> 'low' AND (r_card_spread = 1 OR r_card_spread_slow = 1 OR r_velocity = 1 OR r_small_amount_probing = 1 OR r_machine_cadence = 1)) AS rule_incidents,
    any_value({r3('greatest(0.0, least(1.0, 1 - shop_failing_session_approval_rate))')}) AS score FROM dec GROUP BY scope) s
JOIN (SELECT scope, min(at_ms) AS first_ms FROM (
  SELECT scope, min(at_ms) AS at_ms, max(at_ms) AS newest FROM obs WHERE coalesce(payment_id, '') <> '' GROUP BY scope, payment_id
  UNION ALL SELECT scope, at_ms, at_ms FROM obs WHERE coalesce(payment_id, '') = '') p, clock WHERE newest >= as_of - {WINDOW.lookback_ms} GROUP BY scope) f USING (scope), clock"""))
def _(spark, sf_dir):
    p = event_pass(spark, sf_dir)
    found = I.shop_spike(p.decided, p.traffic, p.attempts, as_of_ms=p.as_of_ms, limits=_SPIKE)
    return found.select(
        "scope", "card_testing", "explained", "rule_incidents", "raised", "score", "severity", "incident_key", "first_ms", "detected_ms", "last_ms", "expires_ms",
        "status", "best", "decision", F.concat_ws(",", "reasons").alias("reasons"),
    )


@query("deescalate", with_("inc", "dec", "warranted", tail=f"""
SELECT i.incident_id, {', '.join('i.' + c for c in ENTITY)}, i.status AS from_status, 'resolved' AS to_status, d.best AS explanation FROM inc i
JOIN (SELECT {KEY}, best FROM dec WHERE best IN ('outage', 'retry_storm', 'healthy_traffic')) d USING ({KEY})
WHERE i.status IN ('open', 'under_review') AND NOT EXISTS (SELECT 1 FROM warranted w WHERE w.scope = i.scope AND w.entity_kind = i.entity_kind AND w.entity_key = i.entity_key)"""))
def _(spark, sf_dir):
    p = event_pass(spark, sf_dir)
    decided = stage(p.decided.select(*ENTITY, "best", "score", "band", "evidence"), "decided")
    from cardwatch.operators.rules import warrants_incident

    return I.deescalate(T.incidents(spark, sf_dir), decided, decided.filter(warrants_incident()))


_VERDICT_SQL = "CASE best WHEN 'attack' THEN 'confirmed_abuse' WHEN 'healthy_traffic' THEN 'false_positive' END"


@query("label_from_verdict", with_("inc", tail=f"""
SELECT incident_id, CASE WHEN verdict = 'confirmed_abuse' THEN 1 WHEN verdict = 'false_positive' THEN 0 WHEN status = 'contained' THEN 1 END AS label
FROM (SELECT *, {_VERDICT_SQL} AS verdict FROM inc)"""))
def _(spark, sf_dir):
    verdict = F.when(F.col("best") == "attack", "confirmed_abuse").when(F.col("best") == "healthy_traffic", "false_positive")
    return T.incidents(spark, sf_dir).select("incident_id", I.label_from_verdict(verdict, F.col("status")).alias("label"))


# --- presentation ----------------------------------------------------------------------------------

_spread = "(list_contains(f, 'card_spread') OR list_contains(f, 'card_spread_slow') OR list_contains(f, 'card_probing'))"
_has = lambda *r: "(" + " OR ".join(f"list_contains(f, '{x}')" for x in r) + ")"
# The titles and sentences of functions/views.py.
_TITLE = f"""CASE WHEN {_spread} AND entity_kind = 'network' THEN 'Distributed card testing' WHEN {_spread} THEN 'Coordinated card testing'
  WHEN best = 'attack' AND entity_kind = 'device' THEN 'Suspicious device activity' WHEN best = 'attack' AND entity_kind = 'network' THEN 'Distributed card testing'
  WHEN best = 'attack' THEN 'Suspicious payment activity' WHEN {_has('small_amount_probing')} THEN 'Unusual amount pattern'
  WHEN {_has('velocity', 'machine_cadence')} THEN 'Velocity spike detected' WHEN {_has('approval_collapse', 'reason_mix')} THEN 'Multiple declines'
  WHEN best = 'retry_storm' THEN 'Repeated retries' WHEN best = 'outage' THEN 'Gateway failures' ELSE 'Unusual payment activity' END"""
_REASON = f"""CASE WHEN {_spread} AND entity_kind = 'device' THEN 'One device attempted many distinct cards in a short window.'
  WHEN {_spread} AND entity_kind = 'network' THEN 'Many distinct cards were tried across sessions from one network.' WHEN {_spread} THEN 'One checkout session cycled through many distinct cards.'
  WHEN {_has('velocity', 'machine_cadence')} THEN 'Payments arrived faster and more evenly than a person checking out.'
  WHEN {_has('approval_collapse', 'reason_mix')} THEN 'A run of declines well below this shop’s normal approval rate.'
  WHEN {_has('small_amount_probing')} THEN 'Repeated very-small-amount attempts, the shape of card validation.' ELSE 'Several correlated attempts from one entity formed a pattern.' END"""
fragment("inc_v", ("inc",), f"SELECT *, {_TITLE} AS title, {_REASON} AS reason FROM (SELECT *, string_split(fired, ',') AS f FROM inc)")


def titled(spark, sf_dir):
    inc = T.incidents(spark, sf_dir)
    rules = F.split("fired", ",")
    return inc.withColumn("title", V.incident_title(F.col("entity_kind"), F.col("best"), rules)).withColumn(
        "reason", V.reason_for(F.col("entity_kind"), rules)
    )


@query("incident_title", with_("inc_v", tail="SELECT incident_id, title FROM inc_v"))
def _(spark, sf_dir):
    return titled(spark, sf_dir).select("incident_id", "title")


@query("reason_for", with_("inc_v", tail="SELECT incident_id, reason FROM inc_v"))
def _(spark, sf_dir):
    return titled(spark, sf_dir).select("incident_id", "reason")


@query("severity_of", with_("inc", tail="SELECT incident_id, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM inc"))
def _(spark, sf_dir):
    return T.incidents(spark, sf_dir).select("incident_id", severity(F.col("score")).alias("severity"))


@query("risk_bucket", with_("inc", tail="SELECT incident_id, CASE WHEN severity = 'high' AND score >= 0.9 THEN 'critical' ELSE severity END AS bucket FROM inc"))
def _(spark, sf_dir):
    return T.incidents(spark, sf_dir).select("incident_id", V.risk_bucket(F.col("severity"), F.col("score")).alias("bucket"))


@query("time_to_detect", with_("inc", tail="SELECT incident_id, greatest(detected_ms - first_ms, 0) AS time_to_detect_ms FROM inc"))
def _(spark, sf_dir):
    return T.incidents(spark, sf_dir).select("incident_id", I.time_to_detect().alias("time_to_detect_ms"))


@query("short_references", with_("inc", tail="SELECT incident_id, 'INC-' || upper(substr(incident_id, 1, 4)) AS ref, substr(incident_id, 1, 8) AS fingerprint, right(incident_id, 8) AS card_token FROM inc"))
def _(spark, sf_dir):
    keyed = F.concat(F.lit("v2:"), F.col("incident_id"))
    return T.incidents(spark, sf_dir).select(
        "incident_id", V.incident_ref(F.col("incident_id")).alias("ref"), V.fingerprint(keyed).alias("fingerprint"), V.card_token(keyed).alias("card_token")
    )


@query("incident_ref", with_("inc", tail="SELECT incident_id, 'INC-' || upper(substr(incident_id, 1, 4)) AS ref FROM inc"))
def _(spark, sf_dir):
    return T.incidents(spark, sf_dir).select("incident_id", V.incident_ref(F.col("incident_id")).alias("ref"))


@query("fingerprint", with_("inc", tail="SELECT incident_id, substr(incident_id, 1, 8) AS fingerprint FROM inc"))
def _(spark, sf_dir):
    return T.incidents(spark, sf_dir).select("incident_id", V.fingerprint(F.concat(F.lit("v12:"), F.col("incident_id"))).alias("fingerprint"))


@query("card_token", with_("obs", tail="SELECT event_id, right('tok_' || card_id || '_' || event_id, 8) AS card_token FROM obs"))
def _(spark, sf_dir):
    token = F.concat(F.lit("tok_"), F.col("card_id"), F.lit("_"), F.col("event_id"))
    return T.observations(spark, sf_dir).select("event_id", V.card_token(token).alias("card_token"))


@query("incident_queue", with_("inc", tail="SELECT incident_id, severity, detected_ms FROM inc ORDER BY CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, detected_ms DESC, incident_id"))
def _(spark, sf_dir):
    return I.incident_queue(T.incidents(spark, sf_dir)).select("incident_id", "severity", "detected_ms")
