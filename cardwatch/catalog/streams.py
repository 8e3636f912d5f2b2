"""Queries: streams run to completion over slices of the tables in shuffled order; SQL twins are the batch answers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cardwatch.catalog import control, incidents as inc_q, ingest, reports  # noqa: F401  (their SQL fragments are used here)
from cardwatch.catalog.base import IDLE_MS, WINDOW, q6, query, r3, r6, with_
from cardwatch.operators.containment import containment_state
from cardwatch.operators.features import ENTITY
from cardwatch.operators.incidents import cluster_incidents
from cardwatch.session import run_folder, stage
from cardwatch.sources import tables as T
from cardwatch.sources.webhooks import dedup_key
from cardwatch.streaming import jobs as J

KEY = "scope, entity_kind, entity_key"


def _arrive(df, name, start, slices=3, again=False):
    """Deliver a table in slices drawn by hash, so rows come late and out of order, and start the job anew for each slice.

    With ``again`` each slice also brings the one before it a second time.
    """
    spark = df.sparkSession
    source, rows = f"{run_folder(spark)}/{name}-source-{uuid.uuid4().hex}", stage(df, name)
    for i in range(slices):
        drawn = F.pmod(F.xxhash64(*rows.columns), F.lit(slices))
        rows.filter((drawn == i) | (drawn == i - 1) if again else drawn == i).write.mode("append").parquet(source)
        start(spark.readStream.schema(rows.schema).parquet(source))


def _state(spark, name):
    return f"{run_folder(spark)}/{name}-state-{uuid.uuid4().hex}"


def _deliveries(spark, sf_dir):
    """Raw deliveries with every second delivery of the redelivered ones one second later."""
    rows = T.inbox_table(spark, sf_dir)
    again = rows.filter("delivery_count > 1").withColumn("received_ms", F.col("received_ms") + 1000)
    return rows.unionByName(again)


@query("st_dedup", with_("wh", tail="SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS delivery_count FROM wh"))
def _(spark, sf_dir):
    first, counts = _state(spark, "dedup"), _state(spark, "counts")

    def start(stream):
        J.dedup(stream, first)
        J.delivery_counts(stream, counts)

    _arrive(_deliveries(spark, sf_dir), "deliveries", start)
    seen = J.deliveries_now(spark, counts).select("delivery_key", F.col("n").alias("delivery_count"))
    return spark.read.parquet(f"{first}/first").select("event_id", "delivery_key").join(seen, "delivery_key").select("event_id", "delivery_count")


@query("st_drain", with_("canonical", "wh", tail="SELECT event_id, entity_type, payment_id, at_ms FROM canonical UNION ALL SELECT event_id, 'dead', NULL, NULL FROM wh WHERE shape = 'broken'"))
def _(spark, sf_dir):
    state, inbox = _state(spark, "drain"), T.inbox_table(spark, sf_dir)
    _arrive(inbox, "deliveries", lambda stream: J.drain(stream, state), again=True)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    letters = J.letters_now(spark, state).filter("status <> 'processed'")
    return spark.read.parquet(f"{state}/canonical").select("event_id", "entity_type", "payment_id", "at_ms").unionByName(
        dedup_key(inbox).join(letters, "delivery_key", "left_semi").select("event_id", F.lit("dead").alias("entity_type"), none("payment_id", "string"), none("at_ms", "bigint"))
    )


@query("st_dead_letter", with_("wh", tail="SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'retry' ELSE 'dead' END AS status, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS attempts FROM wh WHERE shape = 'broken'"))
def _(spark, sf_dir):
    """Letters tried again from the stored deliveries until two tries have failed; then every second dead one is asked for again and fails once more."""
    state, inbox = _state(spark, "letters"), stage(T.inbox_table(spark, sf_dir), "inbox")
    keyed = stage(dedup_key(inbox).select("event_id", "delivery_key"), "delivery-keys")
    source = f"{run_folder(spark)}/letters-source-{uuid.uuid4().hex}"

    def round_of(rows):
        rows.write.mode("append").parquet(source)
        J.drain(spark.readStream.schema(inbox.schema).parquet(source), state, raw=lambda: inbox, limit=2)

    drawn = F.pmod(F.xxhash64("event_id"), F.lit(2))
    round_of(inbox.filter(drawn == 0))
    round_of(inbox.filter(drawn == 1))
    round_of(inbox.filter(drawn == 0))  # repeats of known deliveries: nothing new, but a round for the letters
    J.requeue_letters(spark, state, keyed.filter("event_id % 2 = 0").join(J.letters_now(spark, state), "delivery_key", "left_semi"))
    round_of(inbox.filter(drawn == 1))
    return keyed.join(J.letters_now(spark, state), "delivery_key").select("event_id", "status", "attempts")


_SLICES = "sl AS (SELECT event_id, at_ms, (received_ms - lo) // ((hi - lo) // 3 + 1) AS slice FROM canon, (SELECT min(received_ms) AS lo, max(received_ms) AS hi FROM canon))"


@query("st_late_flag", with_("canon", tail=f", {_SLICES} SELECT event_id, coalesce(at_ms < (SELECT max(b.at_ms) FROM sl b WHERE b.slice < a.slice) - 300000, FALSE) AS late FROM sl a").replace("\n, sl AS", ", sl AS"))
def _(spark, sf_dir):
    """Arrival in three consecutive stretches of time: lateness depends on what came before."""
    state, source = _state(spark, "late"), _state(spark, "late-source")
    rows = stage(T.canonical_events(spark, sf_dir), "canonical")
    low, high = rows.agg(F.min("received_ms"), F.max("received_ms")).first()
    step = (high - low) // 3 + 1
    for i in range(3):
        rows.filter(F.expr(f"(received_ms - {low}) div {step}") == i).write.mode("append").parquet(source)
        J.late_flags(spark.readStream.schema(rows.schema).parquet(source), state)
    return spark.read.parquet(f"{state}/flagged").select("event_id", "late")


_TILE = ("attempts", "failures", "captures", "gateway_failures", "infra_failures", "small_amounts", "amount_sum_paise", "amounts")


def _payments(spark, sf_dir):
    """State of the payments stream, from shuffled slices."""
    state, observations = _state(spark, "payments"), T.observations(spark, sf_dir)
    _arrive(observations, "observations", lambda stream: J.payments(stream, state))
    return state, observations.schema


@query("st_payments", with_("pay", tail="SELECT scope, payment_id, at_ms, outcome, order_id, amount_paise, card_id, session, device, network, error_reason, error_source FROM pay"))
def _(spark, sf_dir):
    return J.payments_now(spark, *_payments(spark, sf_dir)).select("scope", "payment_id", "at_ms", "outcome", "order_id", "amount_paise", "card_id", "session", "device", "network", "error_reason", "error_source")


@query("st_tiles", with_("tile", tail=f"SELECT {KEY}, minute_ms, {', '.join(_TILE)} FROM tile"))
def _(spark, sf_dir):
    """Tiles kept by retraction: what a late event changes is taken back from the tiles it was in."""
    return J.tiles_now(spark, *_payments(spark, sf_dir)).select(*ENTITY, "minute_ms", *_TILE)


@query("st_sliding", with_("ent", tail=f"""
SELECT {KEY}, end_ms, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'failed') AS failures, count(*) FILTER (WHERE outcome = 'captured') AS captures
FROM (SELECT *, unnest([at_ms // 21600000 * 21600000 + 21600000, at_ms // 21600000 * 21600000 + 43200000]) AS end_ms FROM ent) GROUP BY ALL"""))
def _(spark, sf_dir):
    return J.sliding(J.tiles_now(spark, *_payments(spark, sf_dir)), span_ms=12 * 3_600_000, step_ms=6 * 3_600_000)


@query("st_ingest_rate", with_("obs", tail="SELECT scope, received_ms // 300000 * 300000 AS from_ms, count(*) AS events FROM obs GROUP BY 1, 2"))
def _(spark, sf_dir):
    state = _state(spark, "rate")
    _arrive(T.observations(spark, sf_dir), "observations", lambda stream: J.ingest_rate(stream, state))
    return J.ingest_rates(spark, state)


@query("st_unresolved", """
WITH placed AS (SELECT 'o' || event_id AS order_id, epoch_us(ts) // 1000 AS created_ms FROM events WHERE event_type = 'click'),
paid AS (SELECT epoch_us(ts) // 1000 AS at_ms, 'o' || (event_id - 1) AS order_id FROM events WHERE event_type <> 'click')
SELECT order_id, created_ms FROM placed WHERE NOT EXISTS (SELECT 1 FROM paid WHERE paid.order_id = placed.order_id AND at_ms >= created_ms AND at_ms <= created_ms + 300000)
AND created_ms < (SELECT max(epoch_us(ts) // 1000) FROM events) - 300000""")
def _(spark, sf_dir):
    """A click opens a checkout; the next event pays it when it follows within five minutes."""
    e = T.table(spark, sf_dir, "events").select("event_id", "event_type", T.epoch_ms("ts").alias("at_ms"))
    placed = e.filter("event_type = 'click'").select(F.concat(F.lit("o"), F.col("event_id")).alias("order_id"), F.col("at_ms").alias("created_ms"))
    paid = e.filter("event_type <> 'click'").select(F.concat(F.lit("o"), F.col("event_id") - 1).alias("order_id"), "at_ms")
    a, b = _state(spark, "placed"), _state(spark, "paid")
    _arrive(placed, "placed", lambda stream: J.facts(stream, a, ("order_id", "created_ms")))
    _arrive(paid, "paid", lambda stream: J.facts(stream, b, ("order_id", "at_ms")))
    return J.unresolved(spark, a, b, now_ms=e.agg(F.max("at_ms")).first()[0])


@query("st_evaluate", with_("dec", tail=f"SELECT {KEY}, score, best, decision FROM dec"))
def _(spark, sf_dir):
    """The pass of the last batch equals the batch pass over all events."""
    state = _state(spark, "evaluate")
    _arrive(T.observations(spark, sf_dir), "observations", lambda stream: J.evaluate(stream, state, window=WINDOW, columns=(*ENTITY, "score", "best", "decision")), slices=2)
    passes = spark.read.parquet(f"{state}/decisions")
    last = passes.agg(F.max("batch").alias("m")).first()["m"]
    return passes.filter(F.col("batch") == last).select(*ENTITY, "score", "best", "decision")


@query("st_change", with_("walk", "lims", tail=f"""
SELECT l.network, {r6('cl')} AS cusum_limit, e.i IS NOT NULL AS cusum_fired, e.i AS cusum_at, coalesce({r3('e.s')}, 0.0) AS cusum_statistic, coalesce(e.i - e.since + 1, 0) AS cusum_buckets
FROM lims l LEFT JOIN (SELECT w.network, w.i, w.s, w.since, row_number() OVER (PARTITION BY w.network ORDER BY w.i) AS k FROM walk w JOIN lims USING (network) WHERE w.i >= 30 AND w.s > cl) e ON e.network = l.network AND k = 1"""))
def _(spark, sf_dir):
    """Alarms of the online detector; shuffled slices also bring events of buckets that are closed."""
    state = _state(spark, "change")
    _arrive(T.observations(spark, sf_dir), "observations", lambda stream: J.change(stream, state, options=inc_q._SHARP, start_ms=inc_q._START, bucket_ms=inc_q._BUCKET))
    alarms = J.change_now(spark, state, options=inc_q._SHARP)
    return alarms.select("network", q6("cusum_limit").alias("cusum_limit"), "cusum_fired", "cusum_at", "cusum_statistic", "cusum_buckets")


@query("st_incidents", with_("clustered", tail=f"SELECT {KEY}, incident_key, status, score, first_ms, detected_ms, last_ms, observations, attempts FROM clustered"))
def _(spark, sf_dir):
    state = _state(spark, "incidents")
    evaluations = inc_q._evaluations(spark, sf_dir)
    _arrive(evaluations, "evaluations", lambda stream: J.incidents(stream, state, idle_ms=IDLE_MS))
    return J.incidents_now(spark, state, evaluations.schema).select(*ENTITY, "incident_key", "status", "score", "first_ms", "detected_ms", "last_ms", "observations", "attempts")


@query("st_containment_expiry", with_("cont", "clock", tail="""
SELECT containment_id, CASE WHEN activated_ms IS NULL THEN CASE WHEN rejected THEN 'rejected' ELSE 'proposed' END WHEN released_ms IS NOT NULL THEN 'released' ELSE 'expired' END AS status FROM cont"""))
def _(spark, sf_dir):
    """Timers close what is due: the words on containments come in the order of their times, then the clock moves on by a day."""
    now = T.newest_ms(spark, sf_dir) + 86_400_000
    states = stage(containment_state(T.containment_log(spark, sf_dir), now_ms=0), "containments")
    words = states.filter("status = 'active'").select(
        F.col("containment_id").cast("string").alias("key"), F.col("activated_ms").alias("version_ms"), F.col("expires_ms").alias("due_ms"), F.col("activated_ms").alias("clock_ms"))
    closed = J.expired_now(spark, _clocked(words, "containments", now)).select(F.col("key").alias("containment_id"), "closed_ms")
    found = states.select(F.col("containment_id").cast("string").alias("containment_id"), "status").join(closed, "containment_id", "left")
    return found.select(
        F.col("containment_id").cast(states.schema["containment_id"].dataType).alias("containment_id"),
        F.when(F.col("closed_ms").isNotNull(), "expired").otherwise(F.col("status")).alias("status"))


def _clocked(words, name, now):
    """Deliver words in three stretches of their clock, then one word of a key of its own that moves the clock to ``now``."""
    spark = words.sparkSession
    rows, state, source = stage(words, name), _state(spark, name), f"{run_folder(spark)}/{name}-source-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min("clock_ms"), F.max("clock_ms")).first()
    step = ((high or 0) - (low or 0)) // 3 + 1
    late = spark.createDataFrame([("", now, None, now + 120_000)], rows.schema)
    for part in (*[rows.filter(F.expr(f"(clock_ms - {low or 0}) div {step}") == i) for i in range(3)], late):
        part.write.mode("append").parquet(source)
        J.expire(spark.readStream.schema(rows.schema).parquet(source), state)
    return state


@query("st_incident_expiry", with_("clustered", "clock", tail=f"SELECT {KEY}, incident_key, CASE WHEN status = 'open' AND last_ms + {IDLE_MS} <= as_of + 86400000 THEN 'expired' ELSE status END AS status FROM clustered, clock"))
def _(spark, sf_dir):
    """Idle incidents closed by the clock, without an event of theirs."""
    now = T.newest_ms(spark, sf_dir) + 86_400_000
    found = stage(cluster_incidents(inc_q._evaluations(spark, sf_dir), idle_ms=IDLE_MS), "incidents")
    key = F.concat_ws("|", "scope", "incident_key")
    words = found.filter("status = 'open'").select(key.alias("key"), F.col("last_ms").alias("version_ms"), F.col("expires_ms").alias("due_ms"), F.col("last_ms").alias("clock_ms"))
    closed = J.expired_now(spark, _clocked(words, "idle", now)).select("key", "closed_ms")
    return found.withColumn("key", key).join(closed, "key", "left").select(
        *ENTITY, "incident_key", F.when(F.col("closed_ms").isNotNull(), "expired").otherwise(F.col("status")).alias("status"))


@query("st_block", with_("cont", "pay", "enf", tail="""
SELECT payment_id, p.at_ms FROM (SELECT DISTINCT p.payment_id, p.at_ms FROM pay p JOIN cont c ON c.decision = 'contain' AND p.at_ms >= c.activated_ms AND p.at_ms < coalesce(c.ended_ms, c.expires_ms)
  AND ((c.entity_kind = 'session' AND c.entity_key = p.session) OR (c.entity_kind = 'device' AND c.entity_key = p.device) OR (c.entity_kind = 'network' AND c.entity_key = p.network))) p
ASOF LEFT JOIN enf e ON p.at_ms >= e.at_ms WHERE coalesce(e.kind, 'resumed') <> 'paused'"""))
def _(spark, sf_dir):
    state = _state(spark, "block")
    contain = stage(control._containments(spark, sf_dir).filter("decision = 'contain'"), "containments")
    pauses = stage(T.enforcement_log(spark, sf_dir), "enforcement")
    _arrive(T.observations(spark, sf_dir), "observations", lambda stream: J.block(stream, contain, pauses, state))
    return J.blocked_now(spark, state).select("payment_id", "at_ms")
