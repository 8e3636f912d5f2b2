"""Queries: sources, sinks, retention, canonical events, pseudonyms, personal-data scan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cardwatch import schemas
from cardwatch.catalog import control, reports  # noqa: F401  (their SQL fragments are used here)
from cardwatch.catalog.base import fragment, query, with_
from cardwatch.functions import crypto as X, text as Tx
from cardwatch.config import DAY_MS
from cardwatch.session import own_folder, run_folder, stage
from cardwatch.sources import sinks as S, tables as T, webhooks as Wh
from cardwatch.sources.versions import SnapshotTable


def _folder(spark, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _bodies(spark, sf_dir):
    """The columns of the raw table that parsing reads."""
    return T.inbox_table(spark, sf_dir, "scope", "event_id", "source", "received_ms", "raw_body")


# --- deliveries and canonical events -----------------------------------------------------------

fragment("wh", ("late",), """
SELECT *, CASE WHEN event_id % 29 = 0 THEN 'broken' WHEN event_id % 23 = 0 THEN 'settlement' WHEN event_id % 19 = 0 THEN 'refund' WHEN event_id % 17 = 0 THEN 'order' ELSE 'payment' END AS shape FROM late""")
_pay = lambda e: f"CASE WHEN shape = 'payment' THEN {e} END"
fragment("canonical", ("wh",), f"""
SELECT event_id, source, received_ms, event_type, shape AS entity_type, CASE WHEN shape IN ('payment', 'order') THEN order_id END AS order_id,
  CASE WHEN shape IN ('payment', 'refund') THEN payment_id END AS payment_id, amount_paise, {_pay("'INR'")} AS currency,
  CASE shape WHEN 'payment' THEN replace(event_type, 'payment.', '') WHEN 'order' THEN 'paid' END AS status, {_pay('method')} AS method, {_pay('error_code')} AS error_code,
  {_pay('error_reason')} AS error_reason, {_pay('error_source')} AS error_source, {_pay('card_network')} AS card_network, NULL::VARCHAR AS card_type, {_pay('card_issuer')} AS card_issuer,
  {_pay('card_id')} AS card_id, {_pay('event_id % 3 = 0')} AS international, CASE WHEN event_id % 31 = 0 THEN received_ms ELSE at_ms // 1000 * 1000 END AS at_ms
FROM wh WHERE shape <> 'broken'""")
_CAN = ("event_id", "source", "received_ms", "event_type", "entity_type", "order_id", "payment_id", "amount_paise", "currency", "status", "method",
        "error_code", "error_reason", "error_source", "card_network", "card_type", "card_issuer", "card_id", "international", "at_ms")


@query("canonicalize", with_("canonical", tail=f"SELECT {', '.join(_CAN)} FROM canonical"))
def _(spark, sf_dir):
    return Wh.canonicalize(_bodies(spark, sf_dir)).select(*_CAN)


@query("primary_entity", with_("canonical", tail="SELECT entity_type, count(*) AS events_n FROM canonical GROUP BY entity_type"))
def _(spark, sf_dir):
    return Wh.canonicalize(_bodies(spark, sf_dir)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("events_n"))


@query("event_time", with_("canonical", tail="SELECT event_id, at_ms FROM canonical"))
def _(spark, sf_dir):
    return Wh.canonicalize(_bodies(spark, sf_dir)).select("event_id", "at_ms")


@query("drop_pii", with_("canonical", tail="SELECT count(*) AS events_n, 0::BIGINT AS with_email, 0::BIGINT AS with_phone FROM canonical"))
def _(spark, sf_dir):
    """No canonical row may hold anything that looks like the personal fields of its body."""
    rows = Wh.canonicalize(_bodies(spark, sf_dir))
    everything = F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns])
    has = lambda found: F.sum((F.size(found) > 0).cast("bigint"))
    return rows.agg(
        F.count(F.lit(1)).alias("events_n"), has(Tx.emails(everything)).alias("with_email"), has(Tx.phones(everything)).alias("with_phone")
    )


@query("outcome_of", with_("canonical", tail="SELECT event_id, CASE WHEN status IN ('captured', 'failed', 'authorized') THEN status ELSE 'other' END AS outcome FROM canonical"))
def _(spark, sf_dir):
    return Wh.canonicalize(_bodies(spark, sf_dir)).select("event_id", Wh.outcome_of(F.col("status")).alias("outcome"))


@query("dead_letters", with_("wh", tail="SELECT event_id FROM wh WHERE shape = 'broken'"))
def _(spark, sf_dir):
    return Wh.dead_letters(_bodies(spark, sf_dir)).select("event_id")


@query("src_observations_json", with_("canonical", "obs", tail="""
SELECT c.event_id, c.payment_id, CASE WHEN c.status IN ('captured', 'failed', 'authorized') THEN c.status ELSE 'other' END AS outcome, c.amount_paise, c.card_id, o.session, o.device, o.network
FROM canonical c JOIN obs o USING (event_id) WHERE c.entity_type = 'payment'"""))
def _(spark, sf_dir):
    placed = T.observations(spark, sf_dir).select("order_id", "session", "device", "network").distinct()
    obs = Wh.to_observations(Wh.canonicalize(_bodies(spark, sf_dir)), placed)
    return obs.select("event_id", "payment_id", "outcome", "amount_paise", "card_id", "session", "device", "network")


@query("src_inbox", with_("wh", tail="SELECT CASE WHEN event_id % 10 <> 0 THEN 'evt_' || event_id END AS header_id, source, received_ms, shape <> 'broken' AS readable FROM wh"))
def _(spark, sf_dir):
    """Deliveries written as JSON lines and read back under the declared schema."""
    path = _folder(spark, "inbox")
    T.inbox(spark, sf_dir).select("header_id", "raw_body", "signature", "source", "received_ms").write.json(path)
    rows = Wh.parse_envelope(Wh.read_inbox(spark, path))
    return rows.select("header_id", "source", "received_ms", F.col("envelope").isNotNull().alias("readable"))


@query("src_checkout", with_("checkouts", tail="SELECT order_id, session, device, network, created_ms FROM checkouts"))
def _(spark, sf_dir):
    """Sensor rows keyed by order; a repeated order keeps its first row."""
    rows = T.checkout_sessions(spark, sf_dir)
    twice = rows.unionByName(rows.withColumn("created_ms", F.col("created_ms") + 1))
    first = twice.groupBy("order_id").agg(F.min_by(F.struct("session", "device", "network"), "created_ms").alias("r"), F.min("created_ms").alias("created_ms"))
    return first.select("order_id", "r.*", "created_ms")


@query("src_scenario", with_("obs", tail="SELECT payment_id AS family, count(*) AS events_n, count(DISTINCT order_id) AS checkouts_n FROM obs GROUP BY payment_id"))
def _(spark, sf_dir):
    """Scenario documents (checkouts and events of one payment each) exploded back to rows."""
    i = T.inbox(spark, sf_dir).join(T.observations(spark, sf_dir).select("event_id", "payment_id", "order_id", "session"), "event_id")
    docs = i.groupBy(F.col("payment_id").alias("family")).agg(
        F.collect_set(F.struct("order_id", "session")).alias("checkouts"),
        F.collect_list(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("raw_body").alias("body"), "received_ms")).alias("events"),
    )
    path = _folder(spark, "scenario")
    docs.write.json(path)
    read = spark.read.schema(schemas.SCENARIO).json(path)
    events = read.select("family", F.explode("events").alias("e")).groupBy("family").agg(F.count(F.lit(1)).alias("events_n"))
    checkouts = read.select("family", F.explode("checkouts").alias("c")).groupBy("family").agg(F.count(F.lit(1)).alias("checkouts_n"))
    return events.join(checkouts, "family")


@query("src_tables", with_("obs", tail="SELECT source, count(*) AS events_n, min(at_ms) AS first_ms, max(at_ms) AS last_ms FROM obs WHERE source = 'live' GROUP BY source"))
def _(spark, sf_dir):
    """Snapshot by source and day, read back with a pruned partition filter."""
    path = _folder(spark, "snapshot")
    obs = T.observations(spark, sf_dir)
    S.write_snapshot(obs, path, day_of="at_ms")
    live = spark.read.parquet(path).filter("source = 'live'")
    return live.groupBy("source").agg(F.count(F.lit(1)).alias("events_n"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms"))


@query("dedup_key", with_("wh", tail="SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 'evt_' || event_id ELSE 'hashed' END AS delivery_key FROM wh"))
def _(spark, sf_dir):
    keyed = Wh.dedup_key(T.inbox_table(spark, sf_dir))
    hashed = F.col("delivery_key").rlike("^sha256:[0-9a-f]{64}$")
    return keyed.select("event_id", F.when(hashed, "hashed").otherwise(F.col("delivery_key")).alias("delivery_key"))


@query("dedup_deliveries", with_("wh", tail="SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 2 ELSE 1 END AS delivery_count, received_ms, received_ms + CASE WHEN event_id % 13 = 0 THEN 1000 ELSE 0 END AS last_delivered_ms FROM wh"))
def _(spark, sf_dir):
    rows = T.inbox_table(spark, sf_dir)
    again = rows.filter("delivery_count > 1").withColumn("received_ms", F.col("received_ms") + 1000)
    return Wh.dedup_deliveries(rows.drop("delivery_count").unionByName(again.drop("delivery_count"))).select(
        "event_id", "delivery_count", "received_ms", "last_delivered_ms"
    )


@query("verify_signature", with_("wh", tail="SELECT event_id, event_id % 41 <> 0 AND event_id % 37 <> 0 AS verified FROM wh"))
def _(spark, sf_dir):
    return Wh.verify_signature(T.inbox_table(spark, sf_dir), T.WEBHOOK_SECRET).select("event_id", "verified")


@query("seal_payloads", with_("wh", tail="SELECT event_id, TRUE AS opens, TRUE AS wrong_key_fails, TRUE AS differs FROM wh"))
def _(spark, sf_dir):
    """Seal every body, open it again, and fail to open it with another key."""
    key, wrong = X.data_key("batch-1"), X.data_key("batch-2")
    # The nonce is random, so the sealed column is written before it is read several times.
    sealed = stage(T.inbox(spark, sf_dir).select("event_id", "raw_body", X.seal(F.col("raw_body"), key).alias("sealed")), "sealed")
    return sealed.select(
        "event_id",
        F.coalesce(X.unseal(F.col("sealed"), key) == F.col("raw_body"), F.lit(False)).alias("opens"),
        X.unseal(F.col("sealed"), wrong).isNull().alias("wrong_key_fails"),
        (F.hex("sealed") != F.hex("raw_body")).alias("differs"),
    )


# --- pseudonyms ------------------------------------------------------------------------------------

_KEY = "pseudonym-key-1"
_in, _out = X._pads(_KEY)
_hmac = lambda m: f"sha256(unhex('{_out}') || unhex(sha256(unhex('{_in}') || encode({m}))))"
_uas = "[" + ", ".join("'" + u + "'" for u in T.UA_SAMPLES) + "]"
fragment("raw_ck", (), f"""
SELECT 'o' || o_orderkey AS order_id, o_custkey AS k, CASE WHEN o_custkey % 9 = 0 THEN '2001:db8:' || lower(to_hex(o_custkey % 4096)) || '::1' WHEN o_custkey % 101 = 1 THEN 'localhost'
    ELSE '10.' || (o_custkey % 250) || '.' || (o_custkey % 200) || '.' || (o_custkey % 100) END AS ip,
  CASE WHEN o_custkey % 9 = 0 THEN '2001:db8:' || lower(to_hex(o_custkey % 4096)) || '::/48' WHEN o_custkey % 101 = 1 THEN 'unknown' ELSE '10.' || (o_custkey % 250) || '.' || (o_custkey % 200) || '.0/24' END AS net,
  {_uas}[o_custkey % {len(T.UA_SAMPLES)} + 1] AS ua FROM orders""")


@query("pseudonymise", with_("raw_ck", tail=f"SELECT order_id, 'v1:' || {_hmac(chr(39) + 's' + chr(39) + ' || k')} AS session, 'v1:' || {_hmac('net')} AS network FROM raw_ck"))
def _(spark, sf_dir):
    c = T.raw_checkouts(spark, sf_dir)
    return c.select("order_id", X.pseudonymise(F.col("client_session"), _KEY).alias("session"), X.pseudonymise(X.truncate_ip(F.col("ip")), _KEY).alias("network"))


@query("truncate_ip", with_("raw_ck", tail="SELECT order_id, ip, net FROM raw_ck"))
def _(spark, sf_dir):
    return T.raw_checkouts(spark, sf_dir).select("order_id", "ip", X.truncate_ip(F.col("ip")).alias("net"))


_fam = ["edge", "chrome", "safari", "bot", "tool", "headless", "android", "firefox", "safari", "unknown", "other"]
_fam[2] = "ios"


@query("ua_family", with_("raw_ck", tail=f"SELECT order_id, [{', '.join(repr(f) for f in _fam)}][k % {len(_fam)} + 1] AS family FROM raw_ck"))
def _(spark, sf_dir):
    return T.raw_checkouts(spark, sf_dir).select("order_id", X.ua_family(F.col("user_agent")).alias("family"))


# --- retention and replay ----------------------------------------------------------------------------

@query("source_filter", with_("inbox", tail="SELECT event_id FROM inbox WHERE source = 'replay'"))
def _(spark, sf_dir):
    return Wh.provenance(T.inbox(spark, sf_dir), "replay").select("event_id")


def _stored(spark, sf_dir):
    """The raw table as a stored one that is rewritten in part."""
    rows = T.inbox(spark, sf_dir)
    rows = rows if "purged_ms" in rows.columns else rows.withColumn("purged_ms", F.lit(None).cast("bigint"))
    made = SnapshotTable(spark, own_folder(spark, "inbox"), rows.schema, "event_id")
    made.put(rows)
    return made


@query("ret_purge", with_("inbox", "clock", tail=f"SELECT event_id, NOT (status = 'processed' AND received_ms < as_of - {7 * DAY_MS}) AS has_body, CASE WHEN status = 'processed' AND received_ms < as_of - {7 * DAY_MS} THEN as_of END AS purged_ms FROM inbox, clock"))
def _(spark, sf_dir):
    """The stored raw table after the purge, read back."""
    table = _stored(spark, sf_dir)
    S.purge_stored(table, now_ms=T.newest_ms(spark, sf_dir))
    return table.read().select("event_id", F.col("raw_body").isNotNull().alias("has_body"), F.col("purged_ms").cast("bigint").alias("purged_ms"))


@query("ret_clear", with_("inbox", tail="SELECT event_id, source, family FROM inbox WHERE NOT (source = 'replay' AND coalesce(family = 'f1', FALSE))"))
def _(spark, sf_dir):
    table = _stored(spark, sf_dir)
    S.clear_stored(table, "f1")
    return table.read().select("event_id", "source", "family")


@query("ret_clear_all", with_("inbox", tail="SELECT event_id, source FROM inbox WHERE source <> 'replay'"))
def _(spark, sf_dir):
    table = _stored(spark, sf_dir)
    S.clear_stored(table)
    return table.read().select("event_id", "source")


@query("replay_rebase", with_("obs", tail="SELECT event_id, at_ms + 1800000000000 - (SELECT max(at_ms) FROM obs) AS at_ms FROM obs"))
def _(spark, sf_dir):
    obs = T.observations(spark, sf_dir)
    # One row per scope: written, so the join sees its size.
    newest = stage(obs.groupBy("scope").agg(F.max("at_ms").alias("newest_ms")), "newest")
    return S.rebase(obs, now_ms=1_800_000_000_000, newest=newest).select("event_id", "at_ms")


@query("replay_tag", with_("inbox", tail="SELECT event_id, CASE WHEN source = 'replay' AND family IS NULL THEN 'loud' ELSE family END AS family FROM inbox"))
def _(spark, sf_dir):
    return S.tag_replay(T.inbox(spark, sf_dir), "loud").select("event_id", "family")


@query("source_counts", with_("obs", tail="SELECT scope, count(*) FILTER (WHERE source = 'live') AS live, count(*) FILTER (WHERE source = 'replay') AS replay FROM obs GROUP BY scope"))
def _(spark, sf_dir):
    return S.source_counts(T.observations(spark, sf_dir))


@query("correlated_count", with_("obs", "clock", tail=f"SELECT scope, count(DISTINCT payment_id) AS payments FROM obs, clock WHERE at_ms >= as_of - {7 * DAY_MS} GROUP BY scope"))
def _(spark, sf_dir):
    return S.correlated_count(T.observations(spark, sf_dir), since_ms=T.newest_ms(spark, sf_dir) - 7 * DAY_MS)


# --- sinks -------------------------------------------------------------------------------------------

@query("snk_audit_csv", with_("log", tail="SELECT chain_id, seq, at_ms, kind, actor_id FROM log"))
def _(spark, sf_dir):
    """Audit rows written as CSV and read back."""
    path = _folder(spark, "audit-csv")
    S.write_csv(T.audit_log(spark, sf_dir).select("chain_id", "seq", "at_ms", "kind", "actor_id"), path)
    return spark.read.schema("chain_id string, seq bigint, at_ms bigint, kind string, actor_id string").option("header", True).csv(path)


@query("snk_reports", with_("inc", tail="SELECT scope, status, count(*) AS incidents FROM inc GROUP BY ALL"))
def _(spark, sf_dir):
    path = _folder(spark, "report")
    S.write_report(T.incidents(spark, sf_dir).groupBy("scope", "status").agg(F.count(F.lit(1)).alias("incidents")), path)
    return spark.read.schema("scope string, status string, incidents bigint").json(path)


def _label_sql(tail: str) -> str:
    return with_("inc", tail=tail)


@query("snk_labels", _label_sql("""
SELECT incident_id, "group", origin, is_abuse, failure_rate, burstiness FROM (SELECT incident_id, 'incident:' || incident_id AS "group", 'merchant' AS origin,
  CASE WHEN best = 'attack' THEN 1 WHEN best = 'healthy_traffic' THEN 0 WHEN status = 'contained' THEN 1 END AS is_abuse, support AS failure_rate, 0.0::DOUBLE AS burstiness, source FROM inc) WHERE is_abuse IS NOT NULL AND source = 'live'"""))
def _(spark, sf_dir):
    return labelled_incidents(spark, sf_dir).select("incident_id", "group", "origin", "is_abuse", "failure_rate", "burstiness")


def labelled_incidents(spark, sf_dir):
    from cardwatch.operators.incidents import label_from_verdict

    inc = T.incidents(spark, sf_dir).filter("source = 'live'")
    verdict = F.when(F.col("best") == "attack", "confirmed_abuse").when(F.col("best") == "healthy_traffic", "false_positive")
    known = {"failure_rate": F.col("support"), "log_attempts": F.log1p("attempts"), "approval_rate": F.col("probability")}
    none = F.lit(None).cast("double")
    features = F.struct(*[known.get(c, none).alias(c) for c in schemas.FEATURES])
    rows = S.labelled_rows(inc.withColumn("label", label_from_verdict(verdict, F.col("status"))).withColumn("features", features))
    return rows.withColumn("incident_id", F.substring("group", 10, 64))


@query("label_join", _label_sql("SELECT CASE WHEN best = 'attack' THEN 1 WHEN best = 'healthy_traffic' THEN 0 WHEN status = 'contained' THEN 1 END AS is_abuse, count(*) AS rows_n FROM inc WHERE source = 'live' AND (best IN ('attack', 'healthy_traffic') OR status = 'contained') GROUP BY 1"))
def _(spark, sf_dir):
    return labelled_incidents(spark, sf_dir).groupBy("is_abuse").agg(F.count(F.lit(1)).alias("rows_n"))


# --- carts and personal data ---------------------------------------------------------------------------

@query("price_cart", """
SELECT order_id, amount_paise, item_count, unknown_lines, unknown_lines = 0 AS priced FROM (
  SELECT 'o' || l_orderkey AS order_id, coalesce(sum(floor(p_retailprice * 100 + 0.5)::BIGINT * l_quantity::BIGINT), 0)::BIGINT AS amount_paise, sum(l_quantity::BIGINT)::BIGINT AS item_count,
    count(*) FILTER (WHERE p_partkey IS NULL) AS unknown_lines FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_type <> 'ECONOMY') ON l_partkey = p_partkey GROUP BY l_orderkey)""")
def _(spark, sf_dir):
    """Carts priced from the catalogue; goods outside it make the cart fail, never a cheaper one."""
    from cardwatch.operators.carts import price_carts

    lines = T.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("order_id"), F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("bigint").alias("quantity")
    )
    goods = T.table(spark, sf_dir, "part").filter("p_type <> 'ECONOMY'").select(
        F.col("p_partkey").alias("sku"), F.floor(F.col("p_retailprice") * 100 + 0.5).cast("bigint").alias("price_paise")
    )
    return price_carts(lines, goods)


_digits = "list_reverse(string_split(regexp_replace({m}, '[^0-9]', '', 'g'), ''))"
_luhn = f"(len({_digits}) BETWEEN 13 AND 19 AND list_sum(list_transform({_digits}, lambda d, i: CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT * 2 > 9 THEN d::INT * 2 - 9 ELSE d::INT * 2 END)) % 10 = 0)"


def _pii_sql(table: str, key: str, text: str) -> str:
    email = r"[\w.+-]+@[\w-]+\.[\w.]{2,}"
    keys = ", ".join(f"CASE WHEN contains({text}, '\"{k}\"') THEN '{k}' END" for k in Tx.KEYS)
    return f"""SELECT {key}, len(list_filter(regexp_extract_all({text}, '{email}'), lambda m: NOT (ends_with(m, '@test.local') OR ends_with(m, '@example.com') OR ends_with(m, '@example.local'))))::INT AS emails,
  len(regexp_extract_all({text}, '{Tx.PHONE}'))::INT AS phones, len(list_filter(regexp_extract_all({text}, '{Tx.CARD}'), lambda m: {_luhn.format(m='m')}))::INT AS cards,
  len(list_filter([{keys}], lambda x: x IS NOT NULL))::INT AS forbidden_keys FROM {table}"""


def _pii(spark, sf_dir, table: str, key: str, text: str):
    body = F.col(text)
    return T.table(spark, sf_dir, table).select(
        key, F.size(Tx.emails(body)).alias("emails"), F.size(Tx.phones(body)).alias("phones"),
        F.size(Tx.card_numbers(body)).alias("cards"), F.size(Tx.forbidden_keys(body)).alias("forbidden_keys"),
    )


@query("pii_scan", _pii_sql("documents", "doc_id", "text"))
def _(spark, sf_dir):
    return _pii(spark, sf_dir, "documents", "doc_id", "text")


@query("pii_scan_pages", _pii_sql("pages", "page_id", "html"))
def _(spark, sf_dir):
    return _pii(spark, sf_dir, "pages", "page_id", "html")
