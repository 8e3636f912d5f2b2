"""Payment tables derived from the warehouse tables (read once, column-pruned)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cardwatch.session import configure

SCOPE = "shop"


def scope_of(key: str) -> Column:
    """The merchant a row belongs to: one here, but a column like any other to the optimiser."""
    return F.when(F.col(key).isNotNull(), SCOPE).alias("scope")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str | Column) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.unix_millis(col.cast("timestamp"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream as payment observations: one row per provider event."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    at = epoch_ms("ts")
    return e.select(
        scope_of("user_id"),
        "event_id",
        at.alias("at_ms"),
        F.concat(F.lit("o"), F.col("user_id"), F.lit("_"), F.expr("unix_millis(cast(ts AS timestamp)) div 259200000")).alias("order_id"),
        F.concat(F.lit("p"), F.col("user_id"), F.lit("_"), F.expr("unix_millis(cast(ts AS timestamp)) div 86400000")).alias("payment_id"),
        F.when(failed, "failed")
        .when(F.col("event_type") == "purchase", "captured")
        .when(F.col("event_type") == "signup", "authorized")
        .otherwise("other")
        .alias("outcome"),
        F.floor(F.col("value") * 100 + 0.5).cast("bigint").alias("amount_paise"),
        F.concat(F.lit("c"), F.get_json_object("props", "$.k").cast("int") % 40).alias("card_id"),
        F.when(failed, F.element_at(F.array(F.lit("gateway"), F.lit("bank"), F.lit("customer")), (F.col("event_id") % 3 + 1).cast("int"))).alias("error_source"),
        F.when(
            failed,
            F.element_at(
                F.array(F.lit("card_declined"), F.lit("invalid_card"), F.lit("insufficient_funds"), F.lit("gateway_timeout")),
                (F.col("event_id") % 4 + 1).cast("int"),
            ),
        ).alias("error_reason"),
        F.concat(F.lit("s"), F.col("user_id")).alias("session"),
        F.concat(F.lit("d"), F.col("user_id") % 37).alias("device"),
        F.concat(F.lit("n"), F.col("user_id") % 11).alias("network"),
        F.when(F.col("event_id") % 10 == 0, "replay").otherwise("live").alias("source"),
        (at + (F.col("event_id") % 7) * 60_000).alias("received_ms"),
    )


def newest_ms(spark: SparkSession, sf_dir: str) -> int:
    """Decision moment for the event stream: one second after its newest event."""
    row = table(spark, sf_dir, "events").agg(F.max("ts").alias("m")).select(epoch_ms("m").alias("m")).first()
    return int(row["m"]) + 1_000


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream as canonical webhook events (attempt resolution input)."""
    obs = observations(spark, sf_dir)
    refund = (F.col("outcome") == "other") & (F.col("event_id") % 20 == 0)
    return obs.select(
        "scope",
        "event_id",
        F.when(F.col("outcome") == "failed", "payment.failed")
        .when(F.col("outcome") == "captured", "payment.captured")
        .when(F.col("outcome") == "authorized", "payment.authorized")
        .when(refund, "refund.created")
        .otherwise("payment.pending")
        .alias("event_type"),
        "order_id",
        "payment_id",
        "amount_paise",
        F.when(F.col("event_id") % 3 == 0, "upi").when(F.col("event_id") % 3 == 1, "card").alias("method"),
        F.when(F.col("outcome") == "failed", F.concat(F.lit("E"), F.col("event_id") % 5)).alias("error_code"),
        "error_reason",
        "error_source",
        F.when(F.col("event_id") % 2 == 0, "visa").otherwise("rupay").alias("card_network"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("bank"), F.col("event_id") % 6)).alias("card_issuer"),
        "card_id",
        "at_ms",
        "received_ms",
        "source",
        "session",
        "device",
        "network",
    )


def lineitem_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as canonical events; repeats of (order, line) are webhooks of one payment."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        scope_of("l_orderkey"),
        F.concat_ws(
            "-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
            F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint"), F.col("l_returnflag"),
        ).alias("event_id"),
        F.col("l_orderkey").alias("order_key"),
        F.concat(F.lit("o"), F.col("l_orderkey")).alias("order_id"),
        F.concat(F.lit("p"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("payment_id"),
        F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "authorized").otherwise("captured").alias("outcome"),
        F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("bigint").alias("amount_paise"),
        F.concat(F.lit("c"), F.col("l_partkey") % 97).alias("card_id"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_suppkey") % 5 == 0, "gateway").otherwise("bank")).alias("error_source"),
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_partkey") % 3 == 0, "invalid_card").otherwise("card_declined")).alias("error_reason"),
        (epoch_ms("l_shipdate") + F.col("l_linenumber") * 3_600_000).cast("bigint").alias("at_ms"),
        F.when(F.col("l_orderkey") % 10 == 0, "replay").otherwise("live").alias("source"),
    )


def checkout_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storefront sensor rows: one per order, with the pseudonyms it was placed under."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return joined.select(
        scope_of("o_orderkey"),
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("order_id"),
        F.concat(F.lit("s"), F.col("o_custkey")).alias("session"),
        F.concat(F.lit("d"), F.col("o_custkey") % 211).alias("device"),
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("network"),
        F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint").alias("amount_paise"),
        F.when(F.col("o_orderkey") % 10 == 0, "replay").otherwise("live").alias("source"),
        epoch_ms("o_orderdate").alias("created_ms"),
    )


# Fixed cycles that give the derived incidents their stored verdict columns.
STATUSES = ("open", "under_review", "contained", "resolved", "expired")
EXPLANATIONS = ("attack", "outage", "retry_storm", "healthy_traffic", "insufficient_evidence")
FIRED = ("card_spread,velocity", "approval_collapse", "small_amount_probing", "card_probing,reason_mix", "")
DECISIONS = ("contain", "review", "monitor", "none")


def _cycle(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored incidents: one per (entity, day) with declined payments in the event stream."""
    obs = observations(spark, sf_dir).filter(F.col("outcome") == "failed")
    views = F.array(*[F.struct(F.lit(k).alias("entity_kind"), F.col(k).alias("entity_key")) for k in ("session", "device", "network")])
    rows = obs.withColumn("day", F.expr("at_ms div 86400000")).select(
        "scope", "source", "event_id", "at_ms", "card_id", "day", F.inline(views)
    )
    per_card = rows.groupBy("scope", "source", "entity_kind", "entity_key", "day", "card_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("seed"), F.min("at_ms").alias("a"), F.max("at_ms").alias("b")
    )
    g = per_card.groupBy("scope", "source", "entity_kind", "entity_key", "day").agg(
        F.sum("n").alias("failures"), F.count("card_id").alias("cards"), F.min("seed").alias("seed"),
        F.min("a").alias("first_ms"), F.max("b").alias("last_ms"),
    )
    seed, n = F.col("seed"), F.col("failures")
    score = F.floor(n * 1000 / (n + F.lit(1.0))) / F.lit(1000.0)
    step = lambda k: F.floor(seed / k).cast("bigint")
    return g.select(
        "scope",
        "source",
        F.md5(F.concat_ws(":", "source", "entity_kind", "entity_key", "day")).alias("incident_id"),
        "entity_kind",
        "entity_key",
        _cycle(STATUSES, seed).alias("status"),
        F.when(score >= 0.7, "high").when(score >= 0.5, "medium").otherwise("low").alias("severity"),
        score.alias("score"),
        _cycle(EXPLANATIONS, step(5)).alias("best"),
        _cycle(FIRED, step(25)).alias("fired"),
        _cycle(DECISIONS, step(3)).alias("decision"),
        (F.col("seed") % 101 / F.lit(100.0)).alias("support"),
        ((F.col("seed") % 101) / F.lit(100.0)).alias("probability"),
        "first_ms",
        (F.col("first_ms") + (seed % 50) * 60_000).alias("detected_ms"),
        "last_ms",
        (F.col("last_ms") + 1_800_000).alias("expires_ms"),
        (F.col("failures") * 2).alias("attempts"),
        "failures",
        F.when(seed % 7 != 0, F.col("cards")).alias("distinct_cards"),
        F.concat(F.lit("u"), seed % 9).alias("assignee_id"),
        seed.alias("seed"),
    )


def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Console users, from the nation table (one per row)."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("u"), F.col("n_nationkey")).alias("actor_id"), F.col("n_name").alias("actor_name"))


def containment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of one containment per incident decided contain or review."""
    inc = incidents(spark, sf_dir).filter(F.col("decision").isin("contain", "review"))
    seed, at = F.col("seed"), F.col("detected_ms")
    none, no_int = F.lit(None).cast("string"), F.lit(None).cast("int")

    def move(step: int, kind: str, after_s: int, actor: Column = none, minutes: Column = no_int, required: Column = no_int) -> Column:
        return F.struct(
            F.lit(step).alias("step"), F.lit(kind).alias("kind"), (at + after_s * 1000).alias("at_ms"), actor.alias("actor_id"),
            minutes.alias("minutes"), required.alias("approvals_required"),
        )

    first, second = F.concat(F.lit("u"), seed % 9), F.concat(F.lit("u"), F.floor(seed / 9).cast("bigint") % 9)
    moves = F.array_compact(
        F.array(
            move(1, "proposed", 0, required=(seed % 2 + 1).cast("int")),
            F.when(seed % 5 == 3, move(2, "rejected", 30, first)),
            move(3, "approved", 60, first),
            move(4, "approved", 120, second),
            F.when(seed % 5 == 0, move(5, "extended", 300, first, F.lit(30))),
            F.when(seed % 5 == 1, move(6, "extended", 300, first, F.lit(100))),
            F.when(seed % 5 == 2, move(7, "released", 600, second)),
        )
    )
    return inc.select(
        "scope", "incident_id", F.md5(F.concat(F.lit("c:"), F.col("incident_id"))).alias("containment_id"),
        "entity_kind", "entity_key", "decision", F.inline(moves),
    )


def enforcement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pauses and resumptions of enforcement, from sign-up events."""
    obs = observations(spark, sf_dir).filter(F.col("outcome") == "authorized")
    return obs.select("scope", "event_id", "at_ms", F.when(F.col("event_id") % 3 == 0, "paused").otherwise("resumed").alias("kind"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-linked audit chains, one per payment, some of them tampered with.

    A payment has a handful of events, so each chain is hashed by folding one short array.
    """
    from cardwatch.operators.audit import CONTENT, GENESIS, content_hash

    obs = observations(spark, sf_dir)
    none = F.lit(None).cast("string")
    entry = F.struct(
        "at_ms", "event_id", F.col("session").alias("actor_id"), F.concat(F.lit("payment."), F.col("outcome")).alias("kind"),
        F.lit("payment").alias("subject_type"), F.col("payment_id").alias("subject_id"),
        F.to_json(F.struct(F.col("amount_paise").alias("amount"), F.col("card_id").alias("card"))).alias("payload"),
        F.lit("1").alias("policy_version"), none.alias("policy_hash"), none.alias("feature_hash"), none.alias("model_version"),
    )
    chains = obs.groupBy(F.col("payment_id").alias("chain_id")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.min("event_id").alias("seed")
    )

    def link(hashes: Column, e: Column) -> Column:
        previous = F.when(F.size(hashes) == 0, F.lit(GENESIS)).otherwise(F.element_at(hashes, -1))
        return F.array_append(hashes, content_hash(previous, [e[c] for c in CONTENT]))

    linked = chains.withColumn("hashes", F.aggregate("entries", F.array().cast("array<string>"), link))
    rows = linked.select("chain_id", "seed", F.col("hashes"), F.posexplode("entries").alias("i", "e")).select(
        "chain_id", "seed", (F.col("i") + 1).cast("bigint").alias("seq"), "e.*",
        F.when(F.col("i") == 0, GENESIS).otherwise(F.element_at("hashes", F.greatest(F.col("i"), F.lit(1)))).alias("prev_hash"),
        F.element_at("hashes", F.col("i") + 1).alias("hash"),
    )
    # Tampering by cycle: 1 mutate, 2 delete, 3 mutate and re-hash (second row); 4 swap rows two
    # and three; 5 re-anchor the first row.
    how, second, first = F.col("seed") % 7, F.col("seq") == 2, F.col("seq") == 1
    rows = rows.filter(~((how == 2) & second))
    rows = rows.withColumn("payload", F.when(how.isin(1, 3) & second, F.lit('{"amount":1}')).otherwise(F.col("payload")))
    rows = rows.withColumn("prev_hash", F.when((how == 5) & first, F.lit("f" * 64)).otherwise(F.col("prev_hash")))
    rows = rows.withColumn("hash", F.when(((how == 3) & second) | ((how == 5) & first), content_hash(F.col("prev_hash"))).otherwise(F.col("hash")))
    shown = F.when((how == 4) & (F.col("seq") == 2), 3).when((how == 4) & (F.col("seq") == 3), 2).otherwise(F.col("seq"))
    position = F.row_number().over(W.partitionBy("chain_id").orderBy(shown)).cast("bigint")
    return rows.withColumn("position", position)


WEBHOOK_SECRET = "whsec-test"


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw webhook deliveries built from the event stream: JSON bodies of several entity types.

    Some bodies are about orders, refunds or unknown entities, some are cut off, some carry no
    provider time, and some signatures are wrong or missing.
    """
    from cardwatch.functions.crypto import hmac_sha256

    c = canonical_events(spark, sf_dir).withColumn("outcome", F.regexp_replace("event_type", r"^payment\.", ""))
    i = F.col("event_id")
    none = F.lit(None).cast("string")
    payment = F.struct(
        F.col("payment_id").alias("id"), F.col("amount_paise").alias("amount"), F.lit("INR").alias("currency"), F.col("outcome").alias("status"),
        "order_id", "method", "error_code", "error_reason", "error_source",
        F.when(i % 2 == 0, F.col("card_id")).otherwise(none).alias("card_id"),
        F.struct(F.col("card_id").alias("id"), F.col("card_network").alias("network"), F.lit("").alias("type"), F.col("card_issuer").alias("issuer"),
                 F.lit("4242").alias("last4"), (i % 3 == 0).alias("international")).alias("card"),
        F.concat(F.lit("user"), i, F.lit("@mail.example")).alias("email"), F.lit("+919999900000").alias("contact"),
    )
    order = F.struct(F.col("order_id").alias("id"), F.col("amount_paise").alias("amount"), F.lit("paid").alias("status"))
    refund = F.struct(F.concat(F.lit("r"), i).alias("id"), "payment_id", F.col("amount_paise").alias("amount"))
    other = F.struct(F.concat(F.lit("x"), i).alias("id"), F.col("amount_paise").alias("amount"))
    seconds = F.when(i % 31 == 0, F.lit(0).cast("bigint")).otherwise(F.expr("at_ms div 1000"))

    def body(name: str, entity: Column) -> Column:
        return F.to_json(F.struct(F.lit("event").alias("entity"), F.col("event_type").alias("event"), seconds.alias("created_at"),
                                  F.struct(F.struct(entity.alias("entity")).alias(name)).alias("payload")))

    raw = (
        F.when(i % 29 == 0, F.substring(body("payment", payment), 1, 150))
        .when(i % 23 == 0, body("settlement", other))
        .when(i % 19 == 0, body("refund", refund))
        .when(i % 17 == 0, body("order", order))
        .otherwise(body("payment", payment))
    )
    rows = c.withColumn("raw_body", raw)
    return rows.select(
        "scope", "event_id", F.when(i % 10 != 0, F.concat(F.lit("evt_"), i)).alias("header_id"), "raw_body",
        F.when(i % 41 != 0, F.when(i % 37 == 0, F.lit("bad")).otherwise(hmac_sha256(F.col("raw_body"), WEBHOOK_SECRET))).alias("signature"),
        "source", "at_ms", "received_ms",
        F.when(i % 25 == 0, "pending").when(i % 97 == 0, "dead").otherwise("processed").alias("status"),
        F.when(i % 13 == 0, 2).otherwise(1).cast("bigint").alias("delivery_count"),
        F.when((i % 25 != 0) & (i % 97 != 0), F.col("received_ms") + (i % 50) * 10 - 20).alias("processed_ms"),
        F.when(F.col("source") == "replay", F.when(i % 4 != 0, F.concat(F.lit("f"), i % 3))).alias("family"),
    )


def inbox_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The raw table as it would be stored: bodies written once, then read like any column."""
    from cardwatch.session import stage

    rows = inbox(spark, sf_dir)
    return stage(rows.select(*columns) if columns else rows, "inbox")


UA_SAMPLES = (
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537.36 Edg/120", "Mozilla/5.0 (X11) Chrome/119 Safari/537.36", "Mozilla/5.0 (iPhone) Safari/604.1",
    "Googlebot/2.1", "curl/8.0", "HeadlessChrome/119", "Mozilla/5.0 (Android 13) Chrome/119", "Mozilla/5.0 Firefox/121", "Mozilla/5.0 (Macintosh) Safari/605", "", "Opera/9",
)


def raw_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkout requests before pseudonymisation: address, user agent, client ids."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_custkey")
    v4 = F.concat_ws(".", F.lit("10"), k % 250, k % 200, k % 100)
    v6 = F.concat(F.lit("2001:db8:"), F.lower(F.hex(k % 4096)), F.lit("::1"))
    return o.select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("order_id"),
        F.when(k % 9 == 0, v6).when(k % 101 == 1, F.lit("localhost")).otherwise(v4).alias("ip"),
        F.concat(F.lit(" S"), k, F.lit(" ")).alias("client_session"),
        _cycle(UA_SAMPLES, k).alias("user_agent"),
        epoch_ms("o_orderdate").alias("created_ms"),
    )
