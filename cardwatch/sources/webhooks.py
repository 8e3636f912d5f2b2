"""Webhook deliveries: reading, identity, verification, and canonical events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cardwatch import schemas
from cardwatch.functions.crypto import hmac_sha256

# Entities looked at first, in this order.
ENTITY_ORDER = ("payment", "order", "refund", "dispute")

# Fields that identify a person and never leave the raw table.
FORBIDDEN = ("email", "contact", "last4", "vpa", "card_holder_name", "customer_id", "bank_transaction_id", "account_id")


def read_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Deliveries from JSON lines (a Kafka or file stream uses the same schema)."""
    return spark.read.schema(schemas.INBOX).json(path)


def read_inbox_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.INBOX)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def dedup_key(inbox: DataFrame) -> DataFrame:
    """Delivery identity: the provider's id, else a hash of the body."""
    given = F.nullif(F.col("header_id"), F.lit(""))
    return inbox.withColumn("delivery_key", F.coalesce(given, F.concat(F.lit("sha256:"), F.sha2("raw_body", 256))))


def dedup_deliveries(inbox: DataFrame) -> DataFrame:
    """One row per delivery key: the first arrival, with the number of deliveries."""
    keyed = dedup_key(inbox)
    kept = [c for c in keyed.columns if c not in ("delivery_key", "received_ms")]
    return keyed.groupBy("delivery_key").agg(
        F.min("received_ms").alias("received_ms"),
        F.min_by(F.struct(*kept), F.struct("received_ms", "raw_body")).alias("row"),
        F.count(F.lit(1)).alias("delivery_count"),
        F.max("received_ms").alias("last_delivered_ms"),
    ).select("delivery_key", "received_ms", "row.*", "delivery_count", "last_delivered_ms")


def verify_signature(inbox: DataFrame, secret: str) -> DataFrame:
    """Whether the body's keyed hash equals the delivered signature; a missing one fails."""
    expected = hmac_sha256(F.col("raw_body"), secret)
    return inbox.withColumn("verified", F.coalesce(F.col("signature") == expected, F.lit(False)))


def event_time(seconds: Column, received_ms: Column) -> Column:
    """Provider time (seconds) in milliseconds, or the arrival time where there is none."""
    return F.when(seconds > 0, (seconds * 1000).cast("bigint")).otherwise(received_ms)


def primary_entity(payload: Column) -> Column:
    """First non-empty entity: payment, order, refund, dispute, then any other in order."""
    filled = F.filter(F.map_entries(payload), lambda e: F.coalesce(F.size(e["value"]["entity"]), F.lit(0)) > 0)

    def pick(entries: Column) -> Column:
        first = lambda name: F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))
        return F.coalesce(*[first(name) for name in ENTITY_ORDER], F.get(entries, F.lit(0)))

    # One-element transform: the filled entries are computed once and looked at several times.
    return F.get(F.transform(F.array(filled), pick), F.lit(0))


def parse_envelope(inbox: DataFrame) -> DataFrame:
    """Add the parsed envelope; a body that is not an envelope leaves it NULL.

    The body is parsed in a generator, so filters on the result are not rewritten into
    further parses of the same text.
    """
    body = F.from_json("raw_body", schemas.ENVELOPE)
    checked = F.transform(F.array(body), lambda e: F.struct(F.when(e["event"].isNotNull(), e).alias("envelope")))
    return inbox.select("*", F.inline(checked))


def canonicalize(inbox: DataFrame) -> DataFrame:
    """Canonical events: one flat row per readable delivery, without personal fields.

    Columns are selected by name, so nothing outside the list can pass. Empty strings and
    numbers that are not finite become NULL.
    """
    kept = [c for c in ("scope", "event_id", "delivery_key", "header_id", "source", "received_ms") if c in inbox.columns]
    rows = parse_envelope(inbox.select(*kept, "raw_body")).filter(F.col("envelope").isNotNull())
    parts = F.array(
        F.struct(
            F.col("envelope.event").alias("event_type"),
            F.col("envelope.created_at").alias("_created_at"),
            primary_entity(F.col("envelope.payload")).alias("_p"),
        )
    )
    rows = rows.select(*kept, F.inline(parts)).select(
        *kept, "event_type", "_created_at", F.col("_p.key").alias("entity_type"), F.col("_p.value.entity").alias("_entity")
    )
    text = lambda name: F.nullif(F.try_element_at("_entity", F.lit(name)), F.lit(""))
    rows = rows.withColumn("_card", F.from_json(text("card"), schemas.CARD))
    card_text = lambda name: F.nullif(F.col(f"_card.{name}"), F.lit(""))
    kind, own_id = F.col("entity_type"), text("id")
    seconds = F.coalesce(F.col("_created_at"), text("created_at").try_cast("double"))
    return rows.select(
        *kept,
        "event_type",
        "entity_type",
        F.coalesce(text("order_id"), F.when(kind == "order", own_id)).alias("order_id"),
        F.when(kind == "payment", own_id).otherwise(text("payment_id")).alias("payment_id"),
        text("amount").try_cast("bigint").alias("amount_paise"),
        *[text(c).alias(c) for c in ("currency", "status", "method", "error_code", "error_reason", "error_source", "error_step", "error_description")],
        card_text("network").alias("card_network"),
        card_text("type").alias("card_type"),
        card_text("issuer").alias("card_issuer"),
        F.coalesce(text("card_id"), card_text("id")).alias("card_id"),
        F.coalesce(text("international").try_cast("boolean"), F.col("_card.international")).alias("international"),
        event_time(seconds, F.col("received_ms")).alias("at_ms"),
    )


def dead_letters(inbox: DataFrame) -> DataFrame:
    """Deliveries whose body cannot be read, with a fixed reason code; no text of the body leaves the raw table."""
    broken = parse_envelope(inbox).filter(F.col("envelope").isNull())
    reason = F.when(F.try_parse_json("raw_body").isNull(), "not_json").otherwise("no_event")
    return broken.withColumn("last_error", reason).drop("envelope", "raw_body")


def next_attempts(pending: DataFrame, dead: DataFrame, *, now_ms: int, limit: int = 5) -> DataFrame:
    """State of the deliveries that could not be read, after one more round.

    ``pending`` holds one row per delivery that failed in this round (delivery_key, last_error), ``dead`` the state before it
    (delivery_key, attempts, status, last_error, last_ms). A delivery is retried until ``limit`` rounds have failed, then it is dead and
    stays so until it is requeued.
    """
    failed = pending.groupBy("delivery_key").agg(F.max("last_error").alias("error"))
    both = dead.join(failed, "delivery_key", "full_outer")
    retried = F.col("error").isNotNull() & (F.coalesce(F.col("status"), F.lit("retry")) == "retry")
    attempts = F.coalesce(F.col("attempts"), F.lit(0)) + retried.cast("int")
    return both.select(
        "delivery_key",
        attempts.alias("attempts"),
        F.when(attempts >= limit, "dead").otherwise(F.coalesce("status", F.lit("retry"))).alias("status"),
        F.coalesce("error", "last_error").alias("last_error"),
        F.when(retried, F.lit(now_ms).cast("bigint")).otherwise(F.col("last_ms")).alias("last_ms"),
    )


def requeue(dead: DataFrame, keys: DataFrame) -> DataFrame:
    """Dead deliveries a person wants tried again start from no attempts."""
    again = keys.select("delivery_key").distinct().withColumn("_again", F.lit(True))
    marked = dead.join(again, "delivery_key", "left")
    back = F.coalesce(F.col("_again"), F.lit(False)) & (F.col("status") == "dead")
    return marked.withColumn("attempts", F.when(back, 0).otherwise(F.col("attempts"))).withColumn(
        "status", F.when(back, "retry").otherwise(F.col("status"))
    ).drop("_again")


def outcome_of(status: Column) -> Column:
    return F.when(status.isin("captured", "failed", "authorized"), status).otherwise("other")


def to_observations(canonical: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Payment events joined with the pseudonyms of their order, as detection input."""
    events = canonical.filter(F.col("payment_id").isNotNull() & (F.col("entity_type") == "payment"))
    return events.join(checkouts.select("order_id", "session", "device", "network"), "order_id", "left").withColumn(
        "outcome", outcome_of(F.col("status"))
    )


def provenance(rows: DataFrame, source: str = "all") -> DataFrame:
    """Rows of one source; live and replayed rows are never mixed unless asked for."""
    return rows if source == "all" else rows.filter(F.col("source") == source)
