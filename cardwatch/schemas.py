"""Declared schemas of external inputs (nothing is inferred)."""

from pyspark.sql import types as T

INBOX = T.StructType(
    [
        T.StructField("header_id", T.StringType()),
        T.StructField("raw_body", T.StringType()),
        T.StructField("signature", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("received_ms", T.LongType()),
    ]
)

# Open envelope: any entity name, any fields; nested objects arrive as JSON text.
ENVELOPE = "event string, created_at double, payload map<string, struct<entity: map<string, string>>>"

CARD = "id string, network string, type string, issuer string, international boolean"

CHECKOUT = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("network", T.StringType()),
        T.StructField("amount_paise", T.LongType()),
        T.StructField("created_ms", T.LongType()),
    ]
)

SCENARIO = T.StructType(
    [
        T.StructField("family", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("checkouts", T.ArrayType(CHECKOUT)),
        T.StructField(
            "events",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("event_id", T.StringType()),
                        T.StructField("body", T.StringType()),
                        T.StructField("received_ms", T.LongType()),
                    ]
                )
            ),
        ),
    ]
)

# The model's features, in order.
FEATURES = (
    "log_attempts",
    "failure_rate",
    "approval_rate",
    "infra_share",
    "cards_per_attempt",
    "small_amount_share",
    "burstiness",
    "recovery_rate",
    "top_session_failure_share",
    "log_failing_sessions",
)

TRAINING = T.StructType(
    [*[T.StructField(f, T.DoubleType()) for f in FEATURES], T.StructField("is_abuse", T.IntegerType()), T.StructField("group", T.StringType()), T.StructField("origin", T.StringType())]
)
