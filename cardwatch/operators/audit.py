"""Audit log: content hashes, chain verification, filters and groupings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the previous hash of the first entry.
GENESIS = "0" * 64

CONTENT = ("at_ms", "actor_id", "kind", "subject_type", "subject_id", "payload", "policy_version", "policy_hash", "feature_hash", "model_version")


def content_hash(prev_hash: Column, fields: Sequence[Column] | None = None) -> Column:
    """SHA-256 of an entry's fields in fixed order; the payload is stored with sorted keys."""
    values = [F.col(c) for c in CONTENT] if fields is None else list(fields)
    return F.sha2(F.to_json(F.array(*[v.cast("string") for v in values], prev_hash)), 256)


def verify_chain(log: DataFrame, chain: Sequence[str] = ("chain_id",)) -> DataFrame:
    """First place each chain stops adding up, walking it in arrival order (``position``).

    Every row is compared with the one before it by a join on position - 1, so a single chain
    of any length is checked by many tasks; only one candidate per partition and chain is left
    for the final minimum. A missing hash, sequence number or position is a divergence like a wrong one.
    """
    chain = list(chain)
    before = log.select(*chain, (F.col("position") + 1).alias("position"), F.col("seq").alias("prev_seq"), F.col("hash").alias("prev_row_hash"), F.lit(True).alias("_follows"))
    present = log.select(*chain, (F.col("seq") - 1).alias("prev_seq")).distinct().withColumn("displaced", F.lit(True))
    rows = log.join(before, [*chain, "position"], "left").join(present, [*chain, "prev_seq"], "left")
    later = F.col("prev_seq").isNotNull()
    expected = F.when(F.col("_follows"), F.col("prev_row_hash")).otherwise(F.lit(GENESIS))
    jumped = later & (F.col("seq") != F.col("prev_seq") + 1)
    reason = (
        F.when(F.col("seq").isNull() | F.col("position").isNull(), "missing-order")
        .when(later & (F.col("seq") <= F.col("prev_seq")), "out-of-order")
        .when(jumped & F.coalesce(F.col("displaced"), F.lit(False)), "out-of-order")
        .when(jumped, "sequence-gap")
        .when(~F.col("prev_hash").eqNullSafe(expected), "broken-link")
        .when(~content_hash(F.col("prev_hash")).eqNullSafe(F.col("hash")), "hash-mismatch")
    )
    checked = rows.withColumn("reason", reason)
    bad = F.when(F.col("reason").isNotNull(), F.coalesce(F.col("position"), F.lit(-1)))
    return checked.groupBy(*chain).agg(
        F.count(F.lit(1)).alias("entries"),
        F.max_by("hash", "position").alias("head"),
        F.min_by("reason", bad).alias("reason"),
        F.min_by("seq", bad).alias("diverges_at_seq"),
    ).withColumn("valid", F.col("reason").isNull())


def audit_filter(
    *, from_ms: int | None = None, to_ms: int | None = None, kind: str | None = None, actor_id: str | None = None, text: str = ""
) -> Column:
    """Range, kind, actor and free text over the visible fields and the payload."""
    keep = F.lit(True)
    if from_ms is not None:
        keep &= F.col("at_ms") >= from_ms
    if to_ms is not None:
        keep &= F.col("at_ms") <= to_ms
    if kind is not None:
        keep &= F.col("kind") == kind
    if actor_id is not None:
        keep &= F.coalesce(F.col("actor_id") == actor_id, F.lit(False))
    if text:
        visible = F.lower(F.concat_ws("\n", "kind", "actor_id", "subject_type", "subject_id", "payload"))
        keep &= F.contains(visible, F.lit(text.lower()))
    return keep


def audit_for_incidents(log: DataFrame, incidents: DataFrame, containments: DataFrame) -> DataFrame:
    """Log rows about each incident or any of its containments."""
    subjects = incidents.select("incident_id", F.lit("incident").alias("subject_type"), F.col("incident_id").alias("subject_id")).unionByName(
        containments.select("incident_id", F.lit("containment").alias("subject_type"), F.col("containment_id").alias("subject_id"))
    )
    return log.join(subjects, ["subject_type", "subject_id"])


def audit_by_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.expr("at_ms div 86400000").alias("day")).agg(
        F.count(F.lit(1)).alias("entries"), F.min("at_ms").alias("first_ms"), F.max("at_ms").alias("last_ms")
    )


def lockout(attempts: DataFrame, *, key: str, now_ms: int, window_ms: int, n: int) -> DataFrame:
    """Keys whose newest ``n`` attempts in the window all failed."""
    from pyspark.sql import Window as W

    newest = W.partitionBy(key).orderBy(F.desc("at_ms"), "payment_id")
    recent = attempts.filter((F.col("at_ms") > now_ms - window_ms) & F.col(key).isNotNull())
    last = recent.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n)
    return last.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempts"), F.min((F.col("outcome") == "failed").cast("int")).alias("all_failed")
    ).select(key, ((F.col("attempts") == n) & (F.col("all_failed") == 1)).alias("locked"))
