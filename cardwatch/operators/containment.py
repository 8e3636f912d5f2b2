"""Containment: state from the event log, caps, enforcement pauses, blocked attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.config import HOUR_MS, KINDS, Policy
from cardwatch.functions.timeline import as_of, running_total, trailing_sum

ENTITY_KEYS = ("scope", "entity_kind", "entity_key")


def containment_state(log: DataFrame, *, now_ms: int, policy: Policy = Policy()) -> DataFrame:
    """State of each containment after its log, as of ``now_ms``.

    A log holds the few moves of one action; moves the state does not allow are counted in
    ``refused`` and change nothing. Approvals count distinct people; an extension must stay
    within the number and the total length the policy allows.
    """
    moves = log.groupBy("containment_id").agg(
        F.max(F.when(F.col("kind") == "proposed", F.col("approvals_required"))).alias("approvals_required"),
        F.array_sort(F.collect_list(F.struct("at_ms", "step", "kind", "actor_id", "minutes"))).alias("moves"),
    )
    minute = 60_000
    no_ms = F.lit(None).cast("bigint")
    start = F.struct(
        F.lit("new").alias("status"),
        F.array().cast("array<string>").alias("approvers"),
        no_ms.alias("proposed_ms"),
        no_ms.alias("activated_ms"),
        no_ms.alias("expires_ms"),
        no_ms.alias("ended_ms"),
        F.lit(0).alias("extensions"),
        F.lit(0).alias("refused"),
    )

    def due(s: Column, at: Column) -> Column:
        return (s["status"] == "active") & (s["expires_ms"] <= at)

    def step(s: Column, m: Column) -> Column:
        ran_out = due(s, m["at_ms"])
        status = F.when(ran_out, F.lit("expired")).otherwise(s["status"])
        proposed, active = status == "proposed", status == "active"
        propose = (m["kind"] == "proposed") & (status == "new")
        approve = (m["kind"] == "approved") & proposed & ~F.array_contains(s["approvers"], m["actor_id"])
        enough = approve & (F.size(s["approvers"]) + 1 >= F.col("approvals_required"))
        reject = (m["kind"] == "rejected") & proposed
        release = (m["kind"] == "released") & active
        length = (s["expires_ms"] - s["activated_ms"]) / minute + m["minutes"]
        extend = (m["kind"] == "extended") & active & (s["extensions"] < policy.max_extensions) & (length <= policy.max_minutes)
        done = propose | approve | reject | release | F.coalesce(extend, F.lit(False))
        return F.struct(
            F.when(propose, "proposed").when(enough, "active").when(reject, "rejected").when(release, "released").otherwise(status).alias("status"),
            F.when(approve, F.array_append(s["approvers"], m["actor_id"])).otherwise(s["approvers"]).alias("approvers"),
            F.when(propose, m["at_ms"]).otherwise(s["proposed_ms"]).alias("proposed_ms"),
            F.when(enough, m["at_ms"]).otherwise(s["activated_ms"]).alias("activated_ms"),
            F.when(enough, m["at_ms"] + policy.default_minutes * minute)
            .when(F.coalesce(extend, F.lit(False)), s["expires_ms"] + m["minutes"] * minute)
            .otherwise(s["expires_ms"])
            .alias("expires_ms"),
            F.when(reject | release, m["at_ms"]).when(ran_out, s["expires_ms"]).otherwise(s["ended_ms"]).alias("ended_ms"),
            (s["extensions"] + F.coalesce(extend, F.lit(False)).cast("int")).alias("extensions"),
            (s["refused"] + (~done).cast("int")).alias("refused"),
        )

    folded = moves.withColumn("s", F.aggregate("moves", start, step))
    last_due = due(F.col("s"), F.lit(now_ms))
    return folded.select(
        "containment_id",
        F.when(last_due, "expired").otherwise(F.col("s.status")).alias("status"),
        "approvals_required",
        F.size("s.approvers").alias("approvals"),
        F.col("s.proposed_ms").alias("proposed_ms"),
        F.col("s.activated_ms").alias("activated_ms"),
        F.col("s.expires_ms").alias("expires_ms"),
        F.when(last_due, F.col("s.expires_ms")).otherwise(F.col("s.ended_ms")).alias("ended_ms"),
        F.col("s.extensions").alias("extensions"),
        F.col("s.refused").alias("refused"),
    )


def expire_due(containments: DataFrame, *, now_ms: int) -> DataFrame:
    """Close active containments whose time has come."""
    due = (F.col("status") == "active") & (F.col("expires_ms") <= now_ms)
    return containments.withColumn("status", F.when(due, "expired").otherwise(F.col("status"))).withColumn(
        "ended_ms", F.when(due, F.lit(now_ms)).otherwise(F.col("ended_ms"))
    )


def _span_steps(extra: tuple[str, ...] = ()) -> Column:
    one = F.lit(1).cast("bigint")
    return F.array(
        F.struct(F.col("activated_ms").alias("at_ms"), one.alias("active")),
        F.struct(F.coalesce("ended_ms", "expires_ms").alias("at_ms"), (-one).alias("active")),
    )


def containment_caps(containments: DataFrame) -> DataFrame:
    """Live containments and proposals of the last hour, as of each proposal."""
    steps = containments.filter(F.col("activated_ms").isNotNull()).select("scope", F.inline(_span_steps()))
    asked = containments.select("scope", F.col("proposed_ms").alias("at_ms"), F.lit(0).cast("bigint").alias("active"))
    live = running_total(steps.unionByName(asked), ["scope"], "at_ms", ["active"])
    hourly = trailing_sum(
        asked.select("scope", "at_ms", F.lit(1).cast("bigint").alias("last_hour")), ["scope"], "at_ms", HOUR_MS, ["last_hour"]
    )
    return (
        containments.withColumn("at_ms", F.col("proposed_ms"))
        .join(live, ["scope", "at_ms"])
        .join(hourly, ["scope", "at_ms"])
        .withColumnRenamed("active", "active_containments")
        .withColumnRenamed("last_hour", "containments_last_hour")
        .drop("at_ms")
    )


def enforcement_as_of(moments: DataFrame, log: DataFrame) -> DataFrame:
    """Whether enforcement was paused at each moment (not paused before the first entry)."""
    state = as_of(moments, log, ["scope"], "at_ms", "kind", order=("event_id",))
    return state.select("scope", "at_ms", F.coalesce(F.col("kind") == "paused", F.lit(False)).alias("paused"))


def blocked_attempts(attempts: DataFrame, containments: DataFrame, enforcement_log: DataFrame) -> DataFrame:
    """Attempts made while any of their keys was contained and enforcement was not paused.

    Containments become +1/-1 steps per entity, read back at the attempts' own times, so an
    entity with many attempts and many containments is never multiplied out.
    """
    keys = list(ENTITY_KEYS)
    views = F.array(*[F.struct(F.lit(k).alias("entity_kind"), F.col(k).alias("entity_key")) for k in KINDS])
    asked = attempts.select("scope", "payment_id", "at_ms", F.inline(views)).filter(F.col("entity_key").isNotNull())
    contained = containments.filter(F.col("activated_ms").isNotNull()).select(*keys, F.inline(_span_steps()))
    relevant = asked.join(containments.select(*keys).distinct(), keys, "left_semi")
    probes = relevant.select(*keys, "at_ms", F.lit(0).cast("bigint").alias("active"))
    active = running_total(contained.unionByName(probes), keys, "at_ms", ["active"]).filter(F.col("active") > 0)
    hit = relevant.join(active, [*keys, "at_ms"], "left_semi").groupBy("scope", "payment_id", "at_ms").agg(
        F.min(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("entity_kind"))).alias("narrowest")
    )
    paused = enforcement_as_of(hit.select("scope", "at_ms"), enforcement_log).filter("paused")
    return hit.join(paused, ["scope", "at_ms"], "left_anti").select(
        "scope", "payment_id", "at_ms",
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("narrowest").cast("int")).alias("blocked_by"),
    )
