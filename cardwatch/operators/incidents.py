"""Incidents: opening, folding, clustering, closing, and the stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.config import KINDS, ShopSpikeLimits, Thresholds
from cardwatch.functions.numeric import clamp01, count_true, half_up
from cardwatch.functions.views import severity_rank
from cardwatch.operators.features import ENTITY
from cardwatch.operators.hypotheses import BENIGN
from cardwatch.operators.rules import severity, warrants_incident
from cardwatch.sources.versions import SnapshotTable

# Where an incident may go from where it is.
ALLOWED = {
    "open": ("under_review", "contained", "resolved", "expired"),
    "under_review": ("contained", "resolved", "expired"),
    "contained": ("under_review", "resolved"),
}

SHOP_WIDE = "shop_wide"


def specificity(kind: Column) -> Column:
    """Session before device before network."""
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def incident_key(kind: Column, key: Column, first_ms: Column) -> Column:
    return F.concat_ws(":", kind, key, first_ms)


def open_incidents(decided: DataFrame, *, as_of_ms: int, t: Thresholds = Thresholds()) -> DataFrame:
    """A new incident per vector that warrants one."""
    found = decided.filter(warrants_incident(t))
    return (
        found.withColumn("incident_key", incident_key(F.col("entity_kind"), F.col("entity_key"), F.col("first_seen_ms")))
        .withColumn("status", F.lit("open"))
        .withColumn("severity", severity(F.col("score"), t))
        .withColumn("first_ms", F.col("first_seen_ms"))
        .withColumn("detected_ms", F.lit(as_of_ms).cast("bigint"))
        .withColumn("last_ms", F.col("last_seen_ms"))
        .withColumn("expires_ms", F.col("last_seen_ms") + t.incident_idle_ms)
        .withColumn("observations", F.lit(1).cast("bigint"))
    )


def time_to_detect() -> Column:
    return F.greatest(F.col("detected_ms") - F.col("first_ms"), F.lit(0))


def cluster_incidents(evaluations: DataFrame, *, idle_ms: int) -> DataFrame:
    """Fold an entity's successive evaluations into incidents.

    An evaluation within the idle time of the last activity belongs to the running incident;
    a longer silence closes it. Only an evaluation that warrants an incident opens one, so
    the quiet rows before it in its stretch are left out. There is one evaluation per entity
    and pass, so the per-entity windows stay as short as the number of passes.
    """
    entity = W.partitionBy(*ENTITY)
    by_time = entity.orderBy("at_ms")
    reached = F.max("activity_ms").over(by_time.rowsBetween(W.unboundedPreceding, -1))
    broke = F.coalesce(F.col("activity_ms") > reached + idle_ms, F.lit(False))
    marked = evaluations.withColumn("stretch", F.sum(broke.cast("int")).over(by_time.rowsBetween(W.unboundedPreceding, 0)))
    marked = marked.withColumn("last_stretch", F.max("stretch").over(entity))
    opened = F.min(F.when(F.col("warrants"), F.col("at_ms"))).over(W.partitionBy(*ENTITY, "stretch"))
    kept = marked.withColumn("opened_ms", opened).filter(F.col("at_ms") >= F.col("opened_ms"))
    folded = kept.groupBy(*ENTITY, "stretch", "last_stretch").agg(
        F.min_by("first_seen_ms", "at_ms").alias("first_ms"),
        F.min("at_ms").alias("detected_ms"),
        F.max("activity_ms").alias("last_ms"),
        F.max_by("score", "at_ms").alias("score"),
        F.max_by("attempts", "at_ms").alias("attempts"),
        F.count(F.lit(1)).alias("observations"),
    )
    return folded.select(
        *ENTITY,
        incident_key(F.col("entity_kind"), F.col("entity_key"), F.col("first_ms")).alias("incident_key"),
        F.when(F.col("stretch") < F.col("last_stretch"), "expired").otherwise("open").alias("status"),
        severity(F.col("score")).alias("severity"),
        "score",
        "first_ms",
        "detected_ms",
        "last_ms",
        (F.col("last_ms") + idle_ms).alias("expires_ms"),
        "observations",
        "attempts",
    )


def expire_idle(incidents: DataFrame, *, now_ms: int) -> DataFrame:
    closed = F.col("status").isin("resolved", "expired") | (F.col("expires_ms") >= now_ms)
    return incidents.withColumn("status", F.when(closed, F.col("status")).otherwise("expired"))


def drop_duplicate_views(incidents: DataFrame) -> DataFrame:
    """Keep the narrowest view of the same activity (same first, last and attempts)."""
    same = W.partitionBy("scope", "first_ms", "last_ms", "attempts").orderBy(
        specificity(F.col("entity_kind")), "detected_ms", "entity_key"
    )
    return incidents.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") == 1).drop("_n")


def exclude_known(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Incidents not already stored for the same entity with the same activity."""
    same = ["source", "entity_kind", "entity_key", "first_ms", "last_ms", "attempts"]
    return found.join(stored.select(*same), same, "left_anti")


def raise_filter(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Keep what is decided contain or review, and what is stored already."""
    known = stored.select("incident_key").distinct().withColumn("known", F.lit(True))
    flagged = found.join(known, "incident_key", "left")
    return flagged.filter(F.col("decision").isin("contain", "review") | F.col("known")).drop("known")


def upsert_incidents(stored: DataFrame, found: DataFrame, *, key: str = "incident_id") -> DataFrame:
    """Next snapshot of the incident table: new values win, except what may never be rewritten."""
    keep_stored = ("status", "first_ms", "detected_ms")
    columns = [c for c in stored.columns if c != key]
    # several finds of one key are one: the one with the newest activity
    newest = F.max_by(F.struct(*columns), F.struct("last_ms", *[c for c in columns if c != "last_ms"])).alias("row")
    single = found.select(*stored.columns).groupBy(key).agg(newest).select(key, "row.*")
    a, b = stored.alias("a"), single.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    in_both = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNotNull()
    pick = lambda c: (
        F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
        if c in keep_stored
        else F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    )
    return joined.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *[pick(c).alias(c) for c in columns],
        F.when(in_both, "updated").when(F.col(f"a.{key}").isNull(), "opened").otherwise("kept").alias("change"),
    )


def store_incidents(table: SnapshotTable, found: DataFrame, *, key: str = "incident_id") -> list[int]:
    """Upsert finds into the stored incidents; only the buckets of their keys are read and written."""
    return table.change(found, lambda stored: upsert_incidents(stored, found, key=key))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Status moves that are not allowed, or that do not start where the last one ended."""
    legal = F.lit(False)
    for source, targets in ALLOWED.items():
        legal = legal | ((F.col("from_status") == source) & F.col("to_status").isin(*targets))
    before = F.lag("to_status").over(W.partitionBy("incident_id").orderBy("at_ms", "step"))
    return (
        log.withColumn("previous", before)
        .withColumn(
            "problem",
            F.when(F.col("previous").isNotNull() & (F.col("previous") != F.col("from_status")), "broken-chain").when(~legal, "not-allowed"),
        )
        .filter(F.col("problem").isNotNull())
    )


def shop_spike(
    decided: DataFrame, traffic: DataFrame, attempts: DataFrame, *, as_of_ms: int, limits: ShopSpikeLimits = ShopSpikeLimits(), t: Thresholds = Thresholds()
) -> DataFrame:
    """Per scope: whether the shop as a whole looks like card testing, and the incident that is stored for it if so.

    The incident is anchored at the earliest of the pass's attempts, so a later pass finds the same one.

    Raised only when no entity warranted an incident and innocent explanations are not the
    majority among the entities.
    """
    c = F.col
    judged = decided.groupBy("scope").agg(
        F.count(F.lit(1)).alias("entities"),
        count_true(warrants_incident()).alias("rule_incidents"),
        count_true(c("best").isin(*BENIGN)).alias("benign"),
    )
    collapsed = (
        (c("approval_rate") <= limits.approval_floor)
        & (c("distinct_cards") >= limits.card_spread)
        & (c("failing_sessions") >= limits.min_failing_sessions)
    )
    cohort = c("card_testing_sessions") >= limits.min_testing_sessions
    testing = (c("attempts") >= limits.min_attempts) & (c("infra_failure_share") <= limits.infra_max) & (collapsed | cohort)
    score = half_up(clamp01(1 - c("failing_session_approval_rate")))
    # a shop whose attempts have no entity key is judged by its traffic alone
    first = attempts.groupBy("scope").agg(F.min("at_ms").alias("first_ms"))
    judged = traffic.join(judged, "scope", "left").fillna(0, ["entities", "rule_incidents", "benign"])
    judged = judged.join(first, "scope", "left").withColumn("first_ms", F.coalesce("first_ms", F.lit(as_of_ms)).cast("bigint"))
    return judged.select(
        "scope",
        F.lit("network").alias("entity_kind"),
        F.lit(SHOP_WIDE).alias("entity_key"),
        testing.alias("card_testing"),
        (c("benign") * 2 > c("entities")).alias("explained"),
        "rule_incidents",
        (testing & (c("rule_incidents") == 0) & (c("benign") * 2 <= c("entities"))).alias("raised"),
        score.alias("score"),
        severity(score).alias("severity"),
        F.lit("open").alias("status"),
        F.lit("review").alias("decision"),
        F.lit("attack").alias("best"),
        F.lit("insufficient_evidence").alias("runner_up"),
        F.lit(1.0).alias("margin"),
        F.array(F.lit("shop_wide_card_testing")).alias("reasons"),
        incident_key(F.lit("network"), F.lit(SHOP_WIDE), c("first_ms")).alias("incident_key"),
        "first_ms",
        F.lit(as_of_ms).cast("bigint").alias("detected_ms"),
        F.lit(as_of_ms).cast("bigint").alias("last_ms"),
        F.lit(as_of_ms + t.incident_idle_ms).cast("bigint").alias("expires_ms"),
        F.lit(1).cast("bigint").alias("observations"),
        "attempts",
        "failures",
        "distinct_cards",
    )


def raised_spikes(spikes: DataFrame, stored: DataFrame) -> DataFrame:
    """Shop-wide incidents to store: those raised whose activity is not stored already (``stored``: scope and the columns of an incident)."""
    same = ["scope", "entity_kind", "entity_key", "first_ms", "last_ms", "attempts"]
    return spikes.filter("raised").join(stored.select(*same).distinct(), same, "left_anti")


def deescalate(stored: DataFrame, decided: DataFrame, handled: DataFrame) -> DataFrame:
    """Open incidents whose entity was not re-raised and now has an innocent explanation.

    Returns the rows to resolve, each with the transition to log.
    """
    keys = ["scope", "entity_kind", "entity_key"]
    waiting = stored.filter(F.col("status").isin("open", "under_review")).drop("best")
    explained = decided.filter(F.col("best").isin(*BENIGN)).select(*keys, "best")
    return (
        waiting.join(handled.select(*keys), keys, "left_anti")
        .join(explained, keys)
        .select(
            "incident_id",
            *keys,
            F.col("status").alias("from_status"),
            F.lit("resolved").alias("to_status"),
            F.col("best").alias("explanation"),
        )
    )


def label_from_verdict(verdict: Column, to_status: Column) -> Column:
    """Training label a person's verdict gives an incident."""
    return (
        F.when(verdict == "confirmed_abuse", 1)
        .when(verdict == "false_positive", 0)
        .when(to_status == "contained", 1)
    )


def incident_queue(incidents: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Most severe first (by rank, not by name), then newest; all of them, or a page of ``limit``."""
    ordered = incidents.orderBy(F.desc(severity_rank(F.col("severity"))), F.desc("detected_ms"), "incident_id")
    return ordered if limit is None else ordered.limit(limit)
