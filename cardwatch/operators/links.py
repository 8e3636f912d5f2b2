"""Joins between events, checkouts, incidents and people."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cardwatch.config import DAY_MS, KINDS

SENSOR = ("session", "device", "network")


def join_observations(events: DataFrame, checkouts: DataFrame) -> DataFrame:
    """Events with the pseudonyms their order was placed under (NULL where none was recorded)."""
    return events.join(checkouts.select("order_id", *SENSOR), "order_id", "left")


def entity_orders(events: DataFrame, checkouts: DataFrame, kind: str | None, key: str | None, source: str, from_ms: int, to_ms: int) -> DataFrame:
    """Orders one entity touched in a time range; without a kind, every order of the shop."""
    seen = events.filter((F.col("source") == source) & F.col("at_ms").between(from_ms, to_ms)).select("order_id")
    placed = checkouts if kind is None else checkouts.filter(F.col(kind) == key)
    return placed.join(seen, "order_id", "left_semi").select("order_id").distinct()


def unresolved_checkouts(checkouts: DataFrame, events: DataFrame, *, now_ms: int, lateness_ms: int = 300_000, limit: int | None = None) -> DataFrame:
    """Checkouts old enough to have heard back, that never did; newest first."""
    waiting = checkouts.filter(F.col("created_ms") < now_ms - lateness_ms).join(
        events.select("order_id"), "order_id", "left_anti"
    )
    aged = waiting.withColumn("age_minutes", F.floor((F.lit(now_ms) - F.col("created_ms")) / 60_000).cast("bigint"))
    return aged if limit is None else aged.orderBy(F.desc("created_ms"), "order_id").limit(limit)


def link_incidents(spans: DataFrame, incidents: DataFrame, *, id_column: str, bucket_ms: int = DAY_MS) -> DataFrame:
    """The incident each attempt or order falls inside: same source and entity, overlapping time.

    Narrowest entity kind first, then earliest detected. Both sides are cut into time buckets,
    so one entity's history is spread over many keys; an entity has few incidents per bucket
    because a new one opens only after the last has gone idle.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket_ms), F.floor(F.col(b) / bucket_ms)))
    views = F.array(*[F.struct(F.lit(k).alias("entity_kind"), F.col(k).alias("entity_key"), F.lit(i).alias("specificity")) for i, k in enumerate(KINDS)])
    left = spans.select("source", id_column, "first_ms", "last_ms", F.inline(views)).withColumn("bucket", buckets("first_ms", "last_ms"))
    right = incidents.select(
        "source", "entity_kind", "entity_key", "incident_id", "severity", "detected_ms",
        F.col("first_ms").alias("opened_ms"), F.col("last_ms").alias("active_ms"),
    ).withColumn("bucket", buckets("opened_ms", "active_ms"))
    hits = left.join(right, ["source", "entity_kind", "entity_key", "bucket"]).filter(
        (F.col("last_ms") >= F.col("opened_ms")) & (F.col("first_ms") <= F.col("active_ms"))
    )
    best = hits.groupBy("source", id_column).agg(
        F.min(F.struct("specificity", "detected_ms", "incident_id", "entity_kind", "severity")).alias("hit")
    )
    return spans.join(
        best.select("source", id_column, F.col("hit.incident_id").alias("incident_id"), F.col("hit.entity_kind").alias("incident_kind"), F.col("hit.severity").alias("incident_severity")),
        ["source", id_column],
        "left",
    )


def with_actor_names(log: DataFrame, actors: DataFrame) -> DataFrame:
    """Log rows with a display name; rows by the system keep NULL."""
    return log.join(actors.select("actor_id", "actor_name"), "actor_id", "left")


def entity_distincts(incidents: DataFrame, events: DataFrame, *, bucket_ms: int = DAY_MS) -> DataFrame:
    """Distinct devices and sessions that touched each incident's entity inside its span."""
    touched = _incident_events(incidents, events, bucket_ms)
    facets = F.array(
        F.struct(F.lit("device").alias("facet"), F.col("device").alias("value")),
        F.struct(F.lit("session").alias("facet"), F.col("session").alias("value")),
    )
    pairs = touched.select("incident_id", F.inline(facets)).filter(F.col("value").isNotNull()).distinct()
    counts = pairs.groupBy("incident_id").agg(
        F.sum((F.col("facet") == "device").cast("bigint")).alias("devices"),
        F.sum((F.col("facet") == "session").cast("bigint")).alias("sessions"),
    )
    zero = F.lit(0).cast("bigint")
    return incidents.select("incident_id").join(counts, "incident_id", "left").select(
        "incident_id", F.coalesce("devices", zero).alias("devices"), F.coalesce("sessions", zero).alias("sessions")
    )


def _incident_events(incidents: DataFrame, events: DataFrame, bucket_ms: int) -> DataFrame:
    """Events inside the span of an incident on one of their entities."""
    views = F.array(*[F.struct(F.lit(k).alias("entity_kind"), F.col(k).alias("entity_key")) for k in KINDS])
    seen = events.withColumn("bucket", F.floor(F.col("at_ms") / bucket_ms)).select("*", F.inline(views))
    spans = incidents.select(
        "incident_id", "source", "entity_kind", "entity_key", "first_ms", "last_ms",
        F.explode(F.sequence(F.floor(F.col("first_ms") / bucket_ms), F.floor(F.col("last_ms") / bucket_ms))).alias("bucket"),
    )
    return seen.join(spans, ["source", "entity_kind", "entity_key", "bucket"]).filter(
        F.col("at_ms").between(F.col("first_ms"), F.col("last_ms"))
    )


def entity_graph(incidents: DataFrame, events: DataFrame, *, bucket_ms: int = DAY_MS) -> DataFrame:
    """Edges of each incident's entity: cards (payments, any capture) and, for networks, sessions (cards)."""
    touched = _incident_events(incidents, events, bucket_ms).filter(F.coalesce(F.col("card_id"), F.lit("")) != "")
    cards = (
        touched.groupBy("incident_id", "card_id", "payment_id")
        .agg(F.max((F.col("outcome") == "captured").cast("int")).alias("captured"))
        .groupBy("incident_id", "card_id")
        .agg(F.count("payment_id").alias("n"), (F.max("captured") == 1).alias("captured"))
        .select("incident_id", F.lit("card").alias("edge"), F.col("card_id").alias("node"), "n", "captured")
    )
    sessions = (
        touched.filter((F.col("entity_kind") == "network") & F.col("session").isNotNull())
        .groupBy("incident_id", "session", "card_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("incident_id", "session")
        .agg(F.count("card_id").alias("n"))
        .select("incident_id", F.lit("session").alias("edge"), F.col("session").alias("node"), "n", F.lit(None).cast("boolean").alias("captured"))
    )
    return cards.unionByName(sessions)


def shared_identifiers(parts: DataFrame, columns: Sequence[str] = ("session", "order_id", "payment_id")) -> DataFrame:
    """Identifiers that appear in more than one ``part``: (column, value, parts). Parts made from one seed repeat each other's."""
    named = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    # a part is known by two hashes: only longs are aggregated, so nothing is sorted and a row of strings is kept once per identifier
    named = parts.filter("part IS NOT NULL").select(F.xxhash64("part").alias("h"), F.xxhash64(F.lit("part"), "part").alias("g"), named).filter("value IS NOT NULL")
    seen = named.groupBy("column", "value").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("h", "g") for f in (F.min, F.max)])
    return seen.filter("min_h <> max_h OR min_g <> max_g").select("column", "value")


def compose_labelled(parts: DataFrame, attack_entities: DataFrame) -> DataFrame:
    """Union of traffic parts, each row flagged when its entity belongs to an attack part.

    Where the rows name their ``part``, no identifier may appear in two: a quiet part that shares sessions with an attack would be labelled as one.
    """
    if "part" in parts.columns:
        shared = shared_identifiers(parts).limit(3).collect()
        if shared:
            raise ValueError(f"parts share identifiers: {', '.join(f'{r.column} {r.value}' for r in shared)}")
    flags = attack_entities.select("session").distinct().withColumn("flag", F.lit(True))
    return parts.join(flags, "session", "left").withColumn("is_abuse", F.coalesce("flag", F.lit(False))).drop("flag")
