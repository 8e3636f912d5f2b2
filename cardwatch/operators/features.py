"""Per-entity features at one decision moment.

All features of every entity of every kind come from a handful of aggregates over the payment
attempts. No step gathers the rows of an entity: anything that needs more than a running total
is first reduced by a finer key (card, order, reason, minute, amount band), so an entity that
holds a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.config import KINDS, SMALL_AMOUNT_PAISE, FeatureWindow
from cardwatch.functions.numeric import count_true, decay, ratio
from cardwatch.functions.timeline import burstiness, join_gaps
from cardwatch.session import stage

ENTITY = ("scope", "entity_kind", "entity_key")


def stack_kinds(attempts: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Each attempt once per entity kind, from one scan; rows without a key are left out.

    One kind alone is a plain projection, which keeps the layout of attempts stored by that key.
    """
    if len(kinds) == 1:
        one = attempts.select("*", F.lit(kinds[0]).alias("entity_kind"), F.col(kinds[0]).alias("entity_key"))
        return one.filter(F.coalesce(F.col("entity_key"), F.lit("")) != "")
    views = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in kinds])
    stacked = attempts.select("*", F.inline(views).alias("entity_kind", "entity_key"))
    return stacked.filter(F.coalesce(F.col("entity_key"), F.lit("")) != "")


def in_window(attempts: DataFrame, as_of_ms: int, span_ms: int) -> DataFrame:
    """Attempts with as_of - span <= time <= as_of (both ends included)."""
    return attempts.filter((F.col("at_ms") <= as_of_ms) & (F.col("at_ms") >= as_of_ms - span_ms))


def activity(entities: DataFrame, as_of_ms: int, window: FeatureWindow) -> DataFrame:
    """Counts, rates and first/last times: plain sums, combined before the shuffle."""
    failed = F.col("outcome") == "failed"
    weight = decay(F.lit(as_of_ms) - F.col("at_ms"), window.half_life_ms)
    minutes = window.window_ms / 60_000
    sums = (
        in_window(entities, as_of_ms, window.window_ms)
        .groupBy(*ENTITY)
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            count_true(failed).alias("failures"),
            count_true(F.col("outcome") == "captured").alias("captures"),
            count_true(failed & F.coalesce(F.col("error_source") == "gateway", F.lit(False))).alias("gateway_failures"),
            F.sum(weight).alias("decayed_attempts"),
            F.sum(F.when(failed, weight).otherwise(0.0)).alias("decayed_failures"),
            F.count("amount_paise").alias("amounts"),
            count_true(F.col("amount_paise") <= SMALL_AMOUNT_PAISE).alias("small_amounts"),
            F.min("at_ms").alias("first_seen_ms"),
            F.max("at_ms").alias("last_seen_ms"),
            F.max(F.when(F.col("source") == "replay", 1).otherwise(0)).alias("replayed"),
        )
    )
    return sums.select(
        *ENTITY,
        (F.col("decayed_attempts") / minutes).alias("attempt_rate"),
        (F.col("decayed_failures") / minutes).alias("failure_rate"),
        "attempts",
        "failures",
        "captures",
        ratio(F.col("captures"), F.col("attempts")).alias("approval_rate"),
        ratio(F.col("gateway_failures"), F.col("failures")).alias("infra_failure_share"),
        ratio(F.col("small_amounts"), F.col("amounts")).alias("small_amount_share"),
        "first_seen_ms",
        "last_seen_ms",
        F.when(F.col("replayed") == 1, "replay").otherwise("live").alias("provenance"),
    )


# The facet each feature of ``variety`` is counted from.
FACET_OF = {
    "distinct_cards": "card",
    "distinct_sessions": "session",
    "distinct_networks": "network",
    "distinct_cards_long_span": "long",
    "max_orders_per_card": "card",
    "recovered_orders": "order",
    "recovery_rate": "order",
    "reason_concentration": "reason",
}


def variety(
    entities: DataFrame, as_of_ms: int, window: FeatureWindow, *, distinct: bool = True, columns: Sequence[str] | None = None
) -> DataFrame:
    """Distinct cards, sessions and networks, orders per card, recoveries, reason concentration.

    Every attempt contributes one narrow row per facet. The rows are reduced per (entity,
    facet, value, detail), then per (entity, facet, value), then per entity, so all facets
    share three shuffles and none of them meets an entity's raw rows in one place. Without ``distinct``
    the sets of cards, sessions and networks are not built. With ``columns`` only these features are made, from the facets they
    need, and orders, which every attempt has.
    """
    wanted = tuple(FACET_OF) if columns is None else [c for c in FACET_OF if c in columns]
    facets = {"order"} | {FACET_OF[c] for c in wanted}
    detailed = "max_orders_per_card" in wanted
    counted = F.lit(distinct)
    recent = F.col("at_ms") >= as_of_ms - window.window_ms
    spanned = F.col("at_ms") >= as_of_ms - window.long_span_ms
    failed = F.col("outcome") == "failed"

    def facet(name: str, value: Column, keep: Column, detail: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        row = F.struct(
            F.lit(name).alias("facet"),
            value.alias("value"),
            (none if detail is None else detail).alias("detail"),
        )
        return F.when(keep & value.isNotNull(), row)

    kind = F.col("entity_kind")
    made = {
        "card": lambda: facet("card", F.col("card_id"), recent & counted, F.nullif(F.col("order_id"), F.lit("")) if detailed else None),
        "long": lambda: facet("long", F.nullif(F.col("card_id"), F.lit("")), spanned & counted),
        "order": lambda: facet("order", F.coalesce(F.col("order_id"), F.lit("")), recent),
        "session": lambda: facet("session", F.col("session"), recent & counted & (kind != "session")),
        "network": lambda: facet("network", F.col("network"), recent & counted & (kind != "network")),
        "reason": lambda: facet("reason", F.coalesce(F.col("error_reason"), F.lit("unknown")), recent & failed),
    }
    rows = F.array_compact(F.array(*[of() for name, of in made.items() if name in facets]))
    narrow = in_window(entities, as_of_ms, window.lookback_ms).select(
        *ENTITY,
        failed.cast("int").alias("failed"),
        (F.col("outcome") == "captured").cast("int").alias("captured"),
        F.inline(rows),
    )
    keys = [*ENTITY, "facet", "value"]
    by_detail = narrow.groupBy(*keys, *(["detail"] if detailed else [])).agg(
        F.count(F.lit(1)).alias("n"), F.max("failed").alias("failed"), F.max("captured").alias("captured")
    )
    by_value = by_detail
    if detailed:
        by_value = by_detail.groupBy(*keys).agg(
            F.sum("n").alias("n"),
            F.max("failed").alias("failed"),
            F.max("captured").alias("captured"),
            F.count("detail").alias("details"),
        )

    def values(name: str) -> Column:
        return count_true(F.col("facet") == name)

    reason_n = F.when(F.col("facet") == "reason", F.col("n"))
    recovered = (F.col("facet") == "order") & (F.col("failed") == 1) & (F.col("captured") == 1)
    measures = {
        "cards": lambda: values("card"),
        "long_cards": lambda: values("long"),
        "orders": lambda: values("order"),
        "other_sessions": lambda: values("session"),
        "other_networks": lambda: values("network"),
        "recovered_orders": lambda: count_true(recovered),
        "max_orders_per_card": lambda: F.max(F.when((F.col("facet") == "card") & (F.col("value") != ""), F.col("details")).otherwise(0)),
        "reason_squares": lambda: F.sum(reason_n * reason_n),
        "reason_total": lambda: F.sum(reason_n),
    }
    wide = by_value.groupBy(*ENTITY).agg(*[of().alias(name) for name, of in measures.items() if detailed or name != "max_orders_per_card"])
    own = lambda k, column: F.when(kind == k, F.lit(1).cast("bigint")).otherwise(F.col(column))
    named = {
        "distinct_cards": F.col("cards"),
        "distinct_sessions": own("session", "other_sessions"),
        "distinct_networks": own("network", "other_networks"),
        "distinct_cards_long_span": F.col("long_cards"),
        "max_orders_per_card": F.col("max_orders_per_card"),
        "recovered_orders": F.col("recovered_orders"),
        "recovery_rate": ratio(F.col("recovered_orders"), F.col("orders")),
        "reason_concentration": ratio(F.col("reason_squares"), F.col("reason_total") * F.col("reason_total")),
    }
    return wide.select(*ENTITY, *[named[c].alias(c) for c in wanted])


def cadence(entities: DataFrame, as_of_ms: int, window: FeatureWindow) -> DataFrame:
    """Coefficient of variation of the gaps between an entity's attempts.

    Attempts of one millisecond are counted first and add zero gaps. Gaps are squared between the distinct milliseconds of a
    day, and then between the days of the window.
    """
    ticks = in_window(entities, as_of_ms, window.window_ms).groupBy(*ENTITY, F.expr("at_ms div 86400000").alias("day"), "at_ms").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("at_ms").over(W.partitionBy(*ENTITY, "day").orderBy("at_ms"))
    gap = (F.col("at_ms") - before).cast("double")
    days = ticks.withColumn("square", F.coalesce(gap * gap, F.lit(0.0))).groupBy(*ENTITY, "day").agg(
        F.sum("n").alias("n"), F.min("at_ms").alias("first"), F.max("at_ms").alias("last"), F.sum("square").alias("squares")
    )
    folded = join_gaps(days, ENTITY)
    return folded.select(*ENTITY, burstiness(F.col("n"), F.col("first"), F.col("last"), F.col("squares")).alias("burstiness"))


def sketch_counts(entities: DataFrame, as_of_ms: int, window: FeatureWindow) -> DataFrame:
    """Estimates of distinct cards, sessions and networks of the window, sketched straight from the rows."""
    recent = in_window(entities, as_of_ms, window.window_ms)
    named = (("card", "card_id"), ("session", "session"), ("network", "network"))
    return recent.groupBy(*ENTITY).agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, 12)).alias(f"{n}_estimate") for n, c in named])


def candidates(attempts: DataFrame, *, as_of_ms: int, window: FeatureWindow, limit: int, kinds: Sequence[str] = KINDS) -> DataFrame:
    """The busiest entities per kind, found by sketches, with exact counts for those alone.

    The discovery pass sums and sketches every entity; distinct sets are built, and ranked, only for the entities that the sketches'
    error leaves within the limit.
    """
    entities = stack_kinds(in_window(attempts, as_of_ms, window.lookback_ms), kinds)
    found = stage(activity(entities, as_of_ms, window).join(sketch_counts(entities, as_of_ms, window), list(ENTITY)), "activity")
    picked = stage(within_reach(found, limit=limit), "candidates")
    own = entities.join(picked.select(*ENTITY), list(ENTITY), "left_semi")
    exact = picked.join(variety(own, as_of_ms, window), list(ENTITY))
    return rank_candidates(exact.withColumn("rank_cards", F.col("distinct_cards")), limit=limit)


def within_reach(found: DataFrame, *, limit: int) -> DataFrame:
    """Entities that may be among the ``limit`` busiest of their kind while estimates are off by up to three error bounds."""
    estimate = F.coalesce("card_estimate", F.lit(0))
    margin = 3 * F.ceil(estimate * 1.04 / 64)
    low, high = estimate - margin, estimate + margin
    order = W.partitionBy("scope", "entity_kind").orderBy(F.desc("failures"), low.desc())
    edge = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).filter(F.col("_n") == limit)
    edge = edge.select("scope", "entity_kind", F.col("failures").alias("_failures"), low.alias("_low"))
    behind = (F.col("failures") < F.col("_failures")) | (F.col("failures") == F.col("_failures")) & (high < F.col("_low"))
    return found.join(edge, ["scope", "entity_kind"], "left").filter(~F.coalesce(behind, F.lit(False))).drop("_failures", "_low")


def exact_ranks(
    rows: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]
) -> DataFrame:
    """Exact order statistics of an integer column per key, without gathering a key's values.

    ``ranks`` maps an output name to the wanted rank (1-based) as a function of the row count.
    Values are counted, then counted again in bands of 65 536; a running total over the bands
    finds the bands that hold a wanted rank, and only those bands are ordered in full.
    """
    keys = list(keys)
    counts = (
        rows.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("band", F.shiftright("v", 16))
    )
    bands = counts.groupBy(*keys, "band").agg(F.sum("n").alias("n"))
    running = W.partitionBy(*keys).orderBy("band").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum("n").over(W.partitionBy(*keys))
    placed = bands.select(
        *keys,
        "band",
        (F.sum("n").over(running) - F.col("n")).alias("below"),
        F.sum("n").over(running).alias("upto"),
        total.alias("total"),
    )
    wanted = [rank(F.col("total")) for rank in ranks.values()]
    holds = lambda rank, below, upto: (upto >= rank) & (below < rank)
    any_rank = functools.reduce(operator.or_, [holds(r, F.col("below"), F.col("upto")) for r in wanted])
    inside = W.partitionBy(*keys, "band").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counts.join(placed.filter(any_rank).drop("upto"), [*keys, "band"]).withColumn(
        "upto", F.col("below") + F.sum("n").over(inside)
    )
    below = F.col("upto") - F.col("n")
    return ranked.groupBy(*keys).agg(
        *[F.max(F.when(holds(r, below, F.col("upto")), F.col("v"))).alias(name) for name, r in zip(ranks, wanted)]
    )


def exact_median(rows: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """Exact median of an integer column per key (mean of the two middle values when even)."""
    middle = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1}
    found = exact_ranks(rows, keys, value, middle)
    return found.select(*keys, ((F.col("_low") + F.col("_high")) / 2.0).alias(alias))


def features(
    attempts: DataFrame,
    *,
    as_of_ms: int,
    window: FeatureWindow = FeatureWindow(),
    kinds: Sequence[str] = KINDS,
    entity_key: str | None = None,
    confirm_exact: bool = True,
    median: bool = False,
    sketches: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Feature vectors of all entities (or one) at ``as_of_ms``.

    ``attempts`` should be a written table: several aggregates read it. ``confirm_exact=False``
    is the discovery path: exact counts are not computed, estimates take their place and rules that need exact counts abstain. ``columns``
    names the features of ``variety`` that are wanted, if not all.
    """
    entities = stack_kinds(in_window(attempts, as_of_ms, window.lookback_ms), kinds)
    if entity_key is not None:
        entities = entities.filter(F.col("entity_key") == entity_key)
    wide = (
        activity(entities, as_of_ms, window)
        .join(variety(entities, as_of_ms, window, distinct=confirm_exact, columns=columns), list(ENTITY), "left")
        .join(cadence(entities, as_of_ms, window), list(ENTITY), "left")
    )
    if sketches or not confirm_exact:
        wide = wide.join(sketch_counts(entities, as_of_ms, window), list(ENTITY), "left")
    if median:
        recent = in_window(entities, as_of_ms, window.window_ms)
        wide = wide.join(
            exact_median(recent, ENTITY, "amount_paise", "median_amount_paise"), list(ENTITY), "left"
        )
    if not confirm_exact:
        for column in ("distinct_cards", "distinct_sessions", "distinct_networks", "distinct_cards_long_span"):
            wide = wide.withColumn(column, F.lit(None).cast("bigint"))
    return wide


def distinct_estimates(vectors: DataFrame) -> DataFrame:
    """Sketch estimate, its error bound and the exact count side by side, per entity."""
    out = [*[F.col(c) for c in ENTITY]]
    for name, exact in (("card", "distinct_cards"), ("session", "distinct_sessions"), ("network", "distinct_networks")):
        estimate = F.col(f"{name}_estimate")
        out.append(
            F.struct(
                estimate.alias("estimate"),
                F.ceil(estimate * 1.04 / 64).alias("error_bound"),
                F.col(exact).alias("exact"),
            ).alias(exact)
        )
    return vectors.select(*out)


def rank_candidates(vectors: DataFrame, *, limit: int) -> DataFrame:
    """The ``limit`` busiest entities per kind: failures, then distinct cards, then attempts."""
    order = W.partitionBy("scope", "entity_kind").orderBy(
        F.desc("failures"), F.desc("rank_cards"), F.desc("attempts"), "entity_key"
    )
    return vectors.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
