"""Per-minute partial aggregates of entities, and what can be read back from them.

A tile is one row of sums per (entity, minute). What the sums cannot answer is kept as rows of
a second table, one per (entity, minute, facet, value), so a busy minute never turns into one
large map or array. Merging tiles gives what folding the attempts directly would give.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.config import DAY_MS, HOUR_MS, KINDS, MINUTE_MS, SMALL_AMOUNT_PAISE
from cardwatch.functions.numeric import count_true, decay, ratio
from cardwatch.functions.timeline import burstiness, fold_gaps, trailing_sum
from cardwatch.operators.features import ENTITY, stack_kinds

SUMS = ("attempts", "failures", "captures", "gateway_failures", "infra_failures", "small_amounts", "amount_sum_paise", "amounts")


def _minute(df: DataFrame) -> DataFrame:
    return df.withColumn("minute_ms", F.expr(f"(at_ms div {MINUTE_MS}) * {MINUTE_MS}"))


def tile_parts() -> dict[str, Column]:
    """What one attempt adds to each sum of its tile."""
    failed = F.col("outcome") == "failed"
    blamed = F.coalesce(F.col("error_source"), F.lit(""))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    return {
        "attempts": F.lit(1).cast("bigint"),
        "failures": one(failed),
        "captures": one(F.col("outcome") == "captured"),
        "gateway_failures": one(failed & (blamed == "gateway")),
        "infra_failures": one(failed & blamed.isin("gateway", "bank")),
        "small_amounts": one(F.col("amount_paise") <= SMALL_AMOUNT_PAISE),
        "amount_sum_paise": F.coalesce(F.col("amount_paise"), F.lit(0)).cast("bigint"),
        "amounts": one(F.col("amount_paise").isNotNull()),
    }


def tile_measures() -> list:
    """Aggregates of one tile; shared by the batch and the streaming job."""
    return [F.sum(part).alias(name) for name, part in tile_parts().items()]


def tileize(attempts: DataFrame, kinds: Sequence[str] = KINDS, *, sketches: bool = True) -> DataFrame:
    """Tiles: sums, first and last time, squared gaps inside the minute, and card sketches."""
    entities = _minute(stack_kinds(attempts, kinds))
    measures = [*tile_measures(), F.array_sort(F.collect_set("at_ms")).alias("times")]
    if sketches:
        measures += [F.hll_sketch_agg(c, 12).alias(f"{c}_sketch") for c in ("card_id", "session", "network")]
    tiles = entities.groupBy(*ENTITY, "minute_ms").agg(*measures)
    return (
        tiles.withColumn("first_ms", F.element_at("times", 1))
        .withColumn("last_ms", F.element_at("times", -1))
        .withColumn(
            "gap_squares",
            F.expr("aggregate(transform(times, (t, i) -> if(i = 0, 0D, power(t - times[i - 1], 2))), 0D, (a, x) -> a + x)"),
        )
        .drop("times")
    )


def tile_values(attempts: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Per (entity, minute): order states and decline reasons, one row per value."""
    failed = F.col("outcome") == "failed"
    facets = F.array_compact(
        F.array(
            F.struct(F.lit("order").alias("facet"), F.coalesce("order_id", F.lit("")).alias("value")),
            F.when(failed, F.struct(F.lit("reason").alias("facet"), F.coalesce("error_reason", F.lit("unknown")).alias("value"))),
        )
    )
    rows = _minute(stack_kinds(attempts, kinds)).select(
        *ENTITY, "minute_ms", failed.cast("int").alias("failed"),
        (F.col("outcome") == "captured").cast("int").alias("settled"), F.inline(facets),
    )
    return rows.groupBy(*ENTITY, "minute_ms", "facet", "value").agg(
        F.count(F.lit(1)).alias("n"), F.max("failed").alias("failed"), F.max("settled").alias("settled")
    )


def merge_tiles(tiles: DataFrame, values: DataFrame) -> DataFrame:
    """One row per entity over all given tiles."""
    by_value = values.groupBy(*ENTITY, "facet", "value").agg(
        F.sum("n").alias("n"), F.max("failed").alias("failed"), F.max("settled").alias("settled")
    )
    order = F.col("facet") == "order"
    n = F.when(F.col("facet") == "reason", F.col("n"))
    details = by_value.groupBy(*ENTITY).agg(
        count_true(order).alias("orders"),
        count_true(order & (F.col("failed") == 1) & (F.col("settled") == 1)).alias("recovered_orders"),
        ratio(F.sum(n * n), F.sum(n) * F.sum(n)).alias("reason_concentration"),
    )
    sketches = [c for c in tiles.columns if c.endswith("_sketch")]
    sums = tiles.groupBy(*ENTITY).agg(
        F.min("minute_ms").alias("minute_ms"), *[F.sum(c).alias(c) for c in SUMS], *[F.hll_union_agg(c).alias(c) for c in sketches]
    )
    parts = tiles.select(*ENTITY, F.col("first_ms").alias("first"), F.col("last_ms").alias("last"), F.col("gap_squares").alias("squares"), F.col("attempts").alias("n"))
    gaps = fold_gaps(parts, ENTITY).select(*ENTITY, burstiness(F.col("n"), F.col("first"), F.col("last"), F.col("squares")).alias("burstiness"))
    return sums.join(gaps, list(ENTITY)).join(details, list(ENTITY), "left")


def decayed_from_tiles(tiles: DataFrame, field: str, *, as_of_ms: int, half_life_ms: int) -> DataFrame:
    """Decayed count from minute midpoints; minutes whose midpoint lies ahead are skipped."""
    age = F.lit(as_of_ms) - (F.col("minute_ms") + MINUTE_MS // 2)
    weighted = F.when(age >= 0, F.col(field) * decay(age, half_life_ms)).otherwise(0.0)
    return tiles.groupBy(*ENTITY).agg(F.sum(weighted).alias(f"decayed_{field}"))


def sliding(tiles: DataFrame, *, span_ms: int) -> DataFrame:
    """Sums over the trailing span at every minute with activity, from tiles, not events."""
    totals = trailing_sum(tiles, ENTITY, "minute_ms", span_ms, ["attempts", "failures", "captures"])
    return totals.withColumn("approval_rate", ratio(F.col("captures"), F.col("attempts")))


# --- hierarchy ----------------------------------------------------------------------------------------

#: Spans of tiles; each is a whole number of the one before.
SPANS = (MINUTE_MS, HOUR_MS, DAY_MS)


def tile_levels(tiles: DataFrame, *, half_life_ms: int, fields: Sequence[str] = ("attempts", "failures", "captures")) -> DataFrame:
    """Tiles of a minute, an hour and a day: span_ms, start_ms, sums, and the decayed sum of each field as of the tile's end.

    A decayed sum is carried forward by one factor for the whole tile, so tiles of any span add up; anchored at its own end no factor exceeds one,
    however long the history. Hours are made of minutes and days of hours.
    """
    span, found = SPANS[0], []
    level = tiles.select(
        *ENTITY, F.col("minute_ms").alias("start_ms"), *SUMS,
        *[(F.col(f) * decay(F.lit(MINUTE_MS // 2), half_life_ms)).alias(f"decayed_{f}") for f in fields],
    )
    for wider in (*SPANS[1:], None):
        found.append(level.select(*ENTITY, F.lit(span).cast("bigint").alias("span_ms"), "start_ms", *SUMS, *[f"decayed_{f}" for f in fields]))
        if wider is None:
            break
        whole = F.expr(f"start_ms div {wider} * {wider}")
        rest = whole + wider - (F.col("start_ms") + span)  # from the end of the small tile to that of the wide one
        carried = [F.sum(F.col(f"decayed_{f}") * decay(rest, half_life_ms)).alias(f"decayed_{f}") for f in fields]
        level = level.groupBy(*ENTITY, whole.alias("start_ms")).agg(*[F.sum(c).alias(c) for c in SUMS], *carried)
        span = wider
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def cover(from_ms: int, to_ms: int) -> list[tuple[int, int, int]]:
    """Stretches (span, from, to) of whole tiles that make up [from, to), both whole minutes: minutes and hours at the edges, days in between."""
    if from_ms % SPANS[0] or to_ms % SPANS[0] or to_ms < from_ms:
        raise ValueError("a window of tiles begins and ends at whole minutes")
    found, low, high = [], from_ms, to_ms
    for span, wider in zip(SPANS, (*SPANS[1:], None), strict=True):
        inner_low, inner_high = (-(-low // wider) * wider, high // wider * wider) if wider else (high, high)
        if inner_low >= inner_high:
            inner_low = inner_high = high
        found += [(span, a, b) for a, b in ((low, inner_low), (inner_high, high)) if a < b]
        low, high = inner_low, inner_high
    return found


def window_sums(levels: DataFrame, *, from_ms: int, to_ms: int, half_life_ms: int, fields: Sequence[str] = ("attempts", "failures", "captures")) -> DataFrame:
    """Sums over [from, to) per entity and decayed sums as of its end, from a logarithmic number of tiles each (``tiles_read``)."""
    wanted = F.lit(False)
    for span, low, high in cover(from_ms, to_ms):
        wanted |= (F.col("span_ms") == span) & (F.col("start_ms") >= low) & (F.col("start_ms") < high)
    age = F.lit(to_ms) - (F.col("start_ms") + F.col("span_ms"))
    return levels.filter(wanted).groupBy(*ENTITY).agg(
        *[F.sum(c).alias(c) for c in SUMS],
        *[F.sum(F.col(f"decayed_{f}") * decay(age, half_life_ms)).alias(f"decayed_{f}") for f in fields],
        F.count(F.lit(1)).alias("tiles_read"),
    )
