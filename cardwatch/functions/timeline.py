"""Ordered computations over long timelines, in bounded pieces.

A window over all rows of one key would sort a hot key in one task. Here every timeline is cut
into minutes: inside a minute a key has at most 60 000 distinct milliseconds, and what crosses
minutes is carried by one row per (key, minute).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.session import stage

MINUTE = "_minute"


def _by_minute(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(MINUTE, F.expr(f"`{time}` div 60000"))


def running_total(deltas: DataFrame, keys: Sequence[str], time: str, measures: Sequence[str]) -> DataFrame:
    """Sum of each measure over all rows of the key with time <= t, for every t that occurs."""
    keys = list(keys)
    ticks = _by_minute(deltas.groupBy(*keys, time).agg(*[F.sum(m).alias(m) for m in measures]), time)
    minutes = ticks.groupBy(*keys, MINUTE).agg(*[F.sum(m).alias(m) for m in measures])
    earlier = W.partitionBy(*keys).orderBy(MINUTE).rowsBetween(W.unboundedPreceding, -1)
    base = minutes.select(*keys, MINUTE, *[F.sum(m).over(earlier).alias(f"_base_{m}") for m in measures])
    inside = W.partitionBy(*keys, MINUTE).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ticks.join(base, [*keys, MINUTE]).select(
        *keys, time, *[(F.coalesce(F.col(f"_base_{m}"), F.lit(0)) + F.sum(m).over(inside)).alias(m) for m in measures]
    )


def cumulated(rows: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], *, pieces: int = 256) -> DataFrame:
    """Sum of each measure per distinct value of the key, and over all values up to it (``cum_`` columns).

    Works on any ordered column, exactly: approximate quantiles only decide where the values are cut into pieces,
    which are ordered apart and carried over. Equal values are counted first, so one value may hold any number of rows.
    """
    keys = list(keys)
    counted = stage(rows.groupBy(*keys, value).agg(*[F.sum(m).alias(m) for m in measures]), "cumulated")
    cuts = stage(counted.groupBy(*keys).agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 10_000).alias("_cuts")), "cuts")
    placed = counted.join(cuts, keys).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = placed.groupBy(*keys, "_piece").agg(*[F.sum(m).alias(m) for m in measures])
    earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(*keys, "_piece", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_base_{m}") for m in measures])
    inside = W.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return placed.join(base, [*keys, "_piece"]).select(
        *keys, value, *measures, *[(F.col(f"_base_{m}") + F.sum(m).over(inside)).alias(f"cum_{m}") for m in measures]
    )


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per key the value at each rank (a function of the number of rows), without ordering the rows."""
    keys = list(keys)
    ordered = stage(cumulated(rows.filter(F.col(value).isNotNull()).withColumn("_n", F.lit(1).cast("bigint")), keys, value, ["_n"]), "ordered")
    totals = stage(ordered.groupBy(*keys).agg(F.sum("_n").alias("_all")), "totals")
    reached = lambda rank: F.min(F.when(F.col("cum__n") >= rank(F.col("_all")), F.col(value)))
    return ordered.join(totals, keys).groupBy(*keys).agg(*[reached(rank).alias(name) for name, rank in ranks.items()])


def join_gaps(parts: DataFrame, within: Sequence[str], n: str = "n") -> DataFrame:
    """Parts of a timeline (first, last, sum of squared gaps inside, number of rows) joined into one, with the gaps between them."""
    before = F.lag("last").over(W.partitionBy(*within).orderBy("first"))
    squared = F.coalesce(F.pow(F.col("first") - before, F.lit(2.0)), F.lit(0.0))
    return parts.withColumn("squares", F.col("squares") + squared).groupBy(*within).agg(
        F.sum(n).alias(n), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("squares").alias("squares")
    )


def fold_gaps(parts: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """Parts of a key's timeline joined into one row per key.

    Parts of a day are joined first (a day has at most 1 440 minutes), then the days, so no list of a key's parts is ever built.
    """
    keys = list(keys)
    return join_gaps(join_gaps(parts.withColumn("_day", F.expr("first div 86400000")), [*keys, "_day"], n), keys, n)


def burstiness(n: Column, first: Column, last: Column, squares: Column) -> Column:
    """Coefficient of variation of the gaps between n moments."""
    gaps, span = n - 1, last - first
    mean = F.try_divide(span.cast("double"), gaps)
    spread = F.sqrt(F.greatest(F.try_divide(squares, gaps) - mean * mean, F.lit(0.0)))
    return F.when((n < 3) | (span == 0), 0.0).otherwise(F.try_divide(spread, mean))


def trailing_sum(rows: DataFrame, keys: Sequence[str], time: str, span_ms: int, measures: Sequence[str]) -> DataFrame:
    """Sum of each measure over [t - span, t], for every time t at which the key has a row."""
    keys = list(keys)
    ticks = rows.groupBy(*keys, time).agg(*[F.sum(m).alias(m) for m in measures])
    steps = F.array(
        F.struct(F.col(time).alias("t"), *[F.col(m).alias(m) for m in measures]),
        F.struct((F.col(time) + span_ms + 1).alias("t"), *[(-F.col(m)).alias(m) for m in measures]),
    )
    deltas = ticks.select(*keys, F.inline(steps)).withColumnRenamed("t", time)
    totals = running_total(deltas, keys, time, measures)
    return totals.join(ticks.select(*keys, time), [*keys, time], "left_semi")


def next_time(ticks: DataFrame, keys: Sequence[str], time: str, alias: str) -> DataFrame:
    """Each distinct time of a key with the key's next distinct time."""
    keys = list(keys)
    rows = _by_minute(ticks.select(*keys, time).distinct(), time)
    minutes = rows.groupBy(*keys, MINUTE).agg(F.min(time).alias("_first"))
    after = W.partitionBy(*keys).orderBy(MINUTE)
    edges = minutes.select(*keys, MINUTE, F.lead("_first").over(after).alias("_later"))
    inside = W.partitionBy(*keys, MINUTE).orderBy(time)
    return rows.withColumn("_next", F.lead(time).over(inside)).join(edges, [*keys, MINUTE]).select(
        *keys, time, F.coalesce("_next", "_later").alias(alias)
    )


def trailing_distinct(
    rows: DataFrame, keys: Sequence[str], value: str, time: str, span_ms: int, alias: str
) -> DataFrame:
    """Distinct values over [t - span, t] per key, for every time t at which the key has a row.

    A value adds one when it appears and takes it back when it appears next or when the span
    has passed, whichever comes first, so no set of values is ever built.
    """
    keys = list(keys)
    seen = next_time(rows.filter(F.col(value).isNotNull()), [*keys, value], time, "_next")
    leaves = F.least(F.coalesce(F.col("_next"), F.col(time) + span_ms + 1), F.col(time) + span_ms + 1)
    steps = F.array(
        F.struct(F.col(time).alias("t"), F.lit(1).cast("bigint").alias(alias)),
        F.struct(leaves.alias("t"), F.lit(-1).cast("bigint").alias(alias)),
    )
    deltas = seen.select(*keys, F.inline(steps)).withColumnRenamed("t", time)
    times = rows.select(*keys, time).distinct()
    zero = times.withColumn(alias, F.lit(0).cast("bigint"))
    totals = running_total(deltas.unionByName(zero), keys, time, [alias])
    return totals.join(times, [*keys, time], "left_semi")


def as_of(times: DataFrame, log: DataFrame, keys: Sequence[str], time: str, state: str, order: Sequence[str] = ()) -> DataFrame:
    """Latest state of the log at or before each distinct time, per key (NULL before the first)."""
    keys = list(keys)
    last = F.max_by(state, F.struct(*order)) if order else F.max(state)
    changes = log.groupBy(*keys, time).agg(last.alias(state))
    grid = _by_minute(
        times.select(*keys, time)
        .distinct()
        .withColumn(state, F.lit(None).cast(changes.schema[state].dataType))
        .unionByName(changes.select(*keys, time, state))
        .groupBy(*keys, time)
        .agg(F.max(state).alias(state)),
        time,
    )
    minutes = grid.groupBy(*keys, MINUTE).agg(F.max_by(state, F.when(F.col(state).isNotNull(), F.col(time))).alias("_last"))
    earlier = W.partitionBy(*keys).orderBy(MINUTE).rowsBetween(W.unboundedPreceding, -1)
    carried = minutes.select(*keys, MINUTE, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    inside = W.partitionBy(*keys, MINUTE).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = grid.join(carried, [*keys, MINUTE]).select(
        *keys, time, F.coalesce(F.last(state, ignorenulls=True).over(inside), F.col("_carried")).alias(state)
    )
    return filled.join(times.select(*keys, time).distinct(), [*keys, time], "left_semi")
