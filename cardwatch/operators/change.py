"""Change detection over dense per-bucket counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.config import MINUTE_MS, ChangeOptions
from cardwatch.functions.numeric import half_up


def bucket_series(events: DataFrame, *, from_ms: int, to_ms: int, bucket_ms: int = MINUTE_MS, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Counts per bucket over [from, to), including the empty buckets of every key."""
    n_buckets = max(0, -(-(to_ms - from_ms) // bucket_ms))
    keys = list(keys)
    counts = (
        events.filter((F.col("at_ms") >= from_ms) & (F.col("at_ms") < to_ms))
        .groupBy(*keys, F.expr(f"(at_ms - {from_ms}) div {bucket_ms}").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spine = counts.select(*keys).distinct().withColumn(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_buckets - 1).cast("bigint")))
    )
    return spine.join(counts, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def series_from_counts(counts: DataFrame, *, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """Counts per key and bucket (from 0) with the empty buckets of every key, up to the newest bucket of any."""
    keys = list(keys)
    last = counts.agg(F.coalesce(F.max("bucket"), F.lit(-1)).alias("m")).first()["m"]
    spine = counts.select(*keys).distinct().withColumn("bucket", F.explode(F.expr(f"if({last} < 0, array(), sequence(0L, {max(last, 0)}L))").cast("array<bigint>")))
    return spine.join(counts, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def _baseline(options: ChangeOptions) -> tuple[Column, Column]:
    warm = F.slice("series", 1, options.warm_up_buckets)
    size = F.size(warm)
    mean = F.aggregate(warm, F.lit(0.0), lambda a, x: a + x) / size
    squares = F.aggregate(warm, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    deviation = F.greatest(F.sqrt(squares / F.greatest(size - 1, F.lit(1))), F.lit(options.minimum_deviation))
    return mean, deviation


def start_of_fold() -> dict:
    """The detector of one series before its first bucket (plain values, for a state store)."""
    return {"i": 0, "last": -1, "warm": [], "ewma_at": None, "ewma_statistic": None, "cusum_at": None, "cusum_statistic": None, "cusum_buckets": None}


def fold_series(state: dict, n: int, options: ChangeOptions) -> dict:
    """The detector behind one more bucket: what ``detect_change`` folds over a whole array, one step of it."""
    s, x = dict(state), float(n)
    i = s["i"]
    s["i"] = i + 1
    if i < options.warm_up_buckets:
        s["warm"] = [*s["warm"], n]
        if i + 1 == options.warm_up_buckets:
            mean = sum(map(float, s["warm"])) / len(s["warm"])
            squares = sum((float(w) - mean) * (float(w) - mean) for w in s["warm"])
            s["mean"], s["deviation"] = mean, max(math.sqrt(squares / max(len(s["warm"]) - 1, 1)), options.minimum_deviation)
            s["ewma"], s["total"], s["since"] = mean, 0.0, 0
        return s
    lam, mean, deviation = options.smoothing, s["mean"], s["deviation"]
    rounded = lambda v: math.floor(v * 1000 + 0.5) / 1000
    excess = x - mean - options.slack * deviation
    s["since"] = i if s["total"] == 0 and excess > 0 else s["since"]
    s["ewma"], s["total"] = lam * x + (1 - lam) * s["ewma"], max(0.0, s["total"] + excess)
    if s["ewma_at"] is None and s["ewma"] - mean > options.control_limit * deviation * math.sqrt(lam / (2 - lam)):
        s["ewma_at"], s["ewma_statistic"] = i, rounded(s["ewma"] - mean)
    if s["cusum_at"] is None and s["total"] > options.decision_interval * deviation:
        s["cusum_at"], s["cusum_statistic"], s["cusum_buckets"] = i, rounded(s["total"]), i - s["since"] + 1
    return s


def limits_of(folded: DataFrame, options: ChangeOptions, *, buckets: int) -> DataFrame:
    """Folded series (``warm`` counts and alarms) with their limits, read as ``buckets`` long: what is missing at the end is empty."""
    size = min(options.warm_up_buckets, buckets)
    padded = F.concat("warm", F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(size) - F.size("warm"), F.lit(0)).cast("int")))
    rows = folded.withColumn("series", F.transform(padded, lambda n: n.cast("double")))
    mean, deviation = _baseline(options)
    return _with_limits(rows.withColumn("mean", mean).withColumn("deviation", deviation), options).select(
        *[c for c in folded.columns if c not in ("warm", "last_bucket", "batch", "ewma_at", "ewma_statistic", "cusum_at", "cusum_statistic", "cusum_buckets")],
        "mean", "deviation", "ewma_limit", "cusum_limit",
        F.col("ewma_at").isNotNull().alias("ewma_fired"), "ewma_at", F.coalesce("ewma_statistic", F.lit(0.0)).alias("ewma_statistic"),
        F.col("cusum_at").isNotNull().alias("cusum_fired"), "cusum_at", F.coalesce("cusum_statistic", F.lit(0.0)).alias("cusum_statistic"),
        F.coalesce("cusum_buckets", F.lit(0)).alias("cusum_buckets"),
    )


def _with_limits(based: DataFrame, options: ChangeOptions) -> DataFrame:
    lam = options.smoothing
    return (
        based.withColumn("ewma_limit", options.control_limit * F.col("deviation") * F.sqrt(F.lit(lam / (2 - lam))))
        .withColumn("cusum_limit", options.decision_interval * F.col("deviation"))
        .withColumn("slack", options.slack * F.col("deviation"))
    )


def detect_change(series: DataFrame, options: ChangeOptions = ChangeOptions(), *, keys: Sequence[str] = ("scope",)) -> DataFrame:
    """First EWMA and first CUSUM alarm of each series; no alarm on series no longer than the warm-up.

    A series has one number per bucket of its time range, however many events there were, so
    it is folded as an array inside one expression.
    """
    keys = list(keys)
    arrays = series.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("points"))
    arrays = arrays.select(*keys, F.transform("points", lambda p: p["n"].cast("double")).alias("series"))
    mean, deviation = _baseline(options)
    based = arrays.withColumn("mean", mean).withColumn("deviation", deviation)
    lam = options.smoothing
    sized = _with_limits(based, options)
    tail = F.slice("series", options.warm_up_buckets + 1, F.greatest(F.size("series") - options.warm_up_buckets, F.lit(0)))
    none_int, none_dbl = F.lit(None).cast("int"), F.lit(None).cast("double")
    start = F.struct(
        F.lit(options.warm_up_buckets).alias("i"),
        F.col("mean").alias("ewma"),
        F.lit(0.0).alias("total"),
        F.lit(0).alias("since"),
        none_int.alias("ewma_at"),
        none_dbl.alias("ewma_statistic"),
        none_int.alias("cusum_at"),
        none_dbl.alias("cusum_statistic"),
        none_int.alias("cusum_buckets"),
    )

    def step(s: Column, x: Column) -> Column:
        ewma = lam * x + (1 - lam) * s["ewma"]
        excess = x - F.col("mean") - F.col("slack")
        since = F.when((s["total"] == 0) & (excess > 0), s["i"]).otherwise(s["since"])
        total = F.greatest(F.lit(0.0), s["total"] + excess)
        ewma_new = s["ewma_at"].isNull() & (ewma - F.col("mean") > F.col("ewma_limit"))
        cusum_new = s["cusum_at"].isNull() & (total > F.col("cusum_limit"))
        return F.struct(
            (s["i"] + 1).alias("i"),
            ewma.alias("ewma"),
            total.alias("total"),
            since.alias("since"),
            F.when(ewma_new, s["i"]).otherwise(s["ewma_at"]).alias("ewma_at"),
            F.when(ewma_new, half_up(ewma - F.col("mean"))).otherwise(s["ewma_statistic"]).alias("ewma_statistic"),
            F.when(cusum_new, s["i"]).otherwise(s["cusum_at"]).alias("cusum_at"),
            F.when(cusum_new, half_up(total)).otherwise(s["cusum_statistic"]).alias("cusum_statistic"),
            F.when(cusum_new, s["i"] - since + 1).otherwise(s["cusum_buckets"]).alias("cusum_buckets"),
        )

    folded = sized.withColumn("alarm", F.aggregate(tail, start, step))
    return folded.select(
        *keys,
        "mean",
        "deviation",
        "ewma_limit",
        "cusum_limit",
        F.size("series").alias("buckets"),
        F.col("alarm.ewma_at").isNotNull().alias("ewma_fired"),
        F.col("alarm.ewma_at").alias("ewma_at"),
        F.coalesce(F.col("alarm.ewma_statistic"), F.lit(0.0)).alias("ewma_statistic"),
        F.col("alarm.cusum_at").isNotNull().alias("cusum_fired"),
        F.col("alarm.cusum_at").alias("cusum_at"),
        F.coalesce(F.col("alarm.cusum_statistic"), F.lit(0.0)).alias("cusum_statistic"),
        F.coalesce(F.col("alarm.cusum_buckets"), F.lit(0)).alias("cusum_buckets"),
    )
