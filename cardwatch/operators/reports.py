"""Console reports: overview, trend, queues, ingestion, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.config import DAY_MS, HOUR_MS
from cardwatch.functions.numeric import count_true, ratio
from cardwatch.functions.timeline import running_total
from cardwatch.functions.views import risk_bucket, severity_rank
from cardwatch.operators.features import exact_ranks

STATUSES = ("open", "under_review", "contained", "resolved", "expired")


def status_counts(incidents: DataFrame) -> DataFrame:
    """Incidents by status, one row per scope, one column per status."""
    return incidents.groupBy("scope").agg(
        F.count(F.lit(1)).alias("total"), *[count_true(F.col("status") == s).alias(s) for s in STATUSES]
    )


def severity_tiles(incidents: DataFrame) -> DataFrame:
    """Live incidents by risk bucket; resolved ones apart, expired ones only in the total."""
    bucket = risk_bucket(F.col("severity"), F.col("score"))
    tile = F.when(F.col("status") == "resolved", "resolved").when(F.col("status") != "expired", bucket)
    names = ("critical", "high", "medium", "low", "resolved")
    counted = incidents.withColumn("tile", tile).groupBy("scope").agg(
        F.count(F.lit(1)).alias("total"), *[count_true(F.col("tile") == n).alias(n) for n in names]
    )
    return counted.select("*", *[ratio(F.col(n), F.col("total")).alias(f"{n}_share") for n in names])


def overview_kpis(attempts: DataFrame, incidents: DataFrame, *, now_ms: int, window_ms: int) -> DataFrame:
    """Attempts of the trailing window against the one before, and the state of open incidents."""
    start, prior = now_ms - window_ms, now_ms - 2 * window_ms
    at, status = F.col("first_ms"), F.col("status")
    current = at >= start
    volumes = attempts.filter(at >= prior).groupBy("scope").agg(
        count_true(current).alias("attempts"),
        count_true(~current).alias("prior_attempts"),
        count_true(current & (status == "captured")).alias("captured"),
        count_true(current & (status == "failed")).alias("failed"),
    )
    waiting = F.col("status").isin("open", "under_review")
    worst = F.max(F.when(waiting, severity_rank(F.col("severity"))))
    state = incidents.groupBy("scope").agg(
        count_true(waiting).alias("active_incidents"),
        count_true(F.col("status") == "under_review").alias("under_review"),
        count_true(F.col("status") == "contained").alias("contained"),
        count_true(F.col("status") == "resolved").alias("resolved"),
        F.count(F.lit(1)).alias("total_incidents"),
        F.max(F.when(waiting, F.col("score"))).alias("risk"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), worst + 1).alias("risk_level"),
    )
    change = F.try_divide((F.col("attempts") - F.col("prior_attempts")).cast("double"), F.col("prior_attempts"))
    # a scope with incidents and no recent attempts counts too, and the other way round
    counts = ["attempts", "prior_attempts", "captured", "failed", "active_incidents", "under_review", "contained", "resolved", "total_incidents"]
    return volumes.join(state, "scope", "full_outer").fillna(0, counts).select(
        "*", change.alias("attempts_delta"), F.greatest(F.col("attempts") - F.col("failed"), F.lit(0)).alias("safe")
    )


def top_reasons(incidents: DataFrame, *, limit: int = 5) -> DataFrame:
    """Most frequent incident titles."""
    return incidents.groupBy("title").agg(F.count(F.lit(1)).alias("incidents")).orderBy(F.desc("incidents"), "title").limit(limit)


def risk_trend(attempts: DataFrame, incidents: DataFrame, *, now_ms: int, window_ms: int, keep: int | None = None) -> DataFrame:
    """Dense buckets (hourly up to a day, else daily): attempts, failures, incidents, worst score.

    All buckets of the window, or the ``keep`` newest; every scope that has attempts or incidents in it.
    """
    bucket = HOUR_MS if window_ms <= DAY_MS else DAY_MS
    start = now_ms - window_ms
    first, last = start // bucket * bucket, now_ms // bucket * bucket
    floor_to = lambda c: F.expr(f"({c} div {bucket}) * {bucket}").alias("bucket_ms")
    tried = attempts.filter(F.col("first_ms") >= start).groupBy("scope", floor_to("first_ms")).agg(
        F.count(F.lit(1)).alias("events"), count_true(F.col("status") == "failed").alias("failures")
    )
    raised = incidents.filter(F.col("detected_ms") >= start).groupBy("scope", floor_to("detected_ms")).agg(
        F.count(F.lit(1)).alias("incidents"), F.max("score").alias("risk")
    )
    from_ms = first if keep is None else max(first, last - (keep - 1) * bucket)
    spine = tried.select("scope").unionByName(raised.select("scope")).distinct().withColumn(
        "bucket_ms", F.explode(F.sequence(F.lit(from_ms), F.lit(last), F.lit(bucket)))
    )
    zero = F.lit(0).cast("bigint")
    return spine.join(tried, ["scope", "bucket_ms"], "left").join(raised, ["scope", "bucket_ms"], "left").select(
        "scope", "bucket_ms", *[F.coalesce(c, zero).alias(c) for c in ("events", "failures", "incidents")],
        F.coalesce("risk", F.lit(0.0)).alias("risk"),
    )


def trend_blocks(trend: DataFrame, *, blocks: int = 8) -> DataFrame:
    """The trend folded into at most ``blocks`` equal blocks (the trend is already short)."""
    scope = W.partitionBy("scope")
    index = F.row_number().over(scope.orderBy("bucket_ms")) - 1
    size = F.ceil(F.count(F.lit(1)).over(scope) / blocks)
    step = F.lead("bucket_ms").over(scope.orderBy("bucket_ms")) - F.col("bucket_ms")
    cut = trend.withColumn("block", F.floor(index / size).cast("int")).withColumn("step", step)
    spans = cut.withColumn("step", F.min("step").over(scope))
    return spans.groupBy("scope", "block").agg(
        F.min("bucket_ms").alias("from_ms"),
        (F.max("bucket_ms") + F.coalesce(F.max("step"), F.lit(HOUR_MS))).alias("to_ms"),
        F.sum("events").alias("attempts"),
        F.sum("failures").alias("failed"),
        F.sum("incidents").alias("incidents"),
        F.max("risk").alias("risk"),
    )


def trend_incidents(blocks: DataFrame, incidents: DataFrame, *, bucket_ms: int) -> DataFrame:
    """Incidents per chart block: blocks are spread over their buckets and matched by bucket."""
    covered = blocks.select("scope", "block", F.explode(F.expr(f"sequence(from_ms, to_ms - {bucket_ms}, {bucket_ms})")).alias("bucket_ms"))
    placed = incidents.withColumn("bucket_ms", F.expr(f"(detected_ms div {bucket_ms}) * {bucket_ms}"))
    return placed.join(covered, ["scope", "bucket_ms"]).select("scope", "block", "incident_id", "detected_ms")


def burst_shape(trend: DataFrame) -> DataFrame:
    """One burst, a few busy periods, or spread out: from the longest contiguous busy run."""
    scope = W.partitionBy("scope")
    by_time = scope.orderBy("bucket_ms")
    rows = trend.withColumn("i", F.row_number().over(by_time)).withColumn("peak", F.max("events").over(scope))
    rows = rows.withColumn("busy", (F.col("events") > 0) & (F.col("events") >= F.col("peak") / 2))
    rows = rows.withColumn("run", F.col("i") - F.sum(F.col("busy").cast("int")).over(by_time))
    totals = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("periods"), count_true(F.col("events") > 0).alias("active"),
        F.sum("events").alias("events"), count_true(F.col("busy")).alias("spikes"),
    )
    runs = rows.filter("busy").groupBy("scope", "run").agg(
        F.count(F.lit(1)).alias("length"), F.min("bucket_ms").alias("from_ms"), F.max("bucket_ms").alias("to_ms"), F.sum("events").alias("run_events")
    )
    longest = runs.groupBy("scope").agg(
        F.max_by(F.struct("length", "from_ms", "to_ms", "run_events"), F.struct("length", -F.col("from_ms"))).alias("r")
    )
    out = totals.join(longest, "scope", "left")
    share = ratio(F.col("r.run_events"), F.col("events"))
    return out.select(
        "scope",
        F.when(F.col("active") == 0, "empty")
        .when((F.col("r.length") <= 3) & (share >= 0.6), "one_burst")
        .when((F.col("spikes") > F.col("r.length")) & (F.col("spikes") <= 6), "busy_periods")
        .otherwise("spread")
        .alias("shape"),
        F.col("r.from_ms").alias("run_from_ms"), F.col("r.to_ms").alias("run_to_ms"), F.col("r.length").alias("run_length"),
        "spikes", "active", "periods",
    )


def prior_period(attempts: DataFrame, *, period_ms: int = DAY_MS) -> DataFrame:
    """Attempts per period next to the period before it."""
    counts = attempts.groupBy("scope", F.expr(f"first_ms div {period_ms}").alias("period")).agg(
        F.count(F.lit(1)).alias("attempts"), count_true(F.col("status") == "failed").alias("failed")
    )
    before = counts.select("scope", (F.col("period") + 1).alias("period"), F.col("attempts").alias("prior_attempts"))
    joined = counts.join(before, ["scope", "period"], "left")
    return joined.withColumn("delta", F.try_divide((F.col("attempts") - F.col("prior_attempts")).cast("double"), F.col("prior_attempts")))


def ingestion_metrics(inbox: DataFrame, *, now_ms: int, rate_minutes: int = 5) -> DataFrame:
    """Delivery health in one aggregate: volumes, duplicates, backlog, lateness, speed."""
    took = F.greatest(F.col("processed_ms") - F.col("received_ms"), F.lit(0))
    pending = F.col("status") == "pending"
    sums = inbox.groupBy("scope").agg(
        count_true(F.col("source") == "live").alias("events_stored"),
        count_true(F.col("source") == "replay").alias("replayed_events"),
        F.sum(F.col("delivery_count") - 1).alias("duplicate_deliveries"),
        count_true(pending).alias("pending_depth"),
        count_true(F.col("status") == "dead").alias("dead_depth"),
        count_true(F.col("late")).alias("late_events"),
        count_true(F.col("received_ms") >= now_ms - rate_minutes * 60_000).alias("recent"),
        F.max("received_ms").alias("last_received_ms"),
        F.min(F.when(pending, F.col("received_ms"))).alias("oldest_pending_ms"),
        F.avg(took).alias("mean_processing_ms"),
        F.max("at_ms").alias("newest_event_ms"),
    )
    return sums.select(
        "*",
        ratio(F.col("duplicate_deliveries"), F.col("events_stored") + F.col("duplicate_deliveries")).alias("duplicate_rate"),
        (F.col("recent") / rate_minutes).alias("events_per_minute"),
        (F.lit(now_ms) - F.col("oldest_pending_ms")).alias("oldest_pending_age_ms"),
    ).drop("recent")


# The reported latency percentiles.
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999, "worst": 1.0}


def latency_percentiles(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Nearest-rank percentiles of an integer column, exact at any size."""
    rank = lambda p: (lambda n: F.greatest(F.ceil(n * F.lit(p)), F.lit(1)))
    return exact_ranks(samples, keys, value, {name: rank(p) for name, p in PERCENTILES.items()})


def incident_filter(*, tab: str = "all", bucket: str = "all", search: str = "") -> Column:
    """Filter of the incident list: status tab, risk bucket, free text."""
    keep = F.lit(True)
    if tab == "active":
        keep &= F.col("status").isin("open", "contained")
    elif tab == "history":
        keep &= F.lit(False)
    elif tab != "all":
        keep &= F.col("status") == tab
    if bucket != "all":
        keep &= risk_bucket(F.col("severity"), F.col("score")) == bucket
    term = search.strip().lower()
    if term:
        keep &= F.contains(F.lower(F.concat_ws("\n", "title", "incident_id", "entity_key")), F.lit(term))
    return keep


def sort_incidents(incidents: DataFrame, order: str = "newest") -> DataFrame:
    first = {"risk": F.desc("score"), "oldest": F.asc("detected_ms")}.get(order, F.desc("detected_ms"))
    return incidents.orderBy(first, "incident_id")


def notifications(incidents: DataFrame, prefs: DataFrame) -> DataFrame:
    """Per user: incidents their preferences ring for, and how many they have not seen.

    Users are matched to running incident counts per (severity, source), not to incidents.
    """
    zero = F.lit(0).cast("bigint")
    levels = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rank")) for r, s in enumerate(("low", "medium", "high"))])
    wanted = prefs.select(
        "user_id", "seen_ms", "min_severity", "simulated", F.inline(levels)
    ).filter(F.col("rank") >= severity_rank(F.col("min_severity")))
    sources = F.explode(F.when(F.col("simulated"), F.array(F.lit("live"), F.lit("replay"))).otherwise(F.array(F.lit("live"))))
    wanted = wanted.withColumn("source", sources)
    keys = ["severity", "source"]
    ticks = incidents.select(*keys, F.col("detected_ms").alias("t"), F.lit(1).cast("bigint").alias("n"))
    probes = wanted.select(*keys, F.col("seen_ms").alias("t"), zero.alias("n"))
    seen = running_total(ticks.unionByName(probes), keys, "t", ["n"]).withColumnRenamed("n", "seen")
    totals = incidents.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    matched = wanted.withColumn("t", F.col("seen_ms")).join(seen, [*keys, "t"]).join(totals, keys, "left")
    return matched.groupBy("user_id").agg(
        F.sum(F.coalesce("total", zero)).alias("notifiable"), F.sum(F.coalesce("total", zero) - F.col("seen")).alias("unread")
    )


def oldest_waiting(incidents: DataFrame) -> DataFrame:
    """The incident that has waited longest for a person, per scope."""
    waiting = F.col("status").isin("open", "under_review")
    return incidents.filter(waiting).groupBy("scope").agg(
        F.min(F.struct("detected_ms", "incident_id", "severity")).alias("m")
    ).select("scope", "m.*")


def incident_timeline(incidents: DataFrame, entries: DataFrame) -> DataFrame:
    """First attempt, detection and log entries of each incident on one time axis."""
    anchors = incidents.select(
        "incident_id",
        F.inline(
            F.array(
                F.struct(F.col("first_ms").alias("at_ms"), F.lit("first_attempt").alias("entry")),
                F.struct(F.col("detected_ms").alias("at_ms"), F.lit("detected").alias("entry")),
            )
        ),
    )
    return anchors.unionByName(entries.select("incident_id", "at_ms", F.col("kind").alias("entry")))


def captured_value(links: DataFrame, attempts: DataFrame) -> DataFrame:
    """Captured amount of the orders linked to each incident."""
    paid = attempts.filter(F.col("status") == "captured").groupBy("order_id").agg(F.sum("amount_paise").alias("paid"))
    linked = links.filter(F.col("incident_id").isNotNull()).select("incident_id", "order_id").distinct()
    return linked.join(paid, "order_id", "left").groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum("paid"), F.lit(0)).cast("bigint").alias("captured_paise")
    )


# Fixed values. Evidence code -> phrase; %s is the observed value, shown as a whole number, one decimal or percent.
PHRASES = {
    "attempt_rate_above_threshold": ("%s attempts a minute", "one"),
    "distinct_cards_above_threshold": ("%s different cards", "whole"),
    "cards_per_attempt_above_threshold": ("%s%% new cards per attempt", "percent"),
    "distinct_cards_long_span_above_threshold": ("%s different cards over the long span", "whole"),
    "orders_per_card_above_threshold": ("one card on %s orders", "whole"),
    "approval_rate_below_floor": ("%s%% approved", "percent"),
    "decline_reasons_concentrated": ("%s%% decline concentration", "percent"),
    "small_amount_share_above_threshold": ("%s%% tiny amounts", "percent"),
    "inter_arrival_variation_low": ("%s%% gap variation", "percent"),
    "orders_recovered_after_failure": ("%s orders recovered", "whole"),
    "failures_attributed_to_gateway": ("%s%% of failures blamed on the gateway", "percent"),
    "cards_reused_across_attempts": ("%s attempts per card", "one"),
}


def evidence_text(decided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per piece of evidence with its phrase; unknown codes show code and numbers."""
    rows = decided.select(*keys, F.inline("evidence"))
    whole = F.floor(F.col("observed") + 0.5).cast("bigint").cast("string")
    percent = F.floor(F.col("observed") * 100 + 0.5).cast("bigint").cast("string")
    tenths = F.floor(F.col("observed") * 10 + 0.5).cast("bigint")
    one = F.concat_ws(".", F.expr("cast(floor(observed * 10 + 0.5) as bigint) div 10"), tenths % 10)
    shown = {"whole": whole, "percent": percent, "one": one}
    text = None
    for code, (phrase, how) in PHRASES.items():
        before, after = phrase.replace("%%", "%").split("%s")
        said = F.concat(F.lit(before), shown[how], F.lit(after))
        text = F.when(F.col("code") == code, said) if text is None else text.when(F.col("code") == code, said)
    plain = F.concat(F.regexp_replace("code", "_", " "), F.lit(": "), F.col("observed"), F.lit(" against "), F.col("threshold"))
    return rows.withColumn("text", text.otherwise(plain))
