"""Streaming twins of the batch jobs.

Each job takes the caller's state folder and trigger. What it keeps are mergeable rows per batch (first deliveries, partial payments,
counts, evaluations) in state tables, which are compacted as batches go by; its reader merges them into what the batch job would give for the same rows, in whatever
order and however late they came. A batch reads the state of the keys it touches, in the buckets that hold them, and nothing else.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cardwatch.config import DAY_MS, MINUTE_MS, ChangeOptions, FeatureWindow
from cardwatch.operators.attempts import finish_payments, merge_before_and_after, merge_partials, merge_payments, payment_partials
from cardwatch.operators.change import fold_series, start_of_fold, limits_of
from cardwatch.operators.containment import blocked_attempts
from cardwatch.operators.features import ENTITY, stack_kinds
from cardwatch.operators.incidents import cluster_incidents
from cardwatch.operators.tiles import SUMS, tile_parts
from cardwatch.plans.detect import judge
from cardwatch.session import stage
from cardwatch.sources.webhooks import canonicalize, dead_letters, dedup_key, next_attempts, requeue
from cardwatch.streaming.runtime import put, run
from cardwatch.streaming.state import StateTable, added_up, newest_per


# --- deliveries -----------------------------------------------------------------------------------


def dedup(inbox: DataFrame, state: str, *, trigger: dict | None = None) -> StreamingQuery:
    """First delivery of each event. Keys are kept for ever, on the executors' disks (see ``run``), so a repeat is known however late it comes."""
    fresh = dedup_key(inbox).dropDuplicates(["delivery_key"])
    return run(fresh, state, lambda batch, i: put(batch, f"{state}/first", i), trigger=trigger)


def _counts(spark: SparkSession, state: str) -> StateTable:
    merge = lambda rows: rows.groupBy("delivery_key").agg(F.sum("n").alias("n"), F.max("last_ms").alias("last_ms"))
    return StateTable(spark, f"{state}/counts", T._parse_datatype_string("delivery_key string, n bigint, last_ms bigint"), ["delivery_key"], merge)


def delivery_counts(inbox: DataFrame, state: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Deliveries per event: each batch puts its own counts, ``deliveries_now`` adds them up."""
    counts = _counts(inbox.sparkSession, state)

    def step(batch: DataFrame, batch_id: int) -> None:
        counts.put(dedup_key(batch).groupBy("delivery_key").agg(F.count(F.lit(1)).alias("n"), F.max("received_ms").alias("last_ms")), batch_id)

    return run(inbox, state, step, trigger=trigger)


def deliveries_now(spark: SparkSession, state: str) -> DataFrame:
    return _counts(spark, state).now()


_LETTER = "delivery_key string, attempts int, status string, last_error string, last_ms bigint, batch bigint"


def _letters(spark: SparkSession, state: str) -> StateTable:
    return StateTable(spark, f"{state}/letters", T._parse_datatype_string(_LETTER), ["delivery_key"], lambda rows: newest_per(rows, ["delivery_key"]))


def drain(
    inbox: DataFrame,
    state: str,
    *,
    raw: Callable[[], DataFrame] | None = None,
    read: Callable[[DataFrame], DataFrame] = canonicalize,
    limit: int = 5,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Canonical events, once per delivery. A delivery that cannot be read is a letter; it is tried again in every later batch until ``limit`` tries have failed.

    Letters keep a key, a count and a reason code, no text: what is tried again comes from ``raw``, the stored deliveries (without it nothing is). ``read`` turns
    deliveries into canonical rows; what it gives no row for has failed. A letter that is dead stays so until ``requeue_letters`` names it.
    """
    spark, letters = inbox.sparkSession, _letters(inbox.sparkSession, state)
    asked = StateTable(spark, f"{state}/requeue", T._parse_datatype_string("delivery_key string, asked_ms bigint"), ["delivery_key"])

    def step(batch: DataFrame, batch_id: int) -> None:
        now_ms = int(time.time() * 1000)
        known = letters.now(before=batch_id).drop("batch")
        wanted = asked.read().groupBy("delivery_key").agg(F.max("asked_ms").alias("asked_ms"))
        again = known.join(wanted, "delivery_key").filter("status = 'dead' AND asked_ms > last_ms").select("delivery_key")
        open_ = stage(requeue(known, again).filter("status = 'retry'"), "open-letters")
        rows = batch
        if raw is not None:
            stored = dedup_key(raw()).join(open_.select("delivery_key"), "delivery_key", "left_semi").dropDuplicates(["delivery_key"])
            rows = batch.unionByName(stored.select(batch.columns))
        rows = stage(rows, "deliveries")
        canonical = stage(read(rows), "canonical")
        put(canonical, f"{state}/canonical", batch_id)
        reasons = dead_letters(rows).select("delivery_key", "last_error")
        failed = rows.select("delivery_key").join(canonical.select("delivery_key"), "delivery_key", "left_anti").distinct()
        failed = stage(failed.join(reasons, "delivery_key", "left").select("delivery_key", F.coalesce("last_error", F.lit("not_read")).alias("last_error")), "failed")
        counted = next_attempts(failed, open_.join(failed, "delivery_key", "left_semi"), now_ms=now_ms, limit=limit)
        healed = open_.join(failed, "delivery_key", "left_anti") if raw is not None else open_.limit(0)
        done = healed.withColumn("status", F.lit("processed")).withColumn("last_ms", F.lit(now_ms).cast("bigint"))
        letters.put(counted.unionByName(done.select(counted.columns)).withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    return run(dedup_key(inbox).dropDuplicates(["delivery_key"]), state, step, trigger=trigger)


def letters_now(spark: SparkSession, state: str) -> DataFrame:
    """Deliveries that could not be read at first: tries, status (retry, dead, processed), last reason."""
    return _letters(spark, state).now().drop("batch")


def requeue_letters(spark: SparkSession, state: str, keys: DataFrame) -> None:
    """Ask for dead letters to be tried again from the next batch on, with no tries counted."""
    asked = StateTable(spark, f"{state}/requeue", T._parse_datatype_string("delivery_key string, asked_ms bigint"), ["delivery_key"])
    now_ms = int(time.time() * 1000)
    asked.put(keys.select("delivery_key", F.lit(now_ms).cast("long").alias("asked_ms")), now_ms)


def late_flags(events: DataFrame, state: str, *, lateness_ms: int = 5 * MINUTE_MS, trigger: dict | None = None) -> StreamingQuery:
    """Flag late rows against the newest event time of earlier batches; every row is kept.

    The newest time per scope is a state table with one row per scope and unmerged batch.
    """
    like = T.StructType([events.schema["scope"], T.StructField("seen_ms", T.LongType())])
    newest = StateTable(events.sparkSession, f"{state}/newest", like, ["scope"], lambda rows: rows.groupBy("scope").agg(F.max("seen_ms").alias("seen_ms")))

    def step(batch: DataFrame, batch_id: int) -> None:
        marked = batch.join(stage(newest.now(before=batch_id), "newest"), "scope", "left").withColumn(
            "late", F.coalesce(F.col("at_ms") < F.col("seen_ms") - lateness_ms, F.lit(False))
        )
        put(marked.drop("seen_ms"), f"{state}/flagged", batch_id)
        newest.put(batch.groupBy("scope").agg(F.max("at_ms").alias("seen_ms")), batch_id)

    return run(events, state, step, trigger=trigger)


def _rates(spark: SparkSession, state: str) -> StateTable:
    return StateTable(spark, f"{state}/rates", T._parse_datatype_string("scope string, from_ms bigint, events bigint"), ["scope", "from_ms"], added_up(["scope", "from_ms"], ["events"]))


def ingest_rate(inbox: DataFrame, state: str, *, window_ms: int = 5 * MINUTE_MS, trigger: dict | None = None) -> StreamingQuery:
    """Deliveries per window: counts per batch, added up by ``ingest_rates``."""
    rates = _rates(inbox.sparkSession, state)

    def step(batch: DataFrame, batch_id: int) -> None:
        window = F.expr(f"received_ms div {window_ms} * {window_ms}").alias("from_ms")
        rates.put(batch.groupBy("scope", window).agg(F.count(F.lit(1)).alias("events")), batch_id)

    return run(inbox, state, step, trigger=trigger)


def ingest_rates(spark: SparkSession, state: str) -> DataFrame:
    return _rates(spark, state).now()


# --- payments and what is read from them ------------------------------------------------------------

PAYMENT = ("scope", "payment_id", "loose_id")


class PaymentTables:
    """What a stream of observations has said so far.

    ``partials``: partial payments by payment. ``changes``: payments as they were and are, with -1 and +1, by the day of their first event; what
    does not cancel out are the payments as they stand. ``tiles`` and ``values``: the same changes added up per entity and minute, and per value that
    is counted once. A batch moves only the minutes of payments it changes.
    """

    def __init__(self, spark: SparkSession, state: str, observations: T.StructType):
        empty = spark.createDataFrame([], observations)
        partials = payment_partials(empty)
        changes = self._signed(partials, 1).schema
        day = lambda c: F.expr(f"{c} div {DAY_MS}")
        columns = [f.name for f in changes.fields if f.name != "weight"]
        self.partials = StateTable(spark, f"{state}/payments", partials.schema, PAYMENT, merge_partials)
        self.changes = StateTable(spark, f"{state}/changes", changes, PAYMENT, added_up(columns, ["weight"]), bucket=day("at_ms"))
        tile = spark.createDataFrame([], changes)
        self.tiles = StateTable(spark, f"{state}/tiles", tile_changes(tile).schema, [*ENTITY, "minute_ms"], added_up([*ENTITY, "minute_ms"], SUMS), bucket=day("minute_ms"))
        counted = [*ENTITY, "minute_ms", "facet", "value"]
        self.values = StateTable(spark, f"{state}/values", value_changes(tile).schema, counted, added_up(counted, ["n"]), bucket=day("minute_ms"))
        self.clock = StateTable(spark, f"{state}/clock", T._parse_datatype_string("at_ms bigint"), [], lambda rows: rows.agg(F.max("at_ms").alias("at_ms")), bucket=F.lit(0))

    @staticmethod
    def _signed(merged: DataFrame, weight: int) -> DataFrame:
        return finish_payments(merged, "loose_id").withColumn("weight", F.lit(weight).cast("bigint"))

    def step(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Take in a batch; the merged partials of the payments it touches, before and after."""
        own = stage(payment_partials(batch), "batch-payments")
        both = stage(merge_before_and_after(self.partials.read(before=batch_id, touched=own), own), "touched-payments")
        old, new = both.filter("before IS NOT NULL").select(*PAYMENT, "before.*"), both.select(*PAYMENT, "after.*")
        # a payment that is touched has more events than before, so none of these rows cancel out
        changed = stage(self._signed(old, -1).unionByName(self._signed(new, 1)), "payment-changes")
        self.partials.put(own, batch_id)
        self.changes.put(changed, batch_id)
        self.tiles.put(tile_changes(changed), batch_id)
        self.values.put(value_changes(changed), batch_id)
        self.clock.put(batch.agg(F.max("at_ms").alias("at_ms")).filter("at_ms IS NOT NULL"), batch_id)
        return old, new

    def attempts(self, *, from_ms: int | None = None) -> DataFrame:
        """Payments as they stand, those whose first event is at ``from_ms`` or later if given; older days are not read."""
        days = None if from_ms is None else F.col("bucket") >= from_ms // DAY_MS
        rows = self.changes.now(buckets=days).drop("loose_id", "weight")
        return rows if from_ms is None else rows.filter(F.col("at_ms") >= from_ms)

    def newest_ms(self) -> int | None:
        return self.clock.now().first()["at_ms"]


def _minute() -> Column:
    return F.expr(f"at_ms div {MINUTE_MS} * {MINUTE_MS}").alias("minute_ms")


def tile_changes(changes: DataFrame) -> DataFrame:
    """What changed payments add to the sums of tiles, and take away."""
    weighted = [F.sum(F.col("weight") * part).alias(name) for name, part in tile_parts().items()]
    return stack_kinds(changes).groupBy(*ENTITY, _minute()).agg(*weighted)


def value_changes(changes: DataFrame) -> DataFrame:
    """The same for the cards, orders and sessions of a tile, with how often each was seen."""
    facets = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in (("card", "card_id"), ("order", "order_id"), ("session", "session"))])
    rows = stack_kinds(changes).select(*ENTITY, _minute(), "weight", F.inline(facets)).filter("value IS NOT NULL")
    return rows.groupBy(*ENTITY, "minute_ms", "facet", "value").agg(F.sum("weight").alias("n"))


def payments(observations: DataFrame, state: str, *, trigger: dict | None = None) -> StreamingQuery:
    """The payments table with its tiles, kept up to date by ``PaymentTables``."""
    tables = PaymentTables(observations.sparkSession, state, observations.schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        tables.step(batch, batch_id)

    return run(observations, state, step, trigger=trigger)


def payments_now(spark: SparkSession, state: str, observations: T.StructType) -> DataFrame:
    """One row per payment over everything that has arrived."""
    return PaymentTables(spark, state, observations).attempts()


def tiles_now(spark: SparkSession, state: str, observations: T.StructType) -> DataFrame:
    """One-minute tiles of every entity, with the distinct cards, orders and sessions of each."""
    tables = PaymentTables(spark, state, observations)
    kept = [F.count(F.when(F.col("facet") == f, 1)).alias(f"distinct_{f}s") for f in ("card", "order", "session")]
    counted = tables.values.now().filter("n > 0").groupBy(*ENTITY, "minute_ms").agg(*kept)
    found = tables.tiles.now().join(counted, [*ENTITY, "minute_ms"], "left")
    return found.fillna(0, [f"distinct_{f}s" for f in ("card", "order", "session")])


def tiles(attempts: DataFrame) -> DataFrame:
    """One-minute tiles of every entity, from attempts at once."""
    return tile_changes(attempts.withColumn("weight", F.lit(1).cast("bigint")))


def sliding(tile_rows: DataFrame, *, span_ms: int, step_ms: int) -> DataFrame:
    """Trailing counts that advance by ``step_ms``, merged from tiles (a span is a whole number of steps, a step of minutes)."""
    per_step = tile_rows.groupBy(*ENTITY, F.expr(f"minute_ms div {step_ms}").alias("step")).agg(*[F.sum(c).alias(c) for c in ("attempts", "failures", "captures")])
    ends = F.explode(F.sequence(F.lit(1), F.lit(span_ms // step_ms))).alias("ahead")
    return per_step.select("*", ends).groupBy(*ENTITY, ((F.col("step") + F.col("ahead")) * step_ms).alias("end_ms")).agg(
        *[F.sum(c).alias(c) for c in ("attempts", "failures", "captures")]
    )


def _facts(spark: SparkSession, state: str, like: T.StructType) -> StateTable:
    return StateTable(spark, f"{state}/facts", like, like.names, lambda rows: rows.distinct(), bucket=F.pmod(F.xxhash64(like.names[0]), F.lit(32)))


def facts(rows: DataFrame, state: str, columns: tuple[str, ...], *, trigger: dict | None = None) -> StreamingQuery:
    """Keep the columns of a stream that a report joins later, each combination once."""
    table = _facts(rows.sparkSession, state, rows.select(*columns).schema)
    return run(rows, state, lambda batch, i: table.put(batch.select(*columns).distinct(), i), trigger=trigger)


def unresolved(spark: SparkSession, placed_state: str, paid_state: str, *, now_ms: int, bound_ms: int = 5 * MINUTE_MS) -> DataFrame:
    """Checkouts without a payment event within the bound, among those old enough to have heard back."""
    placed = _facts(spark, placed_state, T._parse_datatype_string("order_id string, created_ms bigint")).now()
    paid = _facts(spark, paid_state, T._parse_datatype_string("order_id string, at_ms bigint")).now()
    near = (F.col("a.order_id") == F.col("b.order_id")) & F.col("b.at_ms").between(F.col("a.created_ms"), F.col("a.created_ms") + bound_ms)
    return placed.filter(F.col("created_ms") < now_ms - bound_ms).alias("a").join(paid.alias("b"), near, "left_anti")


def evaluate(observations: DataFrame, state: str, *, window: FeatureWindow, columns: tuple[str, ...], trigger: dict | None = None) -> StreamingQuery:
    """One detection pass per batch over the payments whose first event lies inside the lookback; a trigger's interval debounces the passes.

    A window tests a payment's first event, so payments that began earlier are in none, and their days are not read.
    """
    tables = PaymentTables(observations.sparkSession, state, observations.schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        tables.step(batch, batch_id)
        newest = tables.newest_ms()
        if newest is not None:
            as_of = newest + 1_000
            attempts = stage(tables.attempts(from_ms=as_of - window.lookback_ms), "attempts")
            put(judge(attempts, as_of_ms=as_of, window=window).decided.select(*columns), f"{state}/decisions", batch_id)

    return run(observations, state, step, trigger=trigger)


def block(observations: DataFrame, containments: DataFrame, enforcement: DataFrame, state: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Refuse attempts of contained entities: the payments a batch touches are judged as they stand now."""
    spark = observations.sparkSession
    partials = StateTable(spark, f"{state}/payments", payment_partials(spark.createDataFrame([], observations.schema)).schema, PAYMENT, merge_partials)
    judgements = _judged(spark, state)

    def step(batch: DataFrame, batch_id: int) -> None:
        own = stage(payment_partials(batch), "batch-payments")
        now = stage(merge_payments(partials.read(before=batch_id, touched=own).unionByName(own)), "touched-payments")
        partials.put(own, batch_id)
        keys = ["scope", "payment_id"]
        refused = blocked_attempts(now, containments, enforcement).select(*keys, F.lit(True).alias("blocked"))
        judged = now.select(*keys, "at_ms").join(refused, keys, "left")
        judgements.put(judged.withColumn("blocked", F.coalesce("blocked", F.lit(False))).withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    return run(observations, state, step, trigger=trigger)


def _judged(spark: SparkSession, state: str) -> StateTable:
    schema = T._parse_datatype_string("scope string, payment_id string, at_ms bigint, blocked boolean, batch bigint")
    return StateTable(spark, f"{state}/judged", schema, ["scope", "payment_id"], lambda rows: newest_per(rows, ["scope", "payment_id"]))


def blocked_now(spark: SparkSession, state: str) -> DataFrame:
    return _judged(spark, state).now().filter("blocked").drop("blocked", "batch")


# --- change -----------------------------------------------------------------------------------------

_ALARMS = "last_bucket bigint, warm array<bigint>, ewma_at int, ewma_statistic double, cusum_at int, cusum_statistic double, cusum_buckets int"


class ChangeDetector(StatefulProcessor):
    """The detector of one series, moved on by the buckets that its new events close.

    State: counts per bucket that has events, and the fold behind the last closed bucket. Buckets before a series' newest one are closed; an event in a closed bucket is not
    lost but folds the series again from the start. Empty buckets behind the newest one raise no alarm, so a quiet series needs no visit.
    """

    def __init__(self, options: ChangeOptions):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "bucket bigint", "n bigint")
        self.fold = handle.getValueState("fold", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, int] = {}
        for part in rows:
            for bucket, n in part.groupby("bucket").size().items():
                new[int(bucket)] = new.get(int(bucket), 0) + int(n)
        for bucket, n in new.items():
            seen = self.counts.getValue((bucket,))
            self.counts.updateValue((bucket,), (n + (seen[0] if seen else 0),))
        count = lambda b: (self.counts.getValue((b,)) or (0,))[0] if self.counts.containsKey((b,)) else 0
        state = json.loads(self.fold.get()[0]) if self.fold.exists() else start_of_fold()
        last = max(max(new), state["last"])
        if min(new) < state["i"]:
            state = start_of_fold()
        while state["i"] < last:
            state = fold_series(state, count(state["i"]), self.options)
        state["last"] = last
        self.fold.update((json.dumps(state),))
        now = fold_series(state, count(last), self.options)  # with the bucket that is still open
        yield pd.DataFrame([[key[0], last, now["warm"], *[now[c] for c in ("ewma_at", "ewma_statistic", "cusum_at", "cusum_statistic", "cusum_buckets")]]],
                           columns=["key", "last_bucket", "warm", "ewma_at", "ewma_statistic", "cusum_at", "cusum_statistic", "cusum_buckets"]).astype(
            {"ewma_at": "Int32", "cusum_at": "Int32", "cusum_buckets": "Int32"})

    def close(self) -> None:
        pass


def _alarms(spark: SparkSession, state: str, key: str) -> StateTable:
    schema = T._parse_datatype_string(f"{key} string, {_ALARMS}, batch bigint")
    return StateTable(spark, f"{state}/alarms", schema, [key], lambda rows: newest_per(rows, [key]))


def change(events: DataFrame, state: str, *, options: ChangeOptions, start_ms: int, bucket_ms: int, key: str = "network", trigger: dict | None = None) -> StreamingQuery:
    """Online change detection: a batch visits the series it has events of, and folds the buckets they close."""
    alarms = _alarms(events.sparkSession, state, key)
    bucket = F.expr(f"(at_ms - {start_ms}) div {bucket_ms}").cast("long").alias("bucket")
    rows = events.filter(F.col("at_ms") >= start_ms).select(F.col(key).cast("string").alias("key"), bucket)
    found = rows.groupBy("key").transformWithStateInPandas(ChangeDetector(options), outputStructType=f"key string, {_ALARMS}", outputMode="Update", timeMode="None")

    def step(batch: DataFrame, batch_id: int) -> None:
        alarms.put(batch.withColumnRenamed("key", key).withColumn("batch", F.lit(batch_id).cast("long")), batch_id)

    return run(found, state, step, trigger=trigger, mode="update")


def change_now(spark: SparkSession, state: str, *, options: ChangeOptions, key: str = "network") -> DataFrame:
    """Limits and alarms of every series, read as reaching to the newest bucket of any."""
    rows = stage(_alarms(spark, state, key).now(), "alarms")
    last = rows.agg(F.max("last_bucket").alias("m")).first()["m"]
    return limits_of(rows, options, buckets=(last or 0) + 1)


# --- incidents ------------------------------------------------------------------------------------


def incidents(evaluations: DataFrame, state: str, *, idle_ms: int, trigger: dict | None = None) -> StreamingQuery:
    """Incidents of the entities a batch has evaluated, folded from all their evaluations."""
    spark = evaluations.sparkSession
    seen = StateTable(spark, f"{state}/evaluations", evaluations.schema, ENTITY)
    folds = cluster_incidents(spark.createDataFrame([], evaluations.schema), idle_ms=idle_ms)
    found = _incidents(spark, state, folds.schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = stage(batch, "evaluations")
        own = seen.read(before=batch_id, touched=batch).unionByName(batch)
        folded = stage(cluster_incidents(own, idle_ms=idle_ms), "folded")
        seen.put(batch, batch_id)
        # an entity whose incidents went away keeps a row that says so
        rows = batch.select(*ENTITY).distinct().join(folded, list(ENTITY), "left").withColumn("batch", F.lit(batch_id).cast("long"))
        found.put(rows, batch_id)

    return run(evaluations, state, step, trigger=trigger)


def _incidents(spark: SparkSession, state: str, like: T.StructType) -> StateTable:
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in like.fields], T.StructField("batch", T.LongType())])
    return StateTable(spark, f"{state}/incidents", schema, ENTITY, lambda rows: newest_per(rows, ENTITY))


def incidents_now(spark: SparkSession, state: str, evaluations: T.StructType) -> DataFrame:
    like = cluster_incidents(spark.createDataFrame([], evaluations), idle_ms=0).schema
    return _incidents(spark, state, like).now().filter("incident_key IS NOT NULL").drop("batch")


# --- timers -----------------------------------------------------------------------------------------


class DueTimer(StatefulProcessor):
    """Closes a key when its time has come, without an event of its own.

    State: the newest word on the key (its version and when it is due; null: it is not). The timer of an older word is taken back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.word = handle.getValueState("word", "version_ms bigint, due_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.word.get() if self.word.exists() else None
        newest = known
        for part in rows:
            for version, due in zip(part["version_ms"].tolist(), part["due_ms"].tolist(), strict=True):
                if newest is None or version >= newest[0]:
                    newest = (int(version), None if due is None or due != due else int(due))
        if newest != known:
            if known is not None and known[1] is not None:
                self.handle.deleteTimer(known[1])
            if newest[1] is not None:
                self.handle.registerTimer(newest[1])
            self.word.update(newest)
        yield pd.DataFrame({"key": [], "due_ms": [], "closed_ms": []}).astype({"key": str, "due_ms": "int64", "closed_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        found = self.word.get() if self.word.exists() else None
        if found is not None and found[1] == due:
            self.word.update((found[0], None))
            yield pd.DataFrame({"key": [key[0]], "due_ms": [due], "closed_ms": [timerValues.getCurrentWatermarkInMs()]})
        else:
            yield pd.DataFrame({"key": [], "due_ms": [], "closed_ms": []}).astype({"key": str, "due_ms": "int64", "closed_ms": "int64"})

    def close(self) -> None:
        pass


def expire(words: DataFrame, state: str, *, lateness_ms: int = MINUTE_MS, trigger: dict | None = None) -> StreamingQuery:
    """Close what is due as the clock of the stream passes it.

    ``words``: key, version_ms (the newest word on a key counts), due_ms (null: not due any more), clock_ms (when the word came; the clock is the newest of all
    keys less the lateness). A word that came more than the lateness behind the clock is not heard, so ``clock_ms`` is a time of arrival, not of the event.
    """
    schema = T._parse_datatype_string("key string, due_ms bigint, closed_ms bigint")
    closed = StateTable(words.sparkSession, f"{state}/closed", schema, ["key"], lambda rows: rows.distinct())
    rows = words.select(F.col("key").cast("string").alias("key"), "version_ms", "due_ms", F.timestamp_millis("clock_ms").alias("clock"))
    timed = rows.withWatermark("clock", f"{lateness_ms} milliseconds").groupBy("key")
    found = timed.transformWithStateInPandas(DueTimer(), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return run(found, state, lambda batch, i: closed.put(batch, i), trigger=trigger, mode="update")


def expired_now(spark: SparkSession, state: str) -> DataFrame:
    schema = T._parse_datatype_string("key string, due_ms bigint, closed_ms bigint")
    return StateTable(spark, f"{state}/closed", schema, ["key"], lambda rows: rows.distinct()).now()
