"""State of streams: compaction, retraction, online detection and timers."""

import random
import time

import pytest
from pyspark.sql import functions as F, types as T

from cardwatch.config import ChangeOptions, FeatureWindow
from cardwatch.operators.attempts import per_payment
from cardwatch.operators.change import detect_change, fold_series, series_from_counts, start_of_fold
from cardwatch.plans.detect import detection_pass
from cardwatch.operators.features import ENTITY
from cardwatch.operators.tiles import cover, tile_levels, tileize, window_sums
from cardwatch.session import stage
from cardwatch.sources.webhooks import canonicalize
from cardwatch.streaming import jobs as J
from cardwatch.streaming.state import FANOUT, StateTable, added_up, newest_per
from test_semantics import burst, obs
from test_streams import feed

MIN, DAY = 60_000, 86_400_000
LIKE = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def counted(spark, path):
    return StateTable(spark, path, LIKE, ["k"], added_up(["k"], ["n"]))


def rows_of(df):
    return sorted((str(r.k), r.n) for r in df.collect())


def test_many_batches_leave_few_folders(spark, tmp_path):
    table, want = counted(spark, tmp_path.as_uri()), {}
    for i in range(50):
        rows = [(f"k{(i * 7 + j) % 11}" if j else None, i + j) for j in range(4)] + [("gone", 1 if i % 2 else -1)]
        for k, n in rows:
            want[str(k)] = want.get(str(k), 0) + n
        table.put(spark.createDataFrame(rows, LIKE).coalesce(1), i)
    assert rows_of(table.now()) == sorted((k, n) for k, n in want.items() if n)
    manifest = table.manifest()
    assert manifest["upto"] == 48 and len(manifest["runs"]) < FANOUT
    assert len(table.read().inputFiles()) <= 32 * len(manifest["runs"]) + 2 * FANOUT
    # batches before one, and a key alone, out of its bucket
    assert rows_of(table.now(before=49)) != rows_of(table.now())
    one = table.read(touched=spark.createDataFrame([("k3", 0), (None, 0)], LIKE))
    assert {r.k for r in one.collect()} == {"k3", None}
    assert "PartitionFilters: [bucket" in one._jdf.queryExecution().toString().replace("isnotnull(bucket) AND ", "")


def test_a_crash_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    table = counted(spark, tmp_path.as_uri())
    put = lambda i: table.put(spark.createDataFrame([("a", i), (f"b{i}", 1)], LIKE).coalesce(1), i)
    for i in range(FANOUT):
        put(i)
    want = rows_of(table.now())

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(StateTable, "_commit", stop)
        with pytest.raises(RuntimeError):
            put(FANOUT)
    assert rows_of(table.now()) == want  # the run that no manifest names does not count
    reader = table.read()
    put(FANOUT)
    put(FANOUT)  # a batch that runs again replaces itself
    assert rows_of(table.now()) == sorted([*((k, n) for k, n in want if k != "a"), ("a", sum(range(FANOUT + 1))), (f"b{FANOUT}", 1)])
    assert rows_of(reader.groupBy("k").agg(F.sum("n").alias("n"))) == want  # files of the generation before are still there
    put(FANOUT + 1)
    assert table.manifest()["generation"] == 1


def test_newest_rows_of_a_key_survive_compaction(spark, tmp_path):
    like = T._parse_datatype_string("k string, v bigint, batch bigint")
    table = StateTable(spark, tmp_path.as_uri(), like, ["k"], lambda rows: newest_per(rows, ["k"]))
    for i in range(2 * FANOUT + 3):
        table.put(spark.createDataFrame([("x", i, i), ("x", -i, i), (f"y{i % 3}", i, i), (None, i, i)], like).coalesce(1), i)
    last = 2 * FANOUT + 2
    got = {(r.k, r.v) for r in table.now().collect()}
    assert got == {("x", last), ("x", -last), (None, last), *((f"y{i % 3}", i) for i in range(last - 2, last + 1))}


def test_a_changed_payment_is_taken_back_from_its_tile(spark, tmp_path):
    source, state = (tmp_path / "in").as_uri(), (tmp_path / "state").as_uri()
    one = {"payment_id": "p", "session": "s", "card_id": "c", "amount_paise": 5}
    words = [
        [{**one, "at_ms": 10 * MIN, "event_id": 5, "outcome": "failed"}, {**one, "payment_id": "q", "at_ms": 10 * MIN, "event_id": 9, "outcome": "failed"}],
        [{**one, "at_ms": 12 * MIN, "event_id": 6, "outcome": "captured"}],  # p is captured after all
        [{**one, "at_ms": 3 * MIN, "event_id": 2, "outcome": "failed", "card_id": "d"}],  # and began earlier, with another card
    ]
    seen = []
    for rows in words:
        J.payments(feed(spark, source, obs(spark, rows)), state)
        tiles = J.tiles_now(spark, state, obs(spark, rows).schema).filter("entity_kind = 'session'").orderBy("minute_ms")
        seen.append([(r.minute_ms // MIN, r.attempts, r.failures, r.captures, r.distinct_cards) for r in tiles.collect()])
    assert seen == [[(10, 2, 2, 0, 1)], [(10, 2, 1, 1, 1)], [(3, 1, 0, 1, 1), (10, 1, 1, 0, 1)]]
    assert J.PaymentTables(spark, state, obs(spark, words[0]).schema).newest_ms() == 12 * MIN


def test_shuffled_repeated_slices_give_the_batch_answer(spark, tmp_path):
    source, state = (tmp_path / "in").as_uri(), (tmp_path / "state").as_uri()
    rng = random.Random(2)
    rows = [{"at_ms": rng.randrange(40) * 20_000, "payment_id": rng.choice([f"p{i}" for i in range(12)] + [None]), "event_id": i, "session": f"s{i % 3}",
             "outcome": rng.choice(["failed", "captured", "authorized"]), "card_id": f"c{i % 5}", "amount_paise": rng.choice([None, i])} for i in range(120)]
    rng.shuffle(rows)
    for k in range(10):
        J.payments(feed(spark, source, obs(spark, rows[k::10])), state)
    every = obs(spark, rows)
    want = J.tiles(per_payment(every))
    got = J.tiles_now(spark, state, every.schema).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert J.PaymentTables(spark, state, every.schema).partials.manifest()["generation"] == 1


def test_letters_are_tried_again_die_and_come_back(spark, tmp_path):
    source, state = (tmp_path / "in").as_uri(), (tmp_path / "state").as_uri()
    schema = "scope string, event_id bigint, header_id string, source string, received_ms bigint, raw_body string"
    body = '{"event": "payment.failed", "created_at": 1, "payload": {"payment": {"entity": {"id": "p"}}}}'
    every = spark.createDataFrame([("shop", i, f"h{i}", "live", i, "{" if i == 2 else body) for i in range(6)], schema)
    slow = {"rounds": 0}

    def read(rows):
        """Delivery 4 cannot be read in the first two rounds."""
        slow["rounds"] += 1
        return canonicalize(rows if slow["rounds"] > 2 else rows.filter("event_id <> 4"))

    seen = []
    for ids in ("event_id IN (2, 3, 4)", "event_id = 0", "event_id = 1", "event_id = 5", "event_id = 0"):
        every.filter(ids).write.mode("append").parquet(source)
        J.drain(spark.readStream.schema(every.schema).parquet(source), state, raw=lambda: every, read=read, limit=3)
        seen.append({r.delivery_key: (r.attempts, r.status) for r in J.letters_now(spark, state).collect()})
        if len(seen) == 4:
            J.requeue_letters(spark, state, spark.createDataFrame([("h2",), ("h4",)], "delivery_key string"))
    assert seen[0] == {"h2": (1, "retry"), "h4": (1, "retry")} and seen[1] == {"h2": (2, "retry"), "h4": (2, "retry")}
    assert seen[2] == seen[3] == {"h2": (3, "dead"), "h4": (2, "processed")}
    assert seen[4] == {"h2": (1, "retry"), "h4": (2, "processed")}  # only what is dead comes back
    assert {r.last_error for r in J.letters_now(spark, state).filter("delivery_key = 'h2'").collect()} == {"not_json"}
    assert sorted(r.event_id for r in spark.read.parquet(f"{state}/canonical").collect()) == [0, 1, 3, 4, 5]


def test_a_window_is_covered_by_few_tiles(spark):
    rng = random.Random(4)
    rows = [{"at_ms": rng.randrange(40 * DAY), "payment_id": f"p{i}", "event_id": i, "session": f"s{i % 2}", "outcome": rng.choice(["failed", "captured"]), "amount_paise": i} for i in range(400)]
    minutes = stage(tileize(per_payment(obs(spark, rows)), ("session",), sketches=False), "tiles")
    levels = stage(tile_levels(minutes, half_life_ms=3 * DAY), "levels")
    for low, high in ((37 * MIN, 40 * DAY - 13 * MIN), (5 * DAY, 6 * DAY), (3 * MIN, 50 * MIN), (DAY - MIN, DAY + 2 * MIN), (7 * MIN, 6 * 60 * MIN + 7 * MIN)):
        stretches = cover(low, high)
        assert sum(b - a for _, a, b in stretches) == high - low and sum((b - a) // s for s, a, b in stretches) <= 2 * 59 + 2 * 23 + 40
        got = {r.entity_key: r for r in window_sums(levels, from_ms=low, to_ms=high, half_life_ms=3 * DAY).collect()}
        direct = {}
        for r in minutes.filter(f"minute_ms >= {low} AND minute_ms < {high}").collect():
            n, f, d = direct.get(r.entity_key, (0, 0, 0.0))
            direct[r.entity_key] = (n + r.attempts, f + r.failures, d + r.failures * 2.0 ** (-(high - r.minute_ms - 30_000) / (3 * DAY)))
        assert {k: (r.attempts, r.failures) for k, r in got.items()} == {k: v[:2] for k, v in direct.items()}
        assert all(got[k].decayed_failures == pytest.approx(v[2]) for k, v in direct.items())
    with pytest.raises(ValueError):
        cover(1, MIN)


def test_shop_wide_incident_is_stored_once(spark):
    from cardwatch.operators.incidents import raised_spikes

    like = "scope string, entity_kind string, entity_key string, first_ms bigint, last_ms bigint, attempts bigint, raised boolean"
    found = spark.createDataFrame([("a", "network", "shop_wide", 1, 9, 30, True), ("b", "network", "shop_wide", 1, 9, 30, True), ("c", "network", "shop_wide", 1, 9, 30, False)], like)
    stored = found.filter("scope = 'a'").unionByName(found.filter("scope = 'b'").withColumn("attempts", F.lit(7).cast("bigint")))
    assert [r.scope for r in raised_spikes(found, stored).collect()] == ["b"]


OPTIONS = ChangeOptions(warm_up_buckets=5, control_limit=1.5, slack=0.25, decision_interval=2.0)


def test_one_step_of_the_detector_is_the_fold(spark):
    rng = random.Random(8)
    series = {f"n{i}": [rng.choice([0, 1, 2, 9 if b > 9 + i else 1]) for b in range(4 + 3 * i)] for i in range(8)}
    counts = spark.createDataFrame([(k, b, n) for k, s in series.items() for b, n in enumerate(s)], "network string, bucket bigint, n bigint")
    for r in detect_change(counts, OPTIONS, keys=("network",)).collect():
        s = start_of_fold()
        for n in series[r.network]:
            s = fold_series(s, n, OPTIONS)
        assert (s["ewma_at"], s["cusum_at"]) == (r.ewma_at, r.cusum_at)
        assert (s["ewma_statistic"] or 0.0, s["cusum_statistic"] or 0.0, s["cusum_buckets"] or 0) == (r.ewma_statistic, r.cusum_statistic, r.cusum_buckets)


def test_online_alarms_equal_the_batch_answer(spark, tmp_path):
    source, state = (tmp_path / "in").as_uri(), (tmp_path / "state").as_uri()
    rng, schema = random.Random(6), "network string, at_ms bigint"
    events = [(f"n{i}", b * 1000 + j) for i in range(4) for b in range(6 + 5 * i) for j in range(rng.choice([0, 1, 1, 8 if b > 8 else 2]))]
    slices = [[e for e in events if e[1] < 9_000 and e[1] % 5], [e for e in events if e[1] >= 9_000], [e for e in events if e[1] < 9_000 and not e[1] % 5]]  # in order, then late
    for part in slices:
        J.change(feed(spark, source, spark.createDataFrame(part, schema)), state, options=OPTIONS, start_ms=0, bucket_ms=1000)
        seen = spark.read.schema(schema).parquet(source)
        counts = seen.groupBy("network", F.expr("at_ms div 1000").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        want = detect_change(series_from_counts(counts, keys=("network",)), OPTIONS, keys=("network",)).drop("buckets")
        got = J.change_now(spark, state, options=OPTIONS).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_what_is_due_closes_without_an_event_of_its_own(spark, tmp_path):
    source, state = (tmp_path / "in").as_uri(), (tmp_path / "state").as_uri()
    schema = "key string, version_ms bigint, due_ms bigint, clock_ms bigint"
    word = lambda key, at, due: (key, at * MIN, None if due is None else due * MIN, at * MIN)
    slices = [
        [word("idle", 10, 20), word("busy", 10, 20), word("released", 11, 20)],
        [word("busy", 15, 40), word("released", 16, None)],
        [word("other", 30, 90)],  # moves the clock; says nothing about the rest
    ]
    closed = []
    for rows in slices:
        J.expire(feed(spark, source, spark.createDataFrame(rows, schema)), state)
        closed.append({r.key: r.due_ms // MIN for r in J.expired_now(spark, state).collect()})
    assert closed == [{}, {}, {"idle": 20}]


def test_a_running_trigger_gathers_what_arrives_into_passes(spark, tmp_path):
    source, state = (tmp_path / "in").as_uri(), (tmp_path / "state").as_uri()
    rows, window = obs(spark, burst(30, 10 * MIN)), FeatureWindow()
    rows.filter("event_id < 10").write.mode("append").parquet(source)
    columns = (*ENTITY, "score", "decision")
    running = J.evaluate(spark.readStream.schema(rows.schema).parquet(source), state, window=window, columns=columns, trigger={"processingTime": "2 seconds"})
    try:
        rows.filter("event_id >= 10 AND event_id < 20").write.mode("append").parquet(source)
        rows.filter("event_id >= 20").write.mode("append").parquet(source)
        until = time.time() + 180
        while time.time() < until and (running.lastProgress or {}).get("batchId", -1) < 1:
            time.sleep(1)
        running.processAllAvailable()
    finally:
        running.stop()
    passes = spark.read.parquet(f"{state}/decisions")
    newest = passes.agg(F.max("batch")).first()[0]
    as_of = rows.agg(F.max("at_ms")).first()[0] + 1_000
    want = detection_pass(rows, as_of_ms=as_of, window=window).decided.select(*columns)
    assert newest <= 2 and sorted(map(str, passes.filter(F.col("batch") == newest).select(*columns).collect())) == sorted(map(str, want.collect()))


def test_a_batch_merges_payments_before_and_after_it_at_once(spark):
    from cardwatch.operators.attempts import merge_before_and_after, merge_partials, payment_partials

    row = lambda p, e, at, outcome, reason=None: ("shop", p, e, at, outcome, 5, reason, None, f"o{e}")
    schema = "scope string, payment_id string, event_id long, at_ms long, outcome string, amount_paise long, error_reason string, error_source string, order_id string"
    known = payment_partials(spark.createDataFrame([row("p1", 1, 50, "failed", "x"), row("p1", 2, 60, "captured")], schema))
    fresh = payment_partials(spark.createDataFrame([row("p1", 3, 40, "failed"), row("p2", 4, 70, "captured"), row(None, 5, 70, "other")], schema))
    both = merge_before_and_after(known, fresh)
    keys, rows = ["scope", "payment_id", "loose_id"], lambda df: sorted(df.collect(), key=str)
    assert rows(both.select(*keys, "after.*")) == rows(merge_partials(known.unionByName(fresh)))
    assert rows(both.filter("before IS NOT NULL").select(*keys, "before.*")) == rows(merge_partials(known))
