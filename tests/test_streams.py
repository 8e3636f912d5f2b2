"""Streams keep late rows and repeats apart, and go on where they stopped."""

from pyspark.sql import functions as F

from cardwatch.operators.attempts import merge_payments, payment_partials, per_payment
from cardwatch.streaming import jobs as J
from test_semantics import OBS, burst, obs

MIN = 60_000


def feed(spark, source, rows):
    rows.write.mode("append").parquet(source)
    return spark.readStream.schema(rows.schema).parquet(source)


def test_a_payment_that_arrives_very_late_is_counted(spark, tmp_path):
    source, state = (tmp_path / "in").as_uri(), (tmp_path / "state").as_uri()
    rows = obs(spark, burst(20, 10 * MIN))
    last, first = rows.filter("event_id >= 5"), rows.filter("event_id < 5")  # the oldest come last, hours late
    J.payments(feed(spark, source, last), state)
    J.payments(feed(spark, source, first), state)
    got = J.payments_now(spark, state, rows.schema)
    assert got.count() == 20
    want = J.tiles(per_payment(rows))
    assert sorted(map(tuple, J.tiles_now(spark, state, rows.schema).select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_late_event_changes_its_payment(spark, tmp_path):
    source, state = (tmp_path / "in").as_uri(), (tmp_path / "state").as_uri()
    early = obs(spark, [{"at_ms": 1_000, "payment_id": "p", "amount_paise": 1, "event_id": 1, "outcome": "failed"}])
    late = obs(spark, [{"at_ms": 9 * 86_400_000, "payment_id": "p", "amount_paise": 2, "event_id": 2, "outcome": "captured"}])
    J.payments(feed(spark, source, late), state)
    J.payments(feed(spark, source, early), state)
    row = J.payments_now(spark, state, early.schema).first()
    assert (row.at_ms, row.amount_paise, row.outcome, row.n_events) == (1_000, 1, "captured", 2)


def test_partials_merge_in_any_grouping(spark):
    rows = obs(spark, [{"at_ms": 100 + i * 7 % 5, "payment_id": ["p", "q", None, ""][i % 4], "event_id": i, "outcome": ["failed", "captured", "authorized"][i % 3],
                        "error_reason": [None, "a", "b"][i % 3]} for i in range(40)])
    want = sorted(map(str, per_payment(rows).select("payment_id", "at_ms", "outcome", "order_id", "error_reason", "error_source", "n_events").collect()))
    for n in (1, 2, 5):
        parts = None
        for k in range(n):
            part = payment_partials(rows.filter(F.col("event_id") % n == k))
            parts = part if parts is None else parts.unionByName(part)
        merged = merge_payments(parts).select("payment_id", "at_ms", "outcome", "order_id", "error_reason", "error_source", "n_events")
        assert sorted(map(str, merged.collect())) == want
    assert OBS.startswith("scope")


def test_repeats_are_known_for_ever_and_starting_again_adds_nothing(spark, tmp_path):
    source, state = (tmp_path / "in").as_uri(), (tmp_path / "state").as_uri()
    schema = "scope string, event_id bigint, header_id string, source string, received_ms bigint, raw_body string"
    day = 86_400_000
    batches = [[("shop", 1, "a", "live", 10 * day, "{}")], [("shop", 1, "a", "live", 400 * day, "{}"), ("shop", 2, "b", "live", 1, "{}")], [("shop", 1, "a", "live", 5, "{}")]]
    for rows in batches:
        J.dedup(feed(spark, source, spark.createDataFrame(rows, schema)), state)
    J.dedup(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(source), state)
    kept = spark.read.parquet(f"{state}/first")
    assert sorted(r.delivery_key for r in kept.collect()) == ["a", "b"]
