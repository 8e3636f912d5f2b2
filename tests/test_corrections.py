"""Cases the tables do not hold: missing hashes, repeated finds, scopes without attempts, unreadable bodies."""

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import audit, incidents, reports
from cardwatch.plans.attempts_view import typical_amount
from cardwatch.sources import webhooks as Wh

LOG = "chain_id string, position bigint, seq bigint, at_ms bigint, actor_id string, kind string, subject_type string, subject_id string, payload string, policy_version string, policy_hash string, feature_hash string, model_version string"


def honest(spark, n):
    rows = [("c", i + 1, i + 1, 1000 + i, "u", "k", "t", "s", f'{{"n":{i}}}', None, None, None, None) for i in range(n)]
    entries, previous, out = spark.createDataFrame(rows, LOG).collect(), audit.GENESIS, []
    for row in entries:
        one = spark.createDataFrame([row], LOG).select(audit.content_hash(F.lit(previous)).alias("h")).first()["h"]
        out.append((*row, previous, one))
        previous = one
    return out


def verify(spark, rows):
    return audit.verify_chain(spark.createDataFrame(rows, f"{LOG}, prev_hash string, hash string")).first()


def test_missing_hashes_and_numbers_are_divergences(spark):
    rows = honest(spark, 4)
    assert verify(spark, rows)["valid"]
    at = LOG.split(", ").index
    forged = [*rows, ("c", 5, 5, 2000, "u", "k", "t", "s", "{}", None, None, None, None, None, None)]
    assert verify(spark, forged)["reason"] == "broken-link"
    unhashed = [r if r[1] != 2 else (*r[:-1], None) for r in rows]
    assert (verify(spark, unhashed)["reason"], verify(spark, unhashed)["diverges_at_seq"]) == ("hash-mismatch", 2)
    for column in ("seq bigint", "position bigint"):
        cut = [tuple(None if (i == at(column) and r[1] == 3) else v for i, v in enumerate(r)) for r in rows]
        assert not verify(spark, cut)["valid"]


def test_dead_letters_hold_no_text_of_the_body(spark):
    bodies = [("d1", '{"email":"jane@shop.in"'), ("d2", '{"email":"jane@shop.in"}'), ("d3", "jane@shop.in"), ("d4", None)]
    inbox = spark.createDataFrame([("shop", i, d, d, "live", 1, b) for i, (d, b) in enumerate(bodies)], "scope string, event_id bigint, delivery_key string, header_id string, source string, received_ms bigint, raw_body string")
    dead = Wh.dead_letters(inbox).collect()
    assert {r.delivery_key: r.last_error for r in dead} == {"d1": "not_json", "d2": "no_event", "d3": "not_json", "d4": "not_json"}
    assert not any("jane" in str(v) for r in dead for v in r)


def test_retries_end_and_can_be_asked_for_again(spark):
    state = spark.createDataFrame([], "delivery_key string, attempts int, status string, last_error string, last_ms bigint")
    failed = spark.createDataFrame([("a", "not_json"), ("a", "not_json"), ("b", "no_event")], "delivery_key string, last_error string")
    for now in (1, 2, 3, 4):
        state = spark.createDataFrame(Wh.next_attempts(failed if now != 2 else failed.filter("delivery_key = 'a'"), state, now_ms=now, limit=3).collect(), state.schema)
    rows = {r.delivery_key: tuple(r)[1:] for r in state.collect()}
    assert rows == {"a": (3, "dead", "not_json", 3), "b": (3, "dead", "no_event", 4)}
    again = {r.delivery_key: tuple(r)[1:3] for r in Wh.requeue(state, failed.filter("delivery_key = 'a'")).collect()}
    assert again == {"a": (0, "retry"), "b": (3, "dead")}


def test_several_finds_of_one_key_are_one_row(spark):
    schema = "incident_id string, status string, first_ms bigint, detected_ms bigint, last_ms bigint, score double"
    stored = spark.createDataFrame([("i1", "contained", 1, 2, 3, 0.5)], schema)
    found = spark.createDataFrame([("i1", "open", 1, 2, 9, 0.7), ("i1", "open", 1, 2, 5, 0.9), ("i2", "open", 4, 4, 4, 0.1), ("i2", "open", 4, 4, 4, 0.1)], schema)
    rows = {r.incident_id: (r.status, r.last_ms, r.score, r.change) for r in incidents.upsert_incidents(stored, found).collect()}
    assert incidents.upsert_incidents(stored, found).count() == 2
    assert rows == {"i1": ("contained", 9, 0.7, "updated"), "i2": ("open", 4, 0.1, "opened")}


def test_scopes_without_attempts_and_long_trends(spark):
    day = 86_400_000
    attempts = spark.createDataFrame([("a", 100 * day + 5, "failed")], "scope string, first_ms bigint, status string")
    raised = spark.createDataFrame([("b", "i", "open", "high", 0.9, 99 * day, 99 * day)], "scope string, incident_id string, status string, severity string, score double, first_ms bigint, detected_ms bigint")
    now = 100 * day + 10
    trend = reports.risk_trend(attempts, raised, now_ms=now, window_ms=60 * day)
    assert {(r.scope, r.n) for r in trend.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", 61), ("b", 61)}
    assert trend.agg(F.sum("incidents"), F.sum("failures")).first()[:] == (1, 1)
    kpis = {r.scope: (r.attempts, r.active_incidents, r.total_incidents) for r in reports.overview_kpis(attempts, raised, now_ms=now, window_ms=7 * day).collect()}
    assert kpis == {"a": (1, 0, 0), "b": (0, 1, 1)}


@pytest.mark.parametrize("sample,want", [(None, 1000), (10, 1500)])
def test_typical_amount_reads_every_capture_unless_asked(spark, sample, want):
    rows = [("s", i, i, 500 if i < 900 else 1500 if i >= 1790 else 1000) for i in range(1800)]
    captures = spark.createDataFrame(rows, "source string, event_id bigint, at_ms bigint, amount_paise bigint")
    got = typical_amount(captures, sample=sample).first()["typical_paise"]
    assert got == (want if sample else 750)


def test_fitted_models_train_on_sessions_and_networks(spark, sf_dir):
    from cardwatch.catalog.learning import _training

    rows = _training(spark, sf_dir)
    keys = [r.row_id.split(":")[1] for r in rows.select("row_id").collect()]
    assert {k[0] for k in keys} == {"s", "n"}
    assert rows.select("row_id").distinct().count() == len(keys)


def test_candidates_do_not_follow_the_sketch_error(spark, con, sf_dir, monkeypatch):
    from oracle import compare

    from cardwatch.catalog import ORACLE, QUERIES
    from cardwatch.operators import features

    exact = features.sketch_counts
    off = F.pmod(F.xxhash64("entity_key"), F.lit(7)) - 3  # within three bounds
    monkeypatch.setattr(features, "sketch_counts", lambda *a: exact(*a).withColumn("card_estimate", F.greatest(F.col("card_estimate") + off, F.lit(0))))
    ok, note = compare(spark, con, "rank_candidates", QUERIES["rank_candidates"], ORACLE["rank_candidates"], sf_dir)
    assert ok, note


def test_parts_that_share_identifiers_are_refused(spark):
    from cardwatch.operators.links import compose_labelled

    like = "part string, session string, order_id string, payment_id string"
    parts = spark.createDataFrame([("quiet", "s1", "o1", "p1"), ("attack", "s2", "o2", "p2"), ("attack", None, None, None)], like)
    attackers = parts.filter("part = 'attack'").select("session")
    assert {r.session: r.is_abuse for r in compose_labelled(parts, attackers).collect()} == {"s1": False, "s2": True, None: False}
    again = parts.unionByName(spark.createDataFrame([("quiet", "s2", "o9", "p9")], like))
    with pytest.raises(ValueError, match="session s2"):
        compose_labelled(again, attackers)
