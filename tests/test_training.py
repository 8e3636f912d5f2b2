"""The training rows of the fitted models: payments collapsed in their orders, features counted where sessions lie together."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from cardwatch.config import FeatureWindow
from cardwatch.ml import models as M
from cardwatch.operators.attempts import per_payment
from cardwatch.operators.features import cadence, features, stack_kinds, variety
from cardwatch.schemas import FEATURES
from cardwatch.session import stage, stage_by

DAY = 86_400_000
T0 = 1_772_355_600_000
LONG = FeatureWindow(400 * DAY, DAY, 400 * DAY)
OBS = (
    "scope string, event_id bigint, at_ms bigint, order_id string, payment_id string, outcome string, amount_paise bigint, "
    "card_id string, error_source string, error_reason string, session string, device string, network string, source string"
)


def observations(spark, n=300, seed=5):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        order, line = draw.randrange(40), draw.randrange(4)
        keyed = draw.random() < 0.95
        rows.append((
            "shop", i, T0 + draw.choice([0, 5, 5, DAY // 2, DAY - 1]) + draw.randrange(6) * DAY, f"o{order}" if keyed else None, f"p{order}-{line}" if keyed else None,
            draw.choice(["failed", "captured", "authorized"]), draw.randrange(1, 10**6), draw.choice([None, "", "c1", "c2", "c3"]), draw.choice([None, "bank", "gateway"]),
            draw.choice([None, "x", "y"]), draw.choice([None, f"s{order % 7}"]), "d1", f"n{order % 3}", draw.choice(["live", "replay"]),
        ))
    return spark.createDataFrame(rows, OBS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def as_set(df):
    names = sorted(df.columns)
    return sorted([tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()], key=repr)


def test_payments_within_their_orders_are_the_same_payments(spark):
    rows = observations(spark)
    assert as_set(per_payment(rows, within=("order_id",))) == as_set(per_payment(rows))


def test_payments_within_orders_stay_where_orders_lie(spark):
    laid = stage_by(observations(spark), "by-order", ["order_id"])
    assert "Exchange" in plan(per_payment(laid)) and "Exchange" not in plan(per_payment(laid, within=("order_id",)))


def test_wanted_columns_are_those_of_all(spark):
    attempts = stage(per_payment(observations(spark)), "attempts")
    entities = stack_kinds(attempts, ("session", "network"))
    at = T0 + 10 * DAY
    every = variety(entities, at, LONG)
    for some in (["distinct_cards", "recovery_rate"], ["max_orders_per_card"], ["distinct_sessions", "reason_concentration"], ["distinct_cards_long_span", "distinct_networks"]):
        assert as_set(variety(entities, at, LONG, columns=some)) == as_set(every.select("scope", "entity_kind", "entity_key", *some))


def test_features_of_stored_sessions_move_no_rows(spark):
    attempts = stage_by(per_payment(observations(spark)), "attempts", ["scope", "session"])
    options = dict(as_of_ms=T0 + 10 * DAY, window=LONG, columns=("distinct_cards", "recovery_rate"))
    of_sessions = features(attempts, kinds=("session",), **options)
    assert "Exchange hashpartitioning" not in plan(of_sessions)
    both = features(attempts, kinds=("session", "network"), **options)
    assert as_set(of_sessions.unionByName(features(attempts, kinds=("network",), **options))) == as_set(both)


def test_cadence_over_days_and_equal_moments(spark):
    attempts = stage(per_payment(observations(spark)), "attempts")
    entities = stack_kinds(attempts, ("session", "network"))
    times = {}
    for r in entities.select("entity_key", "at_ms").collect():
        times.setdefault(r["entity_key"], []).append(r["at_ms"])
    found = {r["entity_key"]: r["burstiness"] for r in cadence(entities, T0 + 10 * DAY, LONG).collect()}
    assert found.keys() == times.keys()
    for key, moments in times.items():
        moments.sort()
        gaps = [b - a for a, b in zip(moments, moments[1:])]
        expected = 0.0 if len(moments) < 3 or not sum(gaps) else statistics.pstdev(gaps) / statistics.mean(gaps)
        assert found[key] == pytest.approx(expected)


def test_pieces_of_a_fit_are_no_more_than_cores_until_they_are_large():
    assert [M.pieces(n, 12) for n in (0, 50_000, 50_001, 600_000, 3_200_000, 12_000_000, 13_000_000)] == [1, 1, 2, 12, 12, 12, 13]


def test_ablated_scores_copies_beside_their_row(spark):
    draw = random.Random(3)
    rows = [(f"r{i}", i % 2, ("train", "validation", "test")[i % 3], *[draw.random() + (i % 2) * 0.3 for _ in FEATURES]) for i in range(240)]
    rows = stage(spark.createDataFrame(rows, "row_id string, y int, split string, " + ", ".join(f"{f} double" for f in FEATURES)), "rows")
    model, at = M.train(rows, "logistic"), M.medians(rows)
    parts = M.ablated(model, rows, at, ["row_id"])
    assert "Join" not in plan(parts)
    found = {(r["row_id"], r["feature"]): r["contribution"] for r in parts.collect()}
    assert len(found) == 240 * len(FEATURES)
    full = {r["row_id"]: r["risk"] for r in model.risk(rows).collect()}
    for f in FEATURES[:3]:
        held = model.risk(rows.withColumn(f, F.lit(at[f])))
        for r in held.select("row_id", "risk").collect():
            assert found[r["row_id"], f] == pytest.approx(full[r["row_id"]] - r["risk"], abs=1e-12)
