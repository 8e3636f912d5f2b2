"""Small hand-built cases, invariances, and brute-force twins of what SQL does not express."""

import hashlib
import hmac
import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cardwatch.config import ChangeOptions, FeatureWindow, Policy
from cardwatch.functions import crypto, text
from cardwatch.functions.numeric import half_up
from cardwatch.functions.timeline import as_of, trailing_distinct, trailing_sum
from cardwatch.ml import evaluate as E
from cardwatch.ml.dataset import grouped_split, group_overlap
from cardwatch.operators import audit, change, incidents, policy
from cardwatch.operators.attempts import per_payment, resolve_attempts, resolve_orders
from cardwatch.operators.features import exact_median, features
from cardwatch.plans.detect import detection_pass
from cardwatch.session import stage
from cardwatch.sources import webhooks

T0 = 1_772_355_600_000
MIN = 60_000
WIDE = FeatureWindow(600 * MIN, 5 * MIN, 600 * MIN)
LIVE = FeatureWindow(30 * MIN, 5 * MIN, 360 * MIN)
OBS = (
    "scope string, event_id bigint, at_ms bigint, order_id string, payment_id string, outcome string, amount_paise bigint, "
    "card_id string, error_source string, error_reason string, session string, device string, network string, source string"
)


def obs(spark, rows):
    base = dict(scope="shop", outcome="failed", amount_paise=149_900, error_source="bank", error_reason="card_declined",
                session="s1", device="d1", network="n1", source="live")
    full = []
    for i, r in enumerate(rows):
        row = {**base, "event_id": i, "order_id": f"o{i}", "payment_id": f"p{i}", "card_id": f"c{i}", **r}
        full.append(tuple(row[c.split()[0]] for c in OBS.split(", ")))
    return spark.createDataFrame(full, OBS)


def judge(spark, rows, window, **options):
    last = max(r["at_ms"] for r in rows)
    found = detection_pass(obs(spark, rows), as_of_ms=last + 1_000, window=window, kinds=("session",), **options)
    row = found.decided.first()
    return row, {e["rule"] for e in row["evidence"]}, {a["rule"]: a["reason"] for a in row["abstentions"]}


def burst(n, step, **extra):
    return [{"at_ms": T0 + i * step, **{k: (v(i) if callable(v) else v) for k, v in extra.items()}} for i in range(n)]


def test_enumeration_and_withheld_counts(spark):
    rows = burst(30, 10_000, amount_paise=100, error_reason="invalid_card")
    row, fired, _ = judge(spark, rows, WIDE)
    assert "card_spread" in fired and "card_spread_slow" not in fired
    assert row["best"] == "attack" and row["decision"] == "contain"
    row, fired, silent = judge(spark, rows, WIDE, confirm_exact=False)
    assert silent["card_spread"] == "unconfirmed-estimate" and "card_spread" not in fired
    assert row["decision"] != "contain"


def test_dunning_reuses_cards(spark):
    rows = burst(24, 60_000, order_id=lambda i: f"o{i % 4}", card_id=lambda i: f"c{i % 4}")
    _, fired, _ = judge(spark, rows, WIDE)
    assert "card_reuse" in fired and "card_spread" not in fired


def test_one_card_many_orders(spark):
    rows = burst(6, 20_000, card_id="c", amount_paise=100)
    assert "card_probing" in judge(spark, rows, WIDE)[1]
    assert "card_probing" not in judge(spark, [{**r, "outcome": "captured"} for r in rows], WIDE)[1]


def test_slow_enumeration(spark):
    fired = judge(spark, burst(14, 6 * MIN), LIVE)[1]
    assert "card_spread_slow" in fired and "card_spread" not in fired


def test_outage_is_not_blamed_on_shoppers(spark):
    row, fired, _ = judge(spark, burst(20, 10_000, error_source="gateway", error_reason="gateway_timeout"), WIDE)
    assert "infrastructure_attribution" in fired and "reason_mix" not in fired and row["mitigating"] < 0


def test_recovered_shopper_scores_zero(spark):
    rows = [{"at_ms": T0, "order_id": "o"}, {"at_ms": T0 + 40_000, "order_id": "o", "outcome": "captured", "error_reason": None, "error_source": None}]
    row, fired, _ = judge(spark, rows, WIDE)
    assert "recovery" in fired and row["score"] == 0


def test_barely_any_activity(spark):
    _, _, silent = judge(spark, burst(2, 5_000), WIDE)
    assert silent["approval_collapse"] == silent["machine_cadence"] == "insufficient-data"


def test_late_capture_does_not_leak_into_an_earlier_pass(spark):
    rows = obs(spark, [{"at_ms": T0, "payment_id": "p"}, {"at_ms": T0 + 10_000, "payment_id": "p", "outcome": "captured"}])
    assert per_payment(rows, as_of_ms=T0 + 5_000).first()["outcome"] == "failed"
    assert per_payment(rows).first()["outcome"] == "captured"


def test_rows_without_payment_id_stay(spark):
    rows = obs(spark, [{"at_ms": T0, "payment_id": None}, {"at_ms": T0, "payment_id": ""}, {"at_ms": T0, "payment_id": "p"}, {"at_ms": T0 + 1, "payment_id": "p"}])
    assert per_payment(rows).count() == 3


def test_resolution_ignores_order_and_duplicates(spark):
    schema = ("scope string, event_id bigint, event_type string, order_id string, payment_id string, amount_paise bigint, method string, error_code string, "
              "error_reason string, error_source string, card_network string, card_issuer string, card_id string, at_ms bigint, source string, late boolean")
    failed = ("shop", 1, "payment.failed", "o", "p", 500, "card", "E1", "declined", "bank", "visa", None, "c1", T0, "live", False)
    auth = ("shop", 2, "payment.authorized", "o", "p", 500, "card", None, None, None, "visa", "hdfc", "c2", T0 + 1, "live", False)
    done = ("shop", 3, "payment.captured", "o", "p", 700, None, None, None, None, None, None, None, T0 + 2, "live", True)
    seen = set()
    for order in itertools.permutations([failed, auth, done, failed]):
        row = resolve_attempts(spark.createDataFrame(list(order), schema)).first()
        seen.add(tuple(row))
    assert len(seen) == 1
    assert (row["status"], row["amount_paise"], row["method"], row["card_id"], row["error_reason"], row["failed"], row["late"]) == (
        "captured", 700, "card", "c2", "declined", True, True)
    order = resolve_orders(resolve_attempts(spark.createDataFrame([failed, auth, done], schema))).first()
    assert (order["outcome"], order["recovered"], order["failure_count"]) == ("paid", True, 1)


def test_rounding_goes_up_at_half(spark):
    row = spark.range(1).select(half_up(F.lit(-0.0005)).alias("a"), half_up(F.lit(0.0005)).alias("b")).first()
    assert row["a"] == 0.0 and row["b"] == 0.001


def reference_change(series, o):
    warm = series[: o.warm_up_buckets]
    mean = sum(warm) / len(warm)
    sd = max(math.sqrt(sum((x - mean) ** 2 for x in warm) / max(len(warm) - 1, 1)), 0.5)
    ew, total, since, e_at, c_at, c_len = mean, 0.0, 0, None, None, 0
    for i in range(len(warm), len(series)):
        ew = o.smoothing * series[i] + (1 - o.smoothing) * ew
        if e_at is None and ew - mean > o.control_limit * sd * math.sqrt(o.smoothing / (2 - o.smoothing)):
            e_at = i
        excess = series[i] - mean - o.slack * sd
        if total == 0 and excess > 0:
            since = i
        total = max(0.0, total + excess)
        if c_at is None and total > o.decision_interval * sd:
            c_at, c_len = i, i - since + 1
    return e_at, c_at, c_len


def test_change_detection_matches_a_plain_walk(spark):
    rng = random.Random(7)
    quiet = [rng.choice([1, 2, 3]) for _ in range(35)]
    cases = {"flat": quiet + [2] * 25, "jump": quiet + [20] * 25, "step": quiet + [4] * 25, "steady": quiet + [5] * 30, "short": quiet[:20]}
    for i in range(15):
        cases[f"r{i}"] = [rng.randrange(6) for _ in range(35)] + [rng.randrange(i + 2) for _ in range(40)]
    rows = [(k, i, n) for k, s in cases.items() for i, n in enumerate(s)]
    out = change.detect_change(spark.createDataFrame(rows, "scope string, bucket bigint, n bigint"))
    got = {r["scope"]: (r["ewma_at"], r["cusum_at"], r["cusum_buckets"]) for r in out.collect()}
    want = {k: reference_change(s, ChangeOptions()) if len(s) > 30 else (None, None, 0) for k, s in cases.items()}
    assert got == want
    assert got["flat"] == (None, None, 0) and got["jump"][0] is not None and got["jump"][0] < 38 and got["steady"][1] is not None


def reference_clusters(rows, idle):
    running, closed = None, []
    for r in rows:
        if running is not None and r["activity_ms"] > running["last"] + idle:
            closed.append({**running, "status": "expired"})
            running = None
        if running is not None:
            running = {**running, "last": max(running["last"], r["activity_ms"]), "score": r["score"], "n": running["n"] + 1}
        elif r["warrants"]:
            running = {"first": r["first_seen_ms"], "detected": r["at_ms"], "last": r["activity_ms"], "score": r["score"], "n": 1}
    return closed + ([{**running, "status": "open"}] if running else [])


def test_incident_clusters_match_a_plain_fold(spark):
    rng, rows = random.Random(3), []
    for e in range(40):
        at = T0
        for _ in range(rng.randrange(1, 15)):
            at += rng.randrange(1, 50) * MIN
            rows.append(dict(scope="shop", entity_kind="session", entity_key=f"s{e}", at_ms=at, activity_ms=at - rng.randrange(0, 1000), first_seen_ms=at - 5000,
                             score=rng.choice([0.1, 0.5, 0.8]), attempts=3, warrants=rng.random() < 0.4))
    schema = "scope string, entity_kind string, entity_key string, at_ms bigint, activity_ms bigint, first_seen_ms bigint, score double, attempts bigint, warrants boolean"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    got = sorted((r["entity_key"], r["first_ms"], r["detected_ms"], r["last_ms"], r["score"], r["observations"], r["status"])
                 for r in incidents.cluster_incidents(df, idle_ms=30 * MIN).collect())
    want = []
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r["entity_key"], r["at_ms"])), key=lambda r: r["entity_key"]):
        group = list(group)
        found = reference_clusters(group, 30 * MIN)
        # An incident left behind by a later silent evaluation is closed as well.
        want += [(key, f["first"], f["detected"], f["last"], f["score"], f["n"], f["status"]) for f in found]
    assert got == sorted(want)


def chain(n):
    out, prev = [], audit.GENESIS
    for seq in range(1, n + 1):
        row = dict(chain_id="main", position=seq, seq=seq, at_ms=T0 + seq, actor_id="u1", kind="k", subject_type="t", subject_id="x", payload='{"a":1}',
                   policy_version="1", policy_hash=None, feature_hash=None, model_version=None, prev_hash=prev)
        row["hash"] = digest(row)
        prev = row["hash"]
        out.append(row)
    return out


def digest(row):
    values = [str(row[c]) if row[c] is not None else None for c in audit.CONTENT] + [row["prev_hash"]]
    return hashlib.sha256(json.dumps(values, separators=(",", ":")).encode()).hexdigest()


@pytest.mark.parametrize(
    "tamper, reason, seq",
    [
        (lambda c: c, None, None),
        (lambda c: [{**r, "payload": "{}"} if r["seq"] == 3 else r for r in c], "hash-mismatch", 3),
        (lambda c: [dict(r, payload="{}", hash=digest({**r, "payload": "{}"})) if r["seq"] == 3 else r for r in c], "broken-link", 4),
        (lambda c: [r for r in c if r["seq"] != 3], "sequence-gap", 4),
        (lambda c: [c[0], c[1], c[3], c[2], c[4]], "out-of-order", 4),
        (lambda c: [dict(c[0], prev_hash="f" * 64, hash=digest({**c[0], "prev_hash": "f" * 64}))] + c[1:], "broken-link", 1),
    ],
)
def test_audit_tampering(spark, tamper, reason, seq):
    rows = [{**r, "position": i + 1} for i, r in enumerate(tamper(chain(5)))]
    schema = ("chain_id string, position bigint, seq bigint, at_ms bigint, actor_id string, kind string, subject_type string, subject_id string, payload string, "
              "policy_version string, policy_hash string, feature_hash string, model_version string, prev_hash string, hash string")
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    found = audit.verify_chain(df).first()
    assert (found["reason"], found["diverges_at_seq"], found["valid"]) == (reason, seq, reason is None)


POLICY_ROW = dict(entity_kind="session", entity_key="s1", best="attack", decision="contain", abstained=False, attack_support=0.9, attack_probability=0.8,
                  attempts=20, distinct_cards=20, shop_active_sessions=100, now_ms=T0, features_ms=T0, active_containments=0, containments_last_hour=0)


@pytest.mark.parametrize(
    "row, options, action, refusals",
    [
        ({}, {}, "contain", []),
        ({"attack_support": 0.6}, {}, "step_up", []),
        ({"attack_support": 0.3}, {}, "escalate", []),
        ({}, {"kill_switch": True}, "observe", ["kill_switch_engaged"]),
        ({}, {"allow_sessions": ("s1",)}, "observe", ["entity_is_allowlisted"]),
        ({"best": "outage", "decision": "monitor"}, {}, "observe", ["suppressed_by_outage"]),
        ({"best": "retry_storm", "decision": "review"}, {}, "escalate", ["suppressed_by_retry_storm"]),
        ({"now_ms": T0 + 16 * MIN}, {}, "escalate", ["feature_state_is_stale"]),
        ({"distinct_cards": None}, {}, "escalate", ["counts_never_confirmed"]),
        ({"active_containments": 5, "shop_active_sessions": 10}, {}, "escalate", ["too_many_active_containments"]),
        ({"containments_last_hour": 10}, {}, "escalate", ["hourly_containment_cap_reached"]),
        ({"active_containments": 4, "shop_active_sessions": 50}, {}, "escalate", ["would_contain_too_much_of_the_shop"]),
    ],
)
def test_policy_table(spark, row, options, action, refusals):
    full = {**POLICY_ROW, **row}
    schema = ("entity_kind string, entity_key string, best string, decision string, abstained boolean, attack_support double, attack_probability double, attempts bigint, "
              "distinct_cards bigint, shop_active_sessions bigint, now_ms bigint, features_ms bigint, active_containments bigint, containments_last_hour bigint")
    df = spark.createDataFrame([tuple(full[c.split()[0]] for c in schema.split(", "))], schema)
    out = policy.policy_decide(df, Policy(**options)).first()
    assert (out["action"], out["refusals"]) == (action, refusals)


def test_trailing_windows_match_brute_force(spark):
    rng = random.Random(11)
    rows = [(f"k{rng.randrange(3)}", T0 + rng.randrange(0, 400_000), f"v{rng.randrange(6)}") for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, t bigint, v string")
    span = 70_000
    got = {(r["k"], r["t"]): r["d"] for r in trailing_distinct(df, ["k"], "v", "t", span, "d").collect()}
    sums = {(r["k"], r["t"]): r["n"] for r in trailing_sum(df.withColumn("n", F.lit(1)), ["k"], "t", span, ["n"]).collect()}
    for k, t, _ in rows:
        inside = [v for kk, tt, v in rows if kk == k and t - span <= tt <= t]
        assert got[(k, t)] == len(set(inside)) and sums[(k, t)] == len(inside)


def test_state_as_of(spark):
    log = spark.createDataFrame([("a", 100, "on"), ("a", 200_000, "off")], "k string, t bigint, s string")
    ask = spark.createDataFrame([("a", t) for t in (50, 100, 150_000, 200_000, 900_000)], "k string, t bigint")
    got = {r["t"]: r["s"] for r in as_of(ask, log, ["k"], "t", "s").collect()}
    assert got == {50: None, 100: "on", 150_000: "on", 200_000: "off", 900_000: "off"}


def test_exact_median_with_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot", rng.randrange(0, 2**31)) for _ in range(3001)] + [("even", v) for v in (1, 9, 70_000, 2**30)] + [("one", 7)]
    got = {r["k"]: r["m"] for r in exact_median(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", "m").collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got == {"hot": float(hot[1500]), "even": (9 + 70_000) / 2, "one": 7.0}


def test_hmac_and_pseudonyms(spark):
    for key in ("k", "x" * 100):
        got = spark.range(1).select(crypto.hmac_sha256(F.lit("héllo"), key)).first()[0]
        assert got == hmac.new(key.encode(), "héllo".encode(), hashlib.sha256).hexdigest()
    ips = {"10.1.2.3": "10.1.2.0/24", " 2001:db8:5::1": "2001:db8:5::/48", "fe80::1": "fe80:1::/48", "nonsense": "unknown", "1.2.3": "unknown"}
    rows = spark.createDataFrame([(k,) for k in ips], "ip string").select("ip", crypto.truncate_ip(F.col("ip")).alias("n")).collect()
    assert {r["ip"]: r["n"] for r in rows} == ips


def test_card_numbers_need_a_valid_checksum(spark):
    body = "ok 4111 1111 1111 1111, no 4111111111111112, ts 1772355600000123, mail a.b@corp.io and t@test.local, +919876543210"
    row = spark.createDataFrame([(body,)], "t string").select(
        text.card_numbers(F.col("t")).alias("c"), text.emails(F.col("t")).alias("e"), text.phones(F.col("t")).alias("p")).first()
    assert [c.strip() for c in row["c"]] == ["4111 1111 1111 1111"] and row["e"] == ["a.b@corp.io"] and row["p"] == ["+919876543210"]


def test_canonical_events_carry_no_personal_fields(spark):
    body = lambda name, entity, **kw: json.dumps({"event": "e", "payload": {name: {"entity": entity}}, **kw})
    bodies = [
        body("payment", {"id": "p1", "order_id": "o1", "amount": 100, "email": "a@b.co", "card": {"id": "c1", "last4": "4242", "network": ""}}, created_at=T0 // 1000),
        body("order", {"id": "o2", "status": "paid"}),
        body("settlement", {"id": "x"}),
        json.dumps({"event": "e", "payload": {"payment": {"entity": {}}, "refund": {"entity": {"id": "r", "payment_id": "p9"}}}}),
        "{broken",
    ]
    raw = spark.createDataFrame([(str(i), b, None, "live", 77) for i, b in enumerate(bodies)], "header_id string, raw_body string, signature string, source string, received_ms bigint")
    rows = {r["header_id"]: r for r in webhooks.canonicalize(raw).collect()}
    assert set(rows) == {"0", "1", "2", "3"}
    assert not set(webhooks.FORBIDDEN) & set(rows["0"].asDict())
    assert (rows["0"]["payment_id"], rows["0"]["card_id"], rows["0"]["card_network"], rows["0"]["at_ms"]) == ("p1", "c1", None, T0)
    assert (rows["1"]["order_id"], rows["1"]["payment_id"], rows["1"]["at_ms"]) == ("o2", None, 77)
    assert (rows["2"]["entity_type"], rows["3"]["entity_type"], rows["3"]["payment_id"]) == ("settlement", "refund", "p9")
    assert webhooks.dead_letters(raw).count() == 1


def test_average_precision_and_auc_with_ties(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(200)]
    got = E.ranking(spark.createDataFrame(rows, "y int, risk double").withColumn("model", F.lit("m"))).first()
    pos = sum(y for y, _ in rows)
    ap, seen, hits = 0.0, 0, 0
    for r in sorted({r for _, r in rows}, reverse=True):
        tie = [y for y, q in rows if q == r]
        seen, hits = seen + len(tie), hits + sum(tie)
        ap += sum(tie) / pos * hits / seen
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for ya, a in rows if ya for yb, b in rows if not yb]
    assert got["pr_auc"] == pytest.approx(ap) and got["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))


def test_bootstrap_brackets_the_point_estimate(spark):
    rng = random.Random(4)
    rows = [(str(i), int(rng.random() < 0.4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, y int").withColumn("risk", F.col("y") * 0.4 + F.pmod(F.xxhash64("id"), F.lit(100)) / 200).withColumn("threshold", F.lit(0.45))
    point = E.confusion(df.withColumn("model", F.lit("m"))).first()
    got = {r["metric"]: r for r in E.bootstrap(df, F.col("id"), rounds=100).collect()}
    assert got["recall"]["low"] <= point["recall"] <= got["recall"]["high"]
    assert got["precision"]["low"] <= point["precision"] <= got["precision"]["high"]
    assert got["recall"]["point"] == pytest.approx(point["recall"]) and got["precision"]["point"] == pytest.approx(point["precision"])
    again = {r["metric"]: r for r in E.bootstrap(df.repartition(7), F.col("id"), rounds=100).collect()}
    assert {m: r["low"] for m, r in got.items()} == pytest.approx({m: r["low"] for m, r in again.items()})


def test_temperature_finds_the_true_scale(spark):
    rng, rows = random.Random(9), []
    for _ in range(4000):
        z = rng.gauss(0, 1.5)
        rows.append((int(rng.random() < 1 / (1 + math.exp(-z))), 3.0 * z))
    assert E.temperature(spark.createDataFrame(rows, "y int, logit double")) == pytest.approx(3.0, rel=0.15)


def test_groups_never_cross_a_split(spark):
    rows = spark.range(2000).select((F.col("id") % 97).cast("string").alias("group"))
    split = grouped_split(rows)
    assert group_overlap(split, "train", "test").first()[0] == 0
    assert {r[0] for r in split.select("split").distinct().collect()} == {"train", "validation", "test"}


def test_hot_entity_features_match_the_plain_answer(spark):
    """One network holds most rows; its features must be whole."""
    rng = random.Random(1)
    rows = [{"at_ms": T0 + rng.randrange(0, 20 * MIN), "card_id": f"c{rng.randrange(50)}", "order_id": f"o{rng.randrange(300)}", "session": f"s{i % 80}",
             "network": "hot" if i % 3 else f"n{i}", "outcome": rng.choice(["failed", "captured"])} for i in range(900)]
    attempts = stage(per_payment(obs(spark, rows)), "attempts")
    hot = features(attempts, as_of_ms=T0 + 21 * MIN, window=LIVE, kinds=("network",), entity_key="hot").first()
    mine = [r for r in rows if r["network"] == "hot"]
    by_card, by_order = {}, {}
    for r in mine:
        by_card.setdefault(r["card_id"], set()).add(r["order_id"])
        by_order.setdefault(r["order_id"], set()).add(r["outcome"])
    times = sorted(r["at_ms"] for r in mine)
    gaps = [b - a for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    cv = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) / mean
    assert (hot["attempts"], hot["distinct_cards"], hot["distinct_sessions"]) == (len(mine), len(by_card), len({r["session"] for r in mine}))
    assert hot["max_orders_per_card"] == max(len(o) for o in by_card.values())
    assert hot["recovered_orders"] == sum(o == {"failed", "captured"} for o in by_order.values())
    assert hot["burstiness"] == pytest.approx(cv)


def test_bootstrap_draws_by_pieces_what_rows_and_rounds_would_draw(spark, monkeypatch):
    monkeypatch.setattr(E, "ROWS_A_PIECE", 40)
    rng = random.Random(11)
    rows = [(f"s{i}", rng.choice([0, 1, 1, None]), rng.choice([0.5, 0.5, round(rng.random(), 2), None]), 0.45) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, y int, risk double, threshold double")
    drawn = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn(
        "w", F.when(F.col("round") == 0, F.lit(1.0)).otherwise(E.poisson_weight(F.col("id"), F.col("round"), 1))).filter("w > 0")
    ranked = {r["round"]: r["pr_auc"] for r in E.ranking(drawn, ["round"], weight=F.col("w")).collect()}
    values = sorted(v for k, v in ranked.items() if k)
    rounds = E.bootstrap(df, F.col("id"), rounds=20)
    got = {r["metric"]: r for r in rounds.collect()}["pr_auc"]
    assert got["point"] == pytest.approx(ranked[0]) and got["median"] == pytest.approx((values[9] + values[10]) / 2)
    hashed = df.select("id", F.xxhash64("id").alias("h")).toPandas()["h"].to_numpy()
    first = {(r["id"], r["round"]): r["w"] for r in drawn.collect()}
    weights = E.poisson_weights(hashed, 20, 1)
    assert all(weights[i, k] == first.get((f"s{i}", k), 0) for i in range(400) for k in range(21))


def test_shared_identifiers_are_found_without_sorting(spark):
    from cardwatch.operators.links import shared_identifiers

    rows = [("a", "s1", "o1", "p1"), ("b", "s2", "o1", "p2"), ("b", "s2", None, "p3"), (None, "s1", "o3", "p4"), ("a", "s1", "o4", "p1")]
    found = shared_identifiers(spark.createDataFrame(rows, "part string, session string, order_id string, payment_id string"))
    assert [tuple(r) for r in found.collect()] == [("order_id", "o1")]
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
