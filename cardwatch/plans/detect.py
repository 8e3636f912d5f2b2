"""One detection pass: attempts -> features -> rules -> explanations -> decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cardwatch.config import KINDS, FeatureWindow, Thresholds
from cardwatch.operators.attempts import per_payment
from cardwatch.operators.features import features
from cardwatch.operators.hypotheses import arbitrate, decide
from cardwatch.operators.rules import evaluate_rules, score
from cardwatch.operators.traffic import traffic_context, with_traffic
from cardwatch.session import stage


@dataclass(frozen=True)
class Pass:
    """Everything one pass computes; the tables are lazy except attempts and traffic."""

    as_of_ms: int
    window: FeatureWindow
    attempts: DataFrame
    traffic: DataFrame
    vectors: DataFrame
    decided: DataFrame


def recent_observations(observations: DataFrame, *, as_of_ms: int, lookback_ms: int) -> DataFrame:
    """All events of the payments that have one inside the lookback, and events without a payment inside it.

    A payment without an event since the bound began before it, so no window of the pass holds it. The history before the
    bound is only looked up for those payments; the bound is a filter on the event time that reaches the scan.
    """
    inside = observations.filter((F.col("at_ms") > as_of_ms - lookback_ms - 1) & (F.col("at_ms") <= as_of_ms))
    older = observations.filter(F.col("at_ms") <= as_of_ms - lookback_ms - 1)
    named = inside.filter(F.coalesce(F.col("payment_id"), F.lit("")) != "").select("scope", "payment_id").distinct()
    same = F.col("a.scope").eqNullSafe(F.col("b.scope")) & (F.col("a.payment_id") == F.col("b.payment_id"))  # a shop without a name is one, too
    return inside.unionByName(older.alias("a").join(named.alias("b"), same, "left_semi"))


def detection_pass(
    observations: DataFrame,
    *,
    as_of_ms: int,
    window: FeatureWindow = FeatureWindow(),
    kinds: Sequence[str] = KINDS,
    thresholds: Thresholds = Thresholds(),
    confirm_exact: bool = True,
    sketches: bool = False,
) -> Pass:
    """Judge every entity of every kind at one moment, against one picture of the shop."""
    recent = recent_observations(observations, as_of_ms=as_of_ms, lookback_ms=window.lookback_ms)
    attempts = stage(per_payment(recent, as_of_ms=as_of_ms), "attempts")
    return judge(attempts, as_of_ms=as_of_ms, window=window, kinds=kinds, thresholds=thresholds, confirm_exact=confirm_exact, sketches=sketches)


def judge(
    attempts: DataFrame,
    *,
    as_of_ms: int,
    window: FeatureWindow = FeatureWindow(),
    kinds: Sequence[str] = KINDS,
    thresholds: Thresholds = Thresholds(),
    confirm_exact: bool = True,
    sketches: bool = False,
) -> Pass:
    """The pass over attempts that are collapsed already (a written table; it is read several times)."""
    traffic = stage(traffic_context(attempts, as_of_ms=as_of_ms, window=window), "traffic")
    vectors = features(
        attempts, as_of_ms=as_of_ms, window=window, kinds=kinds, confirm_exact=confirm_exact, sketches=sketches
    )
    scored = score(evaluate_rules(with_traffic(vectors, traffic), thresholds))
    decided = decide(arbitrate(scored, thresholds), thresholds)
    return Pass(as_of_ms, window, attempts, traffic, vectors, decided)
