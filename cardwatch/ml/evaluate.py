"""Evaluation of scored rows (``y`` 0/1, ``risk`` in [0, 1]) as aggregates.

Ranking metrics count the rows of each distinct score first; what is ordered afterwards are distinct
scores in bounded pieces, never the rows. Scores are compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.config import CostModel
from cardwatch.functions.numeric import count_true, ratio
from cardwatch.functions.timeline import cumulated, order_statistics
from cardwatch.session import stage


def _curve(scored: DataFrame, keys: Sequence[str], score: str = "risk", weight: Column | None = None) -> DataFrame:
    """Per key and distinct score, from the top: positives, rows, and both cumulated."""
    w = F.lit(1.0) if weight is None else weight
    down = scored.select(*keys, (-F.col(score)).alias("down"), F.when(F.col("y") == 1, w).otherwise(0.0).alias("pos"), w.alias("n"))
    return cumulated(down, keys, "down", ["pos", "n"])


def ranking(scored: DataFrame, keys: Sequence[str] = ("model",), *, score: str = "risk", weight: Column | None = None) -> DataFrame:
    """Average precision and ROC AUC per key, ties taken together."""
    curve = _curve(scored, keys, score, weight)
    neg = F.col("n") - F.col("pos")
    sums = curve.groupBy(*keys).agg(
        F.sum("pos").alias("positives"),
        F.sum("n").alias("rows"),
        F.sum(F.col("pos") * F.try_divide(F.col("cum_pos"), F.col("cum_n"))).alias("precision_mass"),
        F.sum(neg * (F.col("cum_pos") - F.col("pos") / 2)).alias("concordant"),
    )
    negatives = F.col("rows") - F.col("positives")
    return sums.select(
        *keys,
        "rows",
        "positives",
        F.try_divide(F.col("precision_mass"), F.col("positives")).alias("pr_auc"),
        F.try_divide(F.col("concordant"), F.col("positives") * negatives).alias("roc_auc"),
    )


def brier(scored: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    return scored.groupBy(*keys).agg(F.avg(F.pow(F.col("risk") - F.col("y"), F.lit(2.0))).alias("brier"))


def thresholds() -> Column:
    """91 candidate thresholds from 0.05 to 0.95."""
    return F.transform(F.sequence(F.lit(0), F.lit(90)), lambda i: 0.05 + i * 0.01)


def cost_threshold(scored: DataFrame, keys: Sequence[str] = ("model",), *, cost: CostModel = CostModel()) -> DataFrame:
    """Threshold with the lowest expected cost (first of equals).

    Rows are counted per (key, number of thresholds at or below the score, label) first, so
    the sweep multiplies at most 92 x 2 counts per key, not the rows.
    """
    passed = F.size(F.filter(thresholds(), lambda t: F.col("risk") >= t))
    counts = scored.groupBy(*keys, passed.alias("passed"), "y").agg(F.count(F.lit(1)).alias("n"))
    swept = counts.select("*", F.posexplode(thresholds()).alias("i", "threshold"))
    flagged = F.col("passed") > F.col("i")
    missed = F.sum(F.when(~flagged & (F.col("y") == 1), F.col("n")).otherwise(0))
    wrong = F.sum(F.when(flagged & (F.col("y") == 0), F.col("n")).otherwise(0))
    costs = swept.groupBy(*keys, "i", "threshold").agg((missed * cost.false_negative + wrong * cost.false_positive).alias("cost_paise"))
    best = costs.groupBy(*keys).agg(F.min(F.struct("cost_paise", "i", "threshold")).alias("m"))
    return best.select(*keys, F.col("m.threshold").alias("threshold"), F.col("m.cost_paise").alias("cost_paise"))


def confusion(scored: DataFrame, keys: Sequence[str] = ("model",), *, cost: CostModel = CostModel()) -> DataFrame:
    """Counts, precision, recall, F1 and cost at each row's ``threshold``."""
    flagged, abuse = F.col("risk") >= F.col("threshold"), F.col("y") == 1
    c = scored.groupBy(*keys).agg(
        count_true(flagged & abuse).alias("tp"), count_true(flagged & ~abuse).alias("fp"),
        count_true(~flagged & abuse).alias("fn"), count_true(~flagged & ~abuse).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        "*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (fn * cost.false_negative + fp * cost.false_positive).alias("cost_paise"),
    )


def operating_point(scored: DataFrame, keys: Sequence[str] = ("model",), *, review_cap: float = 0.03) -> DataFrame:
    """False-decline and block rates at the threshold, and the review band below it.

    The band is the top share of all rows among those not blocked; its lower edge is an order
    statistic, found without sorting the rows.
    """
    blocked = F.col("risk") >= F.col("threshold")
    sums = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), count_true(F.col("y") == 0).alias("negatives"), count_true(blocked).alias("blocked"),
        count_true(blocked & (F.col("y") == 0)).alias("wrong"), F.max("threshold").alias("threshold"),
    )
    sums = sums.withColumn("take", F.least(F.floor(F.col("rows") * F.lit(review_cap)), F.col("rows") - F.col("blocked")))
    # A few numbers per key: written, so the joins below see how small they are.
    sums = stage(sums, "operating")
    down = scored.filter(~blocked).select(*keys, (-F.col("risk")).alias("down"), F.lit(1).cast("bigint").alias("n"))
    ranked = cumulated(down, keys, "down", ["n"])
    edges = ranked.join(sums.select(*keys, "take"), list(keys)).filter((F.col("take") > 0) & (F.col("cum_n") >= F.col("take")))
    edge = edges.groupBy(*keys).agg((-F.min("down")).alias("edge"))
    return sums.join(edge, list(keys), "left").select(
        *keys,
        ratio(F.col("wrong"), F.col("negatives")).alias("false_decline_rate"),
        ratio(F.col("blocked"), F.col("rows")).alias("block_rate"),
        ratio(F.col("take"), F.col("rows")).alias("review_rate"),
        F.coalesce("edge", "threshold").alias("review_threshold"),
    )


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a rate."""
    n = trials.cast("double")
    p = successes / n
    centre = p + F.lit(z * z) / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    scale = 1 + F.lit(z * z) / n
    none = trials <= 0
    return (
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - half) / scale)),
        F.when(none, 0.0).otherwise(F.least(F.lit(1.0), (centre + half) / scale)),
    )


def per_origin(scored: DataFrame) -> DataFrame:
    """Recall of abusive origins, false-positive rate of the others, with an interval."""
    flagged, abuse = F.col("risk") >= F.col("threshold"), F.col("y") == 1
    g = scored.groupBy("origin").agg(
        F.count(F.lit(1)).alias("n"), count_true(abuse).alias("positives"), count_true(flagged & abuse).alias("caught"),
        count_true(flagged & ~abuse).alias("wrong"), F.avg("risk").alias("mean_risk"),
    )
    positive = F.col("positives") > 0
    negatives = F.col("n") - F.col("positives")
    g = g.withColumn("flagged", F.when(positive, F.col("caught")).otherwise(F.col("wrong"))).withColumn(
        "denominator", F.when(positive, F.col("positives")).otherwise(negatives)
    )
    low, high = wilson(F.col("flagged"), F.col("denominator"))
    return g.select(
        "origin", "n", positive.alias("positive"), "flagged", "denominator", low.alias("low"), high.alias("high"),
        F.try_divide(F.col("caught").cast("double"), F.col("positives")).alias("recall"),
        F.try_divide(F.col("wrong").cast("double"), negatives).alias("false_positive_rate"), "mean_risk",
    )


def reliability(scored: DataFrame, *, bins: int = 10) -> DataFrame:
    """Predicted against observed rate in quantile bins (edges are exact order statistics)."""
    marked = scored.withColumn("all", F.lit(1))
    ranks = {f"q{i}": (lambda n, i=i: F.greatest(F.ceil(n * F.lit(i / bins)), F.lit(1))) for i in range(1, bins)}
    # One row of edges: written, so that it is broadcast instead of shuffling the rows to it.
    edges = stage(order_statistics(marked, ["all"], "risk", ranks).select("all", F.array(*ranks).alias("edges")), "edges")
    placed = marked.join(edges, "all").withColumn("bin", F.size(F.filter("edges", lambda e: F.col("risk") > e)))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("risk").alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"))


def poisson_weight(row_id: Column, round_id: Column, seed: int) -> Column:
    """Poisson(1) draw from a hash of row and round: the same when a task is run again.

    The hash has 30 bits; the largest draw they can tell from a smaller one is 11.
    """
    u = F.pmod(F.xxhash64(row_id, round_id, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight, cumulative, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 12):
        cumulative += p
        weight = weight + F.when(u >= cumulative, 1).otherwise(0)
        p /= k
    return weight.cast("double")


_DRAWS = np.cumsum(0.36787944117144233 / np.cumprod([1.0, *range(1, 11)]))  # of at most 0, 1, .. 10
_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hash_int(value: np.ndarray | int, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int under a seed."""
    h = (seed + _P5 + np.uint64(4)) ^ (np.asarray(value).astype(np.uint64) & np.uint64(0xFFFFFFFF)) * _P1
    h = (h << np.uint64(23) | h >> np.uint64(41)) * _P2 + _P3
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def poisson_weights(hashed: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """``poisson_weight`` of rows (their ids hashed) in rounds 0 to ``rounds``; round 0 is the rows as they are, once each."""
    h = _hash_int(seed, _hash_int(np.arange(rounds + 1)[None, :], hashed.astype(np.int64).view(np.uint64)[:, None]))
    weights = np.searchsorted(_DRAWS * (1 << 30), (h & np.uint64((1 << 30) - 1)).astype(np.float64).ravel(), side="right").reshape(h.shape)
    weights[:, 0] = 1
    return weights.astype(np.float64)


ROWS_A_PIECE, ROWS_AT_ONCE = 4_096, 512


def bootstrap(scored: DataFrame, row_id: Column, *, rounds: int = 1000, seed: int = 1) -> DataFrame:
    """Precision, recall, F1 and average precision with their 95% percentile intervals.

    Each round reweights every row by a Poisson(1) draw. Rows are laid into pieces of consecutive scores, and a task draws all rounds of a piece at once and adds
    them up, so a row is moved twice and never once per round. A score with more rows than a piece has pieces of its own.
    """
    flagged, abuse = F.col("risk") >= F.col("threshold"), F.col("y") == 1
    mark = lambda cond: F.coalesce(cond, F.lit(False))
    rows = scored.select(
        (-F.col("risk")).alias("down"), F.xxhash64(row_id).alias("hashed"), mark(abuse).alias("abuse"),
        mark(flagged & abuse).alias("tp"), mark(flagged & ~abuse).alias("fp"), mark(~flagged & abuse).alias("fn"),
    )
    rows = stage(rows, "bootstrap-rows")
    curve = cumulated(rows.filter("down IS NOT NULL").select("down", F.lit(0).alias("all"), F.lit(1).cast("bigint").alias("n")), ["all"], "down", ["n"])
    start, large = F.col("cum_n") - F.col("n"), F.col("n") > ROWS_A_PIECE
    places = curve.select(
        "down", start.alias("at"), (2 * F.floor(start / ROWS_A_PIECE) + large.cast("int")).alias("piece"),
        large.alias("large"), F.ceil(F.col("n") / ROWS_A_PIECE).cast("int").alias("parts"),
    )
    # rows without a score come before all others
    part = F.pmod(F.xxhash64("hashed"), F.coalesce("parts", F.lit(64)))
    placed = rows.join(places, "down", "left").select(
        F.coalesce("at", F.lit(-1)).alias("at"), F.coalesce("piece", F.lit(-1)).alias("piece"), F.coalesce("large", F.lit(True)).alias("large"),
        "hashed", "abuse", "tp", "fp", "fn", F.when(F.coalesce("large", F.lit(True)), part).otherwise(0).alias("part"),
    )
    placed = stage(placed, "bootstrap-placed")
    names = ("pos", "n", "tp", "fp", "fn")

    def drawn(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for i in range(0, len(pdf), ROWS_AT_ONCE):
            some = pdf.iloc[i : i + ROWS_AT_ONCE]
            yield some, poisson_weights(some["hashed"].to_numpy(), rounds, seed)

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros((len(names), rounds + 1))
        for some, w in drawn(pdf):
            sums += np.stack([some[c].to_numpy(dtype=np.float64) for c in ("abuse",)] + [np.ones(len(some))] + [some[c].to_numpy(dtype=np.float64) for c in names[2:]]) @ w
        found = pd.DataFrame(dict(zip(names, sums, strict=True)))
        return found.assign(piece=pdf["piece"].iloc[0], large=pdf["large"].iloc[0], round=np.arange(rounds + 1))[["piece", "large", "round", *names]]

    def mass(key: tuple, pdf: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        """What the scores of a piece add to the precision mass of each round."""
        pdf, base = pdf.sort_values("at"), base.sort_values("round")
        pos, n, found = base["pos"].to_numpy(), base["n"].to_numpy(), np.zeros(rounds + 1)
        ends = np.flatnonzero(np.diff(pdf["at"].to_numpy(), append=-2))  # the last row of each score
        done, here = 0, np.zeros(rounds + 1)
        for some, w in drawn(pdf):
            own = w * some["abuse"].to_numpy(dtype=np.float64)[:, None]
            stops = ends[(ends >= done) & (ends < done + len(some))] - done
            begins = np.concatenate([[0], stops + 1])
            for a, b in zip(begins, [*(stops + 1), len(some)], strict=True):
                if a == b:
                    continue
                here, pos, n = here + own[a:b].sum(axis=0), pos + own[a:b].sum(axis=0), n + w[a:b].sum(axis=0)
                if b - 1 in stops:
                    found += here * np.divide(pos, n, out=np.zeros_like(n), where=n > 0)
                    here = np.zeros(rounds + 1)
            done += len(some)
        return pd.DataFrame({"round": np.arange(rounds + 1), "mass": found})

    kinds = ", ".join(f"{c} double" for c in names)
    # dealt by number: a piece is small in bytes and long in draws, so pieces are not to be put together by their size
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    summed = placed.repartition(tasks, "piece", "large", "part").groupBy("piece", "large", "part").applyInPandas(totals, f"piece long, large boolean, round int, {kinds}")
    # a row per piece and round from here on
    summed = stage(summed.groupBy("piece", "large", "round").agg(*[F.sum(c).alias(c) for c in names]), "bootstrap-pieces")
    earlier = W.partitionBy("round").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    based = summed.withColumns({f"base_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0.0)) for c in ("pos", "n")})
    based = stage(based, "bootstrap-based")
    before = based.filter("NOT large").select("piece", "round", F.col("base_pos").alias("pos"), F.col("base_n").alias("n"))
    dealt = lambda df: df.repartition(tasks, "piece").groupBy("piece")
    small = dealt(placed.filter("NOT large")).cogroup(dealt(before)).applyInPandas(mass, "round int, mass double")
    alone = F.col("pos") * F.try_divide(F.col("base_pos") + F.col("pos"), F.col("base_n") + F.col("n"))
    masses = small.unionByName(based.filter("large").select("round", alone.alias("mass"))).groupBy("round").agg(F.sum("mass").alias("mass"))
    counts = summed.groupBy("round").agg(*[F.sum(c).alias(c) for c in names]).filter("n > 0")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scores = counts.join(masses, "round").select(
        "round", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide("mass", "pos").alias("pr_auc"),
    )
    # One row per round from here on.
    long = scores.select("round", F.expr("stack(4, 'precision', precision, 'recall', recall, 'f1', f1, 'pr_auc', pr_auc) AS (metric, value)"))
    of_draws = F.when(F.col("round") > 0, F.col("value"))
    return long.groupBy("metric").agg(
        F.max(F.when(F.col("round") == 0, F.col("value"))).alias("point"),
        F.percentile(of_draws, 0.025).alias("low"), F.percentile(of_draws, 0.5).alias("median"), F.percentile(of_draws, 0.975).alias("high"),
    )


def single_feature_auc(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """ROC AUC of every feature on its own, strongest separation first."""
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("risk")
    long = rows.select("y", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), value(f)) for f in features])))
    return ranking(long, ["feature"]).select("feature", F.col("roc_auc").alias("auc"), F.abs(F.col("roc_auc") - 0.5).alias("separation"), "pr_auc")


def error_taxonomy(scored: DataFrame, column: str = "small_amount_share") -> DataFrame:
    """Errors by tercile of a column."""
    marked = scored.withColumn("all", F.lit(1))
    third = lambda k: (lambda n: F.greatest(F.ceil(n * F.lit(k / 3)), F.lit(1)))
    edges = stage(order_statistics(marked, ["all"], column, {"one": third(1), "two": third(2)}), "edges")
    band = F.when(F.col(column) < F.col("one"), "low").when(F.col(column) < F.col("two"), "mid").otherwise("high")
    flagged, abuse = F.col("risk") >= F.col("threshold"), F.col("y") == 1
    return marked.join(edges, "all").groupBy(band.alias("amount_band")).agg(
        F.count(F.lit(1)).alias("n"), count_true(flagged & ~abuse).alias("false_positive"), count_true(~flagged & abuse).alias("false_negative")
    )


def calibration(scored: DataFrame, *, low: float = 0.25, high: float = 10.0, passes: int = 30) -> tuple[float, float | None]:
    """The temperature in low .. high that minimises the mean log loss of ``logit / T``, and that loss (None without rows).

    The loss is convex in b = 1 / T. A pass over the rows gives its gradient and curvature at b as three sums; Newton's step from there is
    kept inside the interval in which the minimum is known to lie, so it always closes in.
    """
    floor, top = 1 / high, 1 / low
    b, loss = 1.0, None
    for _ in range(passes):
        z = F.col("logit") * F.lit(b)
        # log(1 + e^z) - y z, and the probability, without overflow
        soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
        found = scored.agg(
            F.avg(soft - F.col("y") * z).alias("loss"),
            F.avg((p - F.col("y")) * F.col("logit")).alias("gradient"),
            F.avg(p * (1 - p) * F.col("logit") * F.col("logit")).alias("curvature"),
        ).first()
        if found["loss"] is None:
            return 1.0, None
        loss, gradient, curvature = found["loss"], found["gradient"], found["curvature"]
        floor, top = (b, top) if gradient < 0 else (floor, b)
        step = b - gradient / curvature if curvature > 0 else (floor if gradient > 0 else top)
        step = step if floor < step < top else (floor + top) / 2 if top - floor > 1e-9 else b
        if abs(step - b) <= 1e-9 * b or gradient == 0:
            break
        b = step
    return 1 / b, loss


def temperature(scored: DataFrame) -> float:
    return calibration(scored)[0]
