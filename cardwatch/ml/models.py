"""Training, calibration and scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cardwatch.config import CostModel
from cardwatch.ml import evaluate as E
from cardwatch.ml.dataset import ENTITY_FEATURES, SEED, TRAFFIC_FEATURES, grouped_split, hash_fraction
from cardwatch.functions.timeline import order_statistics
from cardwatch.schemas import FEATURES
from cardwatch.session import stage


ROWS_A_TASK, MOST_A_TASK = 50_000, 1_000_000


def pieces(n: int, cores: int) -> int:
    """Into how many pieces n rows are laid for a fit: each of its many small jobs starts a task for every one, so no more than there are cores, until pieces grow large."""
    return max(1, min(-(-n // ROWS_A_TASK), max(cores, -(-n // MOST_A_TASK))))


@dataclass(frozen=True)
class Fitted:
    """A calibrated model with its operating thresholds."""

    name: str
    features: tuple[str, ...]
    pipeline: PipelineModel
    temperature: float
    threshold: float
    review_threshold: float

    def risk(self, rows: DataFrame) -> DataFrame:
        """Rows with calibrated ``logit`` and ``risk``."""
        out = self.pipeline.transform(rows)
        return _with_logit(out).withColumn("risk", 1 / (1 + F.exp(-F.col("logit") / self.temperature)))


def _with_logit(out: DataFrame) -> DataFrame:
    """Log odds of abuse from the predicted probability, without the vector columns."""
    p = F.least(F.greatest(vector_to_array("probability")[1], F.lit(1e-12)), F.lit(1 - 1e-12))
    vectors = [c for c in ("assembled", "scaled", "rawPrediction", "probability", "prediction") if c in out.columns]
    return out.withColumn("logit", F.log(p / (1 - p))).drop(*vectors)


def _stages(name: str, features: Sequence[str], rounds: int, seed: int) -> list:
    assemble = VectorAssembler(inputCols=list(features), outputCol="assembled")
    if name == "logistic":
        scale = StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True)
        # regParam * rows plays the part of an inverse penalty of one; rows are only known at fit time.
        return [assemble, scale, LogisticRegression(featuresCol="scaled", labelCol="y", standardization=False, maxIter=200)]
    if name == "forest":
        return [assemble, RandomForestClassifier(featuresCol="assembled", labelCol="y", numTrees=rounds, minInstancesPerNode=3, maxDepth=8, seed=seed)]
    return [assemble, GBTClassifier(featuresCol="assembled", labelCol="y", maxIter=rounds, stepSize=0.05, maxDepth=4, seed=seed)]


def train(
    rows: DataFrame,
    name: str = "boosted",
    *,
    features: Sequence[str] = FEATURES,
    rounds: int = 200,
    cost: CostModel = CostModel(),
    seed: int = SEED,
) -> Fitted:
    """Fit on the train side, calibrate and choose thresholds on the validation side.

    ``rows`` carries the features, ``y`` and ``split``.
    """
    stages = _stages(name, features, rounds, seed)
    # A fit reads its rows hundreds of times: they are laid into as few pieces as their number asks for and kept, on disk where memory ends.
    train_rows = rows.filter(F.col("split") == "train").select(*features, "y")
    n = train_rows.count()
    train_rows = train_rows.coalesce(pieces(n, rows.sparkSession.sparkContext.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK)
    if name == "logistic":
        stages[-1].setRegParam(1.0 / max(n, 1))
    try:
        pipeline = Pipeline(stages=stages).fit(train_rows)
    finally:
        train_rows.unpersist()
    validation = rows.filter(F.col("split") == "validation")
    # Read by every step below: written once, two numbers per row.
    judged = stage(_with_logit(pipeline.transform(validation)).select("y", "logit"), "validation")
    temperature = E.temperature(judged)
    scored = judged.withColumn("risk", 1 / (1 + F.exp(-F.col("logit") / temperature))).withColumn("model", F.lit(name))
    best = E.cost_threshold(scored, cost=cost).first()
    threshold = 0.5 if best is None else float(best["threshold"])
    point = E.operating_point(scored.withColumn("threshold", F.lit(threshold)), review_cap=cost.review_cap).first()
    review = threshold if point is None else float(point["review_threshold"])
    return Fitted(name, tuple(features), pipeline, temperature, threshold, review)


def score(model: Fitted, rows: DataFrame) -> DataFrame:
    """Risk, band, class and whether the model leaves the call to a person."""
    risk = F.col("risk")
    band = F.when(risk >= model.threshold, "block").when(risk >= model.review_threshold, "review").otherwise("observe")
    return (
        model.risk(rows)
        .withColumn("risk_band", band)
        .withColumn("predicted_class", F.when(risk >= model.threshold, "abuse").otherwise("benign"))
        .withColumn("model_abstained", F.col("risk_band") == "review")
        .withColumn("threshold", F.lit(model.threshold))
        .withColumn("model", F.lit(model.name))
    )


def medians(rows: DataFrame, features: Sequence[str] = FEATURES) -> dict[str, float]:
    """Median of every feature on the train side: ten numbers."""
    values = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    long = rows.filter(F.col("split") == "train").select(F.inline(values))
    found = order_statistics(long, ["feature"], "value", {"m": lambda n: F.floor((n + 1) / 2)})
    return {r["feature"]: r["m"] for r in found.collect()}


def linear_contributions(model: Fitted) -> Column:
    """Exact contribution of each feature: coefficient times standardised value."""
    scaler, logistic = model.pipeline.stages[1], model.pipeline.stages[2]
    parts = []
    for f, mean, std, coef in zip(model.features, scaler.mean, scaler.std, logistic.coefficients):
        z = (F.col(f) - float(mean)) / (float(std) or 1.0)
        parts.append(F.struct(F.lit(f).alias("feature"), (z * float(coef) / model.temperature).alias("contribution")))
    return F.array(*parts)


def ablated(model: Fitted, rows: DataFrame, at: dict[str, float], keys: Sequence[str]) -> DataFrame:
    """Change in risk when one feature is held at its median: one copy of each row per feature, next to the row's own risk."""
    full = model.risk(rows.select(*keys, *model.features)).select(*keys, F.col("risk").alias("full"), *model.features)
    copies = [
        F.struct(F.lit(g).alias("feature"), *[(F.lit(at[f]) if f == g else F.col(f)).alias(f) for f in model.features]) for g in model.features
    ]
    scored = model.risk(full.select(*keys, "full", F.inline(F.array(*copies))))
    return scored.select(*keys, "feature", (F.col("full") - F.col("risk")).alias("contribution"))


def top_contributions(contributions: Column, *, limit: int = 6) -> Column:
    """The largest contributions by size."""
    sized = F.transform(contributions, lambda c: F.struct(F.abs(c["contribution"]).alias("size"), c["feature"].alias("feature"), c["contribution"].alias("contribution")))
    return F.slice(F.sort_array(sized, asc=False), 1, limit)


def importance(contributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, as shares of one (ten rows from the aggregate on)."""
    means = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m")).withColumn("all", F.lit(1))
    total = means.groupBy("all").agg(F.sum("m").alias("total"))
    return means.join(total, "all").select("feature", F.coalesce(F.try_divide("m", "total"), F.lit(0.0)).alias("importance"))


def _test_metrics(model: Fitted, rows: DataFrame, label: str) -> DataFrame:
    scored = score(model, rows.filter(F.col("split") == "test")).withColumn("model", F.lit(label))
    return E.ranking(scored).join(E.confusion(scored), "model").select("model", "rows", "pr_auc", "roc_auc", "precision", "recall", "cost_paise")


def _side_by_side(fits: Sequence[Callable[[], DataFrame]]) -> list[DataFrame]:
    """Independent fits at the same time: each starts many small jobs, which leave most cores idle when they come one after another."""
    spark = SparkSession.active()
    with ThreadPoolExecutor(max_workers=max(1, len(fits))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(fit)) for fit in fits]]


def _stack(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def ladder(rows: DataFrame, names: Sequence[str] = ("boosted", "logistic", "forest"), *, rounds: dict[str, int] | None = None) -> DataFrame:
    """Every model class on the same split, and by how much each ranks worse than the first."""
    sizes = {"boosted": 200, "logistic": 0, "forest": 300, **(rounds or {})}
    found = _stack(_side_by_side([partial(lambda n: stage(_test_metrics(train(rows, n, rounds=sizes[n]), rows, n), "ladder"), n) for n in names]))
    first = F.max(F.when(F.col("model") == names[0], F.col("pr_auc"))).over(Window.partitionBy(F.lit(0)))  # one row per model
    return found.withColumn("pr_auc_delta", F.col("pr_auc") - first)


def ablation(rows: DataFrame, name: str = "boosted", *, rounds: int = 200) -> DataFrame:
    """The same model with feature groups left out."""
    groups = {"all": FEATURES, "entity_only": ENTITY_FEATURES, "traffic_only": TRAFFIC_FEATURES}
    fit = lambda label, f: stage(_test_metrics(train(rows, name, features=f, rounds=rounds), rows, label), "ablation")
    return _stack(_side_by_side([partial(fit, g, f) for g, f in groups.items()]))


def learning_curve(rows: DataFrame, name: str = "boosted", *, fractions: Sequence[float] = (0.25, 0.5, 1.0), rounds: int = 200) -> DataFrame:
    """Ranking quality on the validation side as the train side grows."""

    def fit(fraction: float) -> DataFrame:
        kept = rows.filter((F.col("split") != "train") | (hash_fraction(F.col("row_id").cast("string"), "curve:") < fraction))
        model = train(kept, name, rounds=rounds)
        judged = model.risk(kept.filter(F.col("split") == "validation")).withColumn("fraction", F.lit(float(fraction)))
        return stage(E.ranking(judged, ["fraction"]).select("fraction", "rows", "pr_auc"), "curve")

    return _stack(_side_by_side([partial(fit, fraction) for fraction in fractions]))


def stability(rows: DataFrame, *, seeds: Sequence[int] = (1, 2, 3, 4, 5), names: tuple[str, str] = ("boosted", "logistic"), rounds: int = 200) -> DataFrame:
    """Gap between two model classes over several group splits: mean, spread, wins."""

    def fit(seed: int, name: str) -> DataFrame:
        split = grouped_split(rows.drop("split"), seed=seed)
        return stage(_test_metrics(train(split, name, rounds=rounds, seed=seed), split, name).select(F.lit(seed).alias("seed"), "model", "pr_auc"), "stability")

    found = _stack(_side_by_side([partial(fit, seed, name) for seed in seeds for name in names]))
    of = lambda name: F.max(F.when(F.col("model") == name, F.col("pr_auc"))).alias(name)
    gap = F.col(names[1]) - F.col(names[0])
    return found.groupBy("seed").agg(of(names[0]), of(names[1])).agg(
        F.count(F.lit(1)).alias("splits"), F.avg(gap).alias("mean"), F.stddev_pop(gap).alias("sd"), F.min(gap).alias("low"), F.max(gap).alias("high"),
        F.sum((gap < 0).cast("bigint")).alias("served_wins"),
    )


def leakage(grouped: DataFrame, naive: DataFrame, name: str = "logistic", *, rounds: int = 200) -> DataFrame:
    """Ranking quality under a group split and under a row split, with one and the same model class."""
    sides = {"grouped": grouped, "naive": naive}
    fit = lambda label: stage(_test_metrics(train(sides[label], name, rounds=rounds), sides[label], label), "leakage")
    return _stack(_side_by_side([partial(fit, label) for label in sides]))


def canary(rows: DataFrame, model_pr_auc: float, *, margin: float = 0.15, features: Sequence[str] = FEATURES) -> DataFrame:
    """Whether one feature alone comes within the margin of the model."""
    alone = E.single_feature_auc(rows.filter(F.col("split") == "test"), features)
    strongest = alone.agg(F.max_by(F.struct("feature", "auc"), F.struct("separation", "feature")).alias("s")).first()["s"]
    sign = 1.0 if strongest["auc"] >= 0.5 else -1.0
    test = rows.filter(F.col("split") == "test")
    alone = test.select("y", (F.col(strongest["feature"]) * sign).alias("risk"), F.lit(strongest["feature"]).alias("feature"))
    rule = E.ranking(alone, ["feature"])
    lift = F.lit(model_pr_auc) - F.col("pr_auc")
    return rule.select(
        "feature", F.lit(strongest["auc"]).alias("auc"), F.col("pr_auc").alias("rule_pr_auc"), F.lit(model_pr_auc).alias("model_pr_auc"),
        lift.alias("lift"), (lift < margin).alias("trivially_separable"),
    )
