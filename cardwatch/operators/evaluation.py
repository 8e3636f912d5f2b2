"""Decision quality over labelled traffic: families are judged side by side as scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.functions.numeric import count_true, ratio
from cardwatch.operators.incidents import drop_duplicate_views
from cardwatch.operators.rules import warrants_incident

DECISIONS = ("contain", "review", "monitor", "none")


def decision_rank(decision: Column) -> Column:
    return F.when(decision == "contain", 3).when(decision == "review", 2).when(decision == "monitor", 1).otherwise(0)


def scenario_metrics(decided: DataFrame, classes: DataFrame) -> DataFrame:
    """Per family: entities, decisions, explanations, abstentions and what they amount to.

    ``decided`` has one scope per family; ``classes`` maps scope to classification.
    """
    c = F.col
    counts = decided.groupBy("scope").agg(
        F.count(F.lit(1)).alias("entities"),
        *[count_true(c("decision") == d).alias(d) for d in DECISIONS],
        count_true(c("best") == "attack").alias("best_attack"),
        count_true(c("abstained")).alias("abstentions"),
    )
    attack = c("classification") == "attack"
    recognised = c("best_attack") > c("entities") / 2
    return counts.join(classes, "scope").select(
        "*",
        (~attack & (c("contain") > 0)).alias("false_positive"),
        (attack & (c("contain") == 0) & ~recognised).alias("false_negative"),
        (attack & (c("contain") == 0) & recognised).alias("escalated"),
    )


def metrics_totals(families: DataFrame) -> DataFrame:
    attack = F.col("classification") == "attack"
    return families.agg(
        F.sum("entities").alias("entities"),
        count_true(~attack).alias("benign_families"),
        count_true(F.col("false_positive")).alias("false_positives"),
        count_true(attack).alias("attack_families"),
        count_true(attack & (F.col("contain") > 0)).alias("attacks_contained"),
        count_true(F.col("escalated")).alias("attacks_escalated"),
        count_true(F.col("false_negative")).alias("attacks_missed"),
        ratio(F.sum("abstentions"), F.sum("entities")).alias("abstention_rate"),
    )


def pool_sweep(families: DataFrame) -> DataFrame:
    """Verdict per card-pool size, from metrics computed with one scope per pool."""
    c = F.col
    return families.select(
        "scope",
        ratio(c("contain"), c("entities")).alias("contain_share"),
        ratio(c("best_attack"), c("entities")).alias("recognised_share"),
        F.when(c("contain") > 0, "contained").when(c("best_attack") > c("entities") / 2, "recognised").otherwise("lost").alias("verdict"),
    )


def scenario_verdict(decided: DataFrame, classes: DataFrame) -> DataFrame:
    """Pass or fail per family, judged on its driving incident (strongest decision, then score)."""
    found = decided.filter(warrants_incident()).withColumns(
        {"first_ms": F.col("first_seen_ms"), "last_ms": F.col("last_seen_ms"), "detected_ms": F.lit(0)}
    )
    order = F.struct(decision_rank(F.col("decision")), F.col("score"), F.col("entity_kind"), F.col("entity_key"))
    drivers = drop_duplicate_views(found).groupBy("scope").agg(
        F.count(F.lit(1)).alias("opened"),
        count_true(F.col("decision").isin("contain", "review")).alias("raised"),
        F.max_by(F.struct("best", "decision"), order).alias("driver"),
    )
    best = F.coalesce(F.col("driver.best"), F.lit("insufficient_evidence"))
    decision = F.coalesce(F.col("driver.decision"), F.lit("none"))
    acted = decision.isin("contain", "review")
    zero = F.lit(0).cast("bigint")
    return classes.join(drivers, "scope", "left").select(
        "scope", "classification", best.alias("best"), decision.alias("decision"),
        F.coalesce("opened", zero).alias("opened"), F.coalesce("raised", zero).alias("raised"),
        F.when(F.col("classification") == "attack", (best == "attack") & acted).otherwise((best != "attack") & ~acted).alias("passed"),
    )


def comparison_cases(decided: DataFrame) -> DataFrame:
    """Per family and kind of entity, the one with the most to answer for."""
    # the most failures, then the most attempts, then the first name: a fixed-size aggregate, so no family is sorted in one task
    best = F.min_by(F.struct(*decided.columns), F.struct(-F.col("failures"), -F.col("attempts"), F.col("entity_key"))).alias("row")
    return decided.groupBy("scope", "entity_kind").agg(best).select("row.*")
