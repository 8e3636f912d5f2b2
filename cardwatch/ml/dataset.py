"""Model features, training rows and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cardwatch.functions.numeric import ratio
from cardwatch.schemas import FEATURES

# Features that describe the shop rather than the entity.
TRAFFIC_FEATURES = ("infra_share", "top_session_failure_share", "log_failing_sessions")
ENTITY_FEATURES = tuple(f for f in FEATURES if f not in TRAFFIC_FEATURES)
SEED = 20260826


def with_features(judged: DataFrame) -> DataFrame:
    """Add the model's features to vectors that carry their shop's context."""
    cards = F.coalesce(F.col("distinct_cards"), F.lit(0))
    values = {
        "log_attempts": F.log1p(F.col("attempts").cast("double")),
        "failure_rate": ratio(F.col("failures"), F.col("attempts")),
        "approval_rate": F.col("approval_rate"),
        "infra_share": F.col("shop_infra_failure_share"),
        "cards_per_attempt": ratio(cards, F.col("attempts")),
        "small_amount_share": F.col("small_amount_share"),
        "burstiness": F.col("burstiness"),
        "recovery_rate": F.col("recovery_rate"),
        "top_session_failure_share": F.col("shop_top_session_failure_share"),
        "log_failing_sessions": F.log1p(F.col("shop_failing_sessions").cast("double")),
    }
    rest = [c for c in judged.columns if c not in FEATURES]
    return judged.select(*rest, *[values[f].alias(f) for f in FEATURES])


def cap_per_class(rows: DataFrame, *, abuse: int = 4, benign: int = 8) -> DataFrame:
    """The worst few entities per group, kind and class (rank limits are applied before the shuffle)."""
    worst = W.partitionBy("group", "entity_kind", "is_abuse").orderBy(F.desc("failures"), F.desc("attempts"), "entity_key")
    ranked = rows.withColumn("_n", F.row_number().over(worst)).filter(F.col("_n") <= max(abuse, benign))
    return ranked.filter(F.col("_n") <= F.when(F.col("is_abuse") == 1, abuse).otherwise(benign)).drop("_n")


def cap_benign_ratio(rows: DataFrame, *, floor: int = 15, times: int = 3, salts: int = 64) -> DataFrame:
    """All abuse of a group, and its worst benign entities up to max(floor, times x abuse).

    The limit differs per group, so a salted first ranking leaves at most the limit per salt
    before the final one: a very large group is never ranked in one task.
    """
    abuse = rows.groupBy("group").agg(F.sum("is_abuse").alias("_abuse"))
    limit = F.greatest(F.lit(floor), F.col("_abuse") * times)
    keep = lambda n: (F.col("is_abuse") == 1) | (F.col(n) <= limit)
    order = (F.desc("failures"), F.desc("attempts"), "entity_key")
    salted = rows.join(abuse, "group").withColumn("_salt", F.pmod(F.xxhash64("entity_key"), F.lit(salts)))
    first = salted.withColumn("_m", F.row_number().over(W.partitionBy("group", "is_abuse", "_salt").orderBy(*order))).filter(keep("_m"))
    benign = first.filter(F.col("is_abuse") == 0).withColumn("_n", F.row_number().over(W.partitionBy("group").orderBy(*order))).filter(keep("_n"))
    kept = first.filter(F.col("is_abuse") == 1).unionByName(benign.drop("_n"))
    return kept.drop("_abuse", "_salt", "_m")


def union_training(corpus: DataFrame, merchant: DataFrame) -> DataFrame:
    """Corpus rows and labelled merchant rows as one training table."""
    columns = [*FEATURES, "is_abuse", "group", "origin"]
    return corpus.select(*columns).unionByName(merchant.select(*columns))


def hash_fraction(key: Column, salt: str) -> Column:
    """Stable number in [0, 1) from a key: the same on every run, executor and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _sides(outer: Column, inner: Column, test: float, validation: float) -> Column:
    return F.when(outer < test, "test").when(inner < validation, "validation").otherwise("train")


def grouped_split(rows: DataFrame, *, test: float = 0.25, validation: float = 0.2, seed: int = SEED) -> DataFrame:
    """Train, validation or test by group: no group is ever on two sides."""
    key = F.col("group")
    return rows.withColumn("split", _sides(hash_fraction(key, f"outer{seed}:"), hash_fraction(key, f"inner{seed}:"), test, validation))


def naive_split(rows: DataFrame, row_id: Column, *, test: float = 0.25, validation: float = 0.2, seed: int = SEED) -> DataFrame:
    """Row-wise split that ignores groups, kept only to measure what it would flatter."""
    key = row_id.cast("string")
    return rows.withColumn(
        "split",
        F.when(hash_fraction(key, f"naive{seed}:") < test, "test").when(hash_fraction(key, f"naive{seed}:") < test + validation, "validation").otherwise("train"),
    )


def group_overlap(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Number of groups that appear on both sides of a split."""
    groups = lambda side: rows.filter(F.col("split") == side).select("group")
    return groups(a).intersect(groups(b)).agg(F.count(F.lit(1)).alias("shared_groups"))
