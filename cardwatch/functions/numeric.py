"""Numeric column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_up(value: Column, places: int = 3) -> Column:
    """Round half towards plus infinity (Spark's own round goes away from zero)."""
    scale = 10.0**places
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, and 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def decay(age_ms: Column, half_life_ms: int) -> Column:
    """Weight that halves every half-life; 1 for anything not in the past."""
    return F.when(age_ms <= 0, F.lit(1.0)).otherwise(
        F.pow(F.lit(2.0), -age_ms / F.lit(float(half_life_ms)))
    )


def count_true(condition: Column) -> Column:
    """Rows where the condition holds, as a plain sum (stays in a hash aggregate)."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
