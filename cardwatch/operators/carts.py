"""Cart pricing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def price_carts(lines: DataFrame, goods: DataFrame) -> DataFrame:
    """Total and item count per order; ``priced`` is false when any line is not in the catalogue."""
    known = lines.join(goods, "sku", "left")
    sums = known.groupBy("order_id").agg(
        F.coalesce(F.sum(F.col("price_paise") * F.col("quantity")), F.lit(0).cast("bigint")).alias("amount_paise"),
        F.sum("quantity").alias("item_count"),
        F.sum(F.col("price_paise").isNull().cast("bigint")).alias("unknown_lines"),
    )
    return sums.withColumn("priced", F.col("unknown_lines") == 0)
