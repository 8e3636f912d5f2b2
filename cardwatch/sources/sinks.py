"""Writers, snapshots, retention and replay jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cardwatch import schemas
from cardwatch.config import DAY_MS
from cardwatch.sources.versions import SnapshotTable


def read_jdbc(spark: SparkSession, url: str, table: str, *, key: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """One-off import of a service table, split over a numeric key (the driver jar must be present)."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions)
        .load()
    )


def write_snapshot(df: DataFrame, path: str, *, day_of: str) -> None:
    """Parquet by source and day. Rebalancing joins small pieces of a day and splits very large days."""
    dated = df.withColumn("day", F.to_date(F.timestamp_millis(F.col(day_of))))
    dated.hint("rebalance", "source", "day").write.mode("overwrite").partitionBy("source", "day").parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_training(rows: DataFrame, path: str) -> None:
    """Training table as CSV with six decimals."""
    rounded = [F.round(c, 6).alias(c) for c in schemas.FEATURES]
    rows.select(*rounded, "is_abuse", "group", "origin").write.mode("overwrite").option("header", True).csv(path)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRAINING).option("header", True).csv(path)


def content_hash(rows: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: row count and two folds over row hashes."""
    h = F.xxhash64(*rows.columns)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("sum_hash")
    )


def labelled_rows(incidents: DataFrame) -> DataFrame:
    """Training rows from incidents a person has labelled; missing features count as 0."""
    usable = incidents.filter(F.col("label").isNotNull() & F.col("features").isNotNull())
    return usable.select(
        *[F.coalesce(F.col(f"features.{c}"), F.lit(0.0)).alias(c) for c in schemas.FEATURES],
        F.col("label").cast("int").alias("is_abuse"),
        F.concat(F.lit("incident:"), F.col("incident_id")).alias("group"),
        F.lit("merchant").alias("origin"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Small aggregated report as JSON lines."""
    df.write.mode("overwrite").json(path)


def purge_payloads(inbox: DataFrame, *, now_ms: int, days: int = 7) -> DataFrame:
    """Next snapshot of the raw table: old payloads of processed rows are gone, rows stay."""
    due = (F.col("status") == "processed") & (F.col("received_ms") < now_ms - days * DAY_MS) & F.col("raw_body").isNotNull()
    return inbox.withColumn("purged_ms", F.when(due, F.lit(now_ms))).withColumn("raw_body", F.when(~due, F.col("raw_body")))


def clear_replay(rows: DataFrame, family: str | None = None) -> DataFrame:
    """Next snapshot without replayed rows (of one family, or all of them)."""
    gone = F.col("source") == "replay"
    if family is not None:
        gone = gone & F.coalesce(F.col("family") == family, F.lit(False))
    return rows.filter(~gone)


def purge_stored(table: SnapshotTable, *, now_ms: int, days: int = 7) -> list[int]:
    """Purge the stored raw table: buckets without a payload that is due stay as they are."""
    due = (F.col("status") == "processed") & (F.col("received_ms") < now_ms - days * DAY_MS) & F.col("raw_body").isNotNull()
    purged = lambda rows: purge_payloads(rows, now_ms=now_ms, days=days).withColumn("purged_ms", F.coalesce("_purged", "purged_ms"))
    return table.change_where(due, lambda rows: purged(rows.withColumnRenamed("purged_ms", "_purged")))


def clear_stored(table: SnapshotTable, family: str | None = None) -> list[int]:
    """Clear replayed rows (of one family, or all) from a stored table; buckets without any stay as they are."""
    gone = F.col("source") == "replay"
    if family is not None:
        gone = gone & F.coalesce(F.col("family") == family, F.lit(False))
    return table.change_where(gone, lambda rows: clear_replay(rows, family))


def rebase(rows: DataFrame, *, now_ms: int, newest: DataFrame) -> DataFrame:
    """Shift all times so that the newest event of each scope happens now."""
    return rows.join(newest.select("scope", "newest_ms"), "scope").withColumn(
        "at_ms", F.col("at_ms") + (F.lit(now_ms) - F.col("newest_ms"))
    ).drop("newest_ms")


def tag_replay(incidents: DataFrame, family: str) -> DataFrame:
    """Give replayed incidents without a family the family being replayed."""
    fresh = (F.col("source") == "replay") & F.col("family").isNull()
    return incidents.withColumn("family", F.when(fresh, F.lit(family)).otherwise(F.col("family")))


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("scope").agg(
        F.sum((F.col("source") == "live").cast("bigint")).alias("live"), F.sum((F.col("source") == "replay").cast("bigint")).alias("replay")
    )


def correlated_count(rows: DataFrame, *, since_ms: int) -> DataFrame:
    """Distinct payments seen since a moment."""
    seen = rows.filter((F.col("at_ms") >= since_ms) & F.col("payment_id").isNotNull())
    return seen.select("scope", "payment_id").distinct().groupBy("scope").agg(F.count(F.lit(1)).alias("payments"))
