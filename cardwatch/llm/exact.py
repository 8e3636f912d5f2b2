"""Operator 9: exact duplicates against an immutable snapshot, screened by binary-fuse filters.

A snapshot never changes, so a static filter over its digests can be built once per shard of the digest
range. A new batch is first grouped by itself; each of its digests is then screened by the filter of its
shard. Negatives are certainly new. Positives (true ones and one in 256 others) join the snapshot's exact
buckets, keyed by SHA-256, and the bytes of every bucket with more than one row are compared.

Digests are spread evenly over shards whatever the copies are, and copies are summed before any shuffle,
so a group that holds a third of the rows is one row in every step but the last join, which Spark
splits by size.

Defined cases: null text counts as empty; texts are equal when identical after lower-casing A-Z; of equal texts the largest id
stays, a null id only if there is no other; of rows that repeat the id, one stays; an empty table gives no
rows. Two different texts with one SHA-256 stop the job with an error instead of being merged.
"""

from __future__ import annotations

from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cardwatch.llm import fuse
from cardwatch.llm.text import lower_ascii, table
from cardwatch.session import stage

SHARD_KEYS = 250_000
MIN_SHARDS = 64  # small inputs are spread over tasks too


def normalised(text="text"):
    return lower_ascii(F.coalesce(F.col(text), F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row (unique), sha (hex), digest (64 bits)."""
    norm = normalised()
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(norm, 256).alias("sha"), F.xxhash64(norm).alias("digest"))


def buckets(rows: DataFrame) -> DataFrame:
    """One row per text: the row that stays (largest id) and the number of rows."""
    newest = F.struct("doc_id", "row")
    return rows.groupBy("digest", "sha").agg(F.max(newest).alias("keep"), F.count(F.lit(1)).alias("n"))


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One static filter per shard of the snapshot's digests: shard, seed, length, segments, data."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, data = fuse.build(pdf["digest"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [seed], "length": [length], "segments": [segments], "data": [data]})

    keys = snapshot.select(F.pmod("digest", F.lit(shards)).alias("shard"), "digest")
    return keys.groupBy("shard").applyInPandas(build, "shard long, seed long, length long, segments long, data binary")


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The batch's buckets whose digest may be in the snapshot."""

    def probe(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or own.empty:
            return pdf.iloc[:0]
        x = own.iloc[0]
        found = (int(x["seed"]), int(x["length"]), int(x["segments"]), x["data"])
        return pdf[fuse.contains(found, pdf["digest"].to_numpy())]

    keyed = batch.select("digest", "sha").withColumn("shard", F.pmod("digest", F.lit(shards)))
    schema = "digest long, sha string, shard long"
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, schema).drop("shard")


def check_bytes(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """sha, same: whether all rows of a bucket hold the same bytes."""
    norm = normalised()
    return (
        docs.select(norm.alias("norm"), F.sha2(norm, 256).alias("sha"))
        .join(repeated.select("sha"), "sha", "left_semi")
        .groupBy("sha")
        .agg((F.min("norm") == F.max("norm")).alias("same"))
    )


def deduplicate(docs: DataFrame, in_snapshot) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, in_snapshot (the row was part of the snapshot).

    ``in_snapshot`` is a condition on doc_id that tells the snapshot's rows from the new batch's.
    """
    rows = stage(digests(docs).withColumn("old", F.coalesce(in_snapshot, F.lit(False))), "exact-rows")
    snapshot = stage(buckets(rows.filter("old")), "exact-snapshot")
    batch = stage(buckets(rows.filter("NOT old")), "exact-batch")
    shards = max(MIN_SHARDS, ceil(max(snapshot.count(), batch.count()) / SHARD_KEYS))
    filters = stage(build_filters(snapshot, shards), "exact-filters")
    positive = stage(screen(batch, filters, shards), "exact-positive")

    hits = positive.join(snapshot, ["digest", "sha"], "left_semi")
    met = stage(
        batch.join(hits, ["digest", "sha"], "left_semi")
        .unionByName(snapshot.join(hits, ["digest", "sha"], "left_semi"))
        .groupBy("digest", "sha")
        .agg(F.max("keep").alias("keep"), F.sum("n").alias("n")),
        "exact-met",
    )
    alone = batch.unionByName(snapshot).join(met, ["digest", "sha"], "left_anti")
    groups = stage(alone.unionByName(met), "exact-groups")

    same = stage(check_bytes(docs, groups.filter("n > 1")), "exact-bytes")
    if not same.filter("NOT same").isEmpty():
        raise ValueError("different texts share a SHA-256 digest")
    keep = groups.select("sha", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), F.col("n").alias("group_size"))
    return rows.join(keep, "sha").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("old").alias("in_snapshot")
    )


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The older half of the id range is the snapshot, the newer half and rows without id the batch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = None if low is None else low + (high - low) // 2
    return deduplicate(docs, F.col("doc_id") <= F.lit(middle))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS sha FROM documents),
e AS (SELECT max(doc_id) - min(doc_id) AS width, min(doc_id) AS low FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY sha) AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY sha) AS kept, sha AS text_sha256, doc_id <= (SELECT low + width // 2 FROM e) AS in_snapshot
FROM d
"""
