"""Rows whose key is among other keys, before any of them is moved: one bit per slot of the keys' hashes.

A join with keys too many to broadcast moves both of its sides whole. The bits, a few per key, are small enough to bring to the rows instead, so that only
marked rows take part in the join. A mark errs to one side: every key that is among the keys is marked, and of the others one in SLOTS to 2 SLOTS. From
MOST / SLOTS keys on the bits no longer grow and more rows are marked, until the join is what it was without them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.session import stage

SLOTS, MOST, PAGE = 16, 1 << 27, 1 << 15  # slots per key, slots at most, slots in a row of bits


def marked(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """df with a column ``marked``: false only where the key is not among the keys (a table of one column)."""
    slots = max(PAGE, min(MOST, 1 << (SLOTS * keys.count()).bit_length()))
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(slots))
    own = keys.toDF("key").select(slot(F.col("key")).alias("slot"))
    pages = own.groupBy(F.expr(f"slot div {PAGE}").alias("_page")).agg(F.bitmap_construct_agg(F.col("slot") % PAGE).alias("_bits"))
    placed = df.withColumn("_slot", slot(key)).withColumn("_page", F.expr(f"_slot div {PAGE}"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_slot % {PAGE} div 8 as int) + 1, 1)")), 16, 10).cast("long")
    bit = F.getbit(byte, (F.col("_slot") % 8).cast("int")) == 1
    # at most 16 MB whatever the tables, hence the hint
    found = placed.join(F.broadcast(stage(pages, "marks")), "_page", "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(bit, F.lit(False)).alias("marked"))
