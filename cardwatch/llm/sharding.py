"""Operator 5: shards by extendible hashing.

The hash of a document's id is read bit by bit. One directory cell holds all documents; a cell above the
byte limit is split on the next bit, the others stay as they are, until every cell fits. What Spark
groups is the histogram of hash prefixes, never the documents of one cell: rows are summed per fine cell
(map-side), the directory is found from those sums, and rows look their cell up.

When a finest cell is still too large, it goes on with the next bits of the id hash as long as it holds several ids.
Ids that repeat share all bits of their hash: a cell of a single id goes on with the bits of a second hash, of
the id and the row's own number, so copies of one id spread too.

Defined cases: null text has 0 bytes; null ids hash as one id and are spread like repeated ids; a document
larger than the limit is a shard of its own; rows that repeat an id may swap shards when the job
runs anew over another file layout, all others keep theirs; an empty table gives no rows.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.text import table
from cardwatch.session import stage

SHARD_BYTES = 64 << 20
FINER = 4  # bits of the histogram beyond those that an even split needs
STEP, HASH_BITS, ROUNDS = 20, 60, 12


def hash_bits(text: Column) -> Column:
    """60 bits as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _directory(cells: DataFrame, bits: int, limit: int) -> DataFrame:
    """(bucket, cell, bytes, docs, single) -> (bucket, cell, depth, prefix, leaf_bytes, leaf_docs, fits, single): the shallowest prefix
    of each cell that fits, or the whole cell, marked as not fitting."""
    at = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {bits} - depth)")
    )
    sums = at.groupBy("bucket", "depth", "prefix").agg(F.sum("bytes").alias("leaf_bytes"), F.sum("docs").alias("leaf_docs"))
    fits = (F.col("leaf_bytes") <= limit) | (F.col("leaf_docs") == 1)
    leaves = sums.withColumn("fits", fits).filter(fits | (F.col("depth") == bits))
    return (
        at.drop("bytes", "docs")
        .join(leaves, ["bucket", "depth", "prefix"])
        .groupBy("bucket", "cell")
        .agg(F.min(F.struct("depth", "prefix", "leaf_bytes", "leaf_docs", "fits")).alias("leaf"), F.first("single").alias("single"))
        .select("bucket", "cell", "leaf.*", "single")
    )


def _name(bucket: Column, prefix: Column, depth: Column) -> Column:
    """The bits read so far."""
    return F.concat(bucket, F.when(depth > 0, F.expr("lpad(bin(prefix), depth, '0')")).otherwise(F.lit("")))


def shard(docs: DataFrame, *, limit: int = SHARD_BYTES) -> DataFrame:
    """docs with shard (the bits of its hash prefix), shard_bytes and shard_docs."""
    docs = docs.drop("shard", "shard_bytes", "shard_docs")
    id_text = F.col("doc_id").cast("string")
    rows = stage(
        docs.select(
            F.struct("*").alias("doc"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
            hash_bits(F.coalesce(id_text, F.lit(""))).alias("of_id"),
            hash_bits(F.concat_ws("#", id_text, F.monotonically_increasing_id().cast("string"))).alias("of_row"),
        ),
        "shard-rows",
    )
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(40, FINER + max(0, ceil(log2(max(1, total) / limit)))) if total > limit else FINER

    def cell(name: str, used: int, size: int) -> Column:
        return F.expr(f"shiftright({name}, {HASH_BITS - used - size}) & {(1 << size) - 1}L")

    open_rows = rows.withColumn("bucket", F.lit("")).withColumn("cell", cell("of_id", 0, bits))
    settled, used, rounds = None, bits, 0
    while True:
        sums = [F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), (F.min("of_id") == F.max("of_id")).alias("single")]
        cells = stage(open_rows.groupBy("bucket", "cell").agg(*sums), "shard-cells")
        found = stage(_directory(cells, bits, limit).withColumn("name", _name(F.col("bucket"), F.col("prefix"), F.col("depth"))), "shard-directory")
        matched = open_rows.join(
            found.select("bucket", "cell", "name", "fits", "single", F.col("leaf_bytes").alias("shard_bytes"), F.col("leaf_docs").alias("shard_docs")), ["bucket", "cell"]
        )
        tight = rounds == ROUNDS or found.filter(~F.col("fits")).isEmpty()
        done = (matched if tight else matched.filter("fits")).select("doc.*", F.col("name").alias("shard"), "shard_bytes", "shard_docs")
        settled = done if settled is None else settled.unionByName(done)
        if tight:
            return settled
        # only the cells that are still too large go on: several ids with their next bits, copies of one id with bits of the rows' own
        # hash, mixed anew each round. Once all id bits are read, a cell holds one id.
        bits = min(STEP, HASH_BITS - used) or STEP
        rounds += 1
        own = F.expr(f"shiftright(xxhash64(of_row, {rounds}), 1) & {(1 << bits) - 1}L")
        further = cell("of_id", used, bits) if used < HASH_BITS else own
        open_rows = matched.filter("NOT fits").select(
            "doc", "bytes", "of_id", "of_row", F.col("name").alias("bucket"), F.when(F.col("single"), own).otherwise(further).alias("cell")
        )
        used = min(HASH_BITS, used + bits)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows of a shard meet in the tasks that write it, split by size where needed."""
    sharded.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def op5_shard(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "text").withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return shard(narrow).select("doc_id", "shard", "bytes", "shard_bytes", "shard_docs")


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
p AS (
  SELECT d.doc_id, d.bytes, x.depth, CASE WHEN x.depth = 0 THEN 0 ELSE d.h >> (60 - x.depth) END AS prefix
  FROM d, (SELECT unnest(range(0, 25))::INTEGER AS depth) x),
s AS (SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM p GROUP BY ALL),
fit AS (
  SELECT p.doc_id, p.bytes, p.depth, p.prefix, s.shard_bytes, s.shard_docs,
    row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS rn
  FROM p JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {SHARD_BYTES} OR s.shard_docs = 1)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, bytes, shard_bytes, shard_docs
FROM fit WHERE rn = 1
"""
