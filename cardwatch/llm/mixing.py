"""Operator 1: mix sources to target weights by weighted fair queueing.

Every source hands out its documents in a shuffled order (a hash of the id), again from the start when
its target is larger than itself. A document's virtual finish time is the number of tokens its source
has handed out so far divided by the source's target, so at virtual time 1 every source has given its
target. The mixture is the global order by finish time, cut where the total budget is reached.

Nothing is ordered in one task: a source's queue is cut into slices of the hash range and virtual time
into slots, both holding a bounded number of tokens on average; totals per slice and slot are cumulated.

Defined cases: null text has size 0; null source is a source of its own, last in order; documents of
size 0 take nothing; rows repeated with the same id count one by one; rows equal in id, source and size
are interchangeable; an empty table gives no rows; a source without words has target 0.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from cardwatch.llm.text import table, words_in
from cardwatch.session import stage

MAX_PIECES = 65_536
PIECE_WORDS = 65_536
MADE = ("source_size", "target", "vft", "taken")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """A position in 0 .. 2^60 that depends on the id and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeats: int) -> DataFrame:
    """source, rank, source_size, target from (source, size) rows.

    The budget is shared by weight; a source stops at ``repeats`` times its size and what it leaves is
    shared again. In order of capacity per weight, the sources that stop are a prefix: source k stops if
    its capacity per weight is at most the level that the rest of the budget gives the sources from k on.
    One row per source, so the windows hold as many rows as there are sources.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn("rank", F.row_number().over(in_order) - 1).withColumn(
        "weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int"))
    )
    capacity = F.col("source_size") * float(repeats)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ranked.withColumn("budget", F.sum("source_size").over(every) * float(share))
        .withColumn("given", F.coalesce(F.sum(capacity).over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("given")) / F.col("open"))
        .withColumn("stops", F.col("level") * F.col("weight") >= capacity)
        # the first source that does not stop sets the level of all that follow
        .withColumn("common", F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))).over(every)["level"])
    )
    target = F.when(F.col("stops"), capacity).otherwise(F.least(capacity, F.col("common") * F.col("weight")))
    return level.select("source", "rank", "source_size", target.cast("double").alias("target"))


def fair_mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = 0,
) -> DataFrame:
    """docs (doc_id, source, size, ...) with source_size, target, vft (finish times of its passes that
    the mixture holds) and taken.

    Offsets and the cut are found on ids and sizes alone; after that the documents are moved once. Columns
    beyond the first three travel in a struct, so their names cannot clash with those used here.
    """
    sizes = stage(docs.select("doc_id", "source", "size"), "mix-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    pieces = max(1, min(MAX_PIECES, ceil(total / PIECE_WORDS)))
    placed = lambda df: df.withColumn("_key", shuffle_key(F.col("doc_id"), seed)).withColumn(
        "_piece", F.floor(F.col("_key") / ceil(2**60 / pieces)).cast("int")
    )

    # offsets of the slices of each source's queue, with what is known of the source
    sums = placed(sizes).groupBy("source", "_piece").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sizes, weights, share, repeats).withColumnRenamed("source", "_source")
    offsets = stage(
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .select(F.col("source").alias("_source"), F.col("_piece").alias("_at"), "_before", "source_size", "target"),
        "mix-offsets",
    )
    cut = _cut(stage(_queue(placed(sizes), offsets, repeats), "mix-queues"), pieces)

    docs = docs.select("doc_id", "source", "size", F.struct(*[c for c in docs.columns if c not in MADE]).alias("_doc"))
    if cut is None:
        kept = F.array().cast("array<double>")
    else:
        end = F.struct(F.lit(cut["t"]).alias("t"), F.lit(cut["k"]).alias("k"), F.lit(cut["d"]).alias("d"), F.lit(cut["s"]).alias("s"))
        item = lambda t: F.struct(t.alias("t"), F.col("_key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s"))
        kept = F.filter("_vft", lambda t: item(t) <= end)
    return _queue(placed(docs), offsets, repeats).withColumn("vft", kept).select(
        "_doc.*", "source_size", "target", "vft", (F.size("vft") * F.col("size")).cast("long").alias("taken")
    )


def _queue(placed: DataFrame, offsets: DataFrame, repeats: int) -> DataFrame:
    """placed with source_size, target and _vft, the finish time in each pass over the source."""
    inside = Window.partitionBy("source", "_piece").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        placed.withColumn("_run", F.sum("size").over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_piece") == F.col("_at")))
        .withColumn("_run", F.col("_run") + F.col("_before"))
    )
    finish = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda p: (F.col("_run") + p * F.col("source_size")) / F.col("target"))
    none = F.array().cast("array<double>")
    return queued.withColumn("_vft", F.when((F.col("size") > 0) & (F.col("target") > 0), finish).otherwise(none)).drop(
        "_source", "_at", "_before", "_piece", "_run"
    )


def _cut(queued: DataFrame, pieces: int):
    """The last item of the global order that fits the budget (one row), or None if there is none.

    Slots hold about one piece of the budget; the last one takes all finish times from 4 on, which the
    mixture reaches only if single documents are many times their source's target.
    """
    budget = queued.select("source", "target").distinct().agg(F.sum("target")).first()[0]
    item = F.struct("t", F.col("_key").alias("k"), F.col("doc_id").alias("d"), F.col("size").alias("s"))
    items = queued.select("_key", "doc_id", "size", F.explode("_vft").alias("t")).withColumn(
        "_slot", F.least(F.floor(F.col("t") * pieces), F.lit(4 * pieces)).cast("int")
    )
    upto = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = items.groupBy("_slot").agg(F.sum("size").alias("_sum")).withColumn("_end", F.sum("_sum").over(upto))
    over = slots.filter(F.col("_end") > budget).orderBy("_slot").limit(1).first()
    if over is None:
        return items.agg(F.max(item).alias("m")).first()["m"]
    inside = Window.orderBy("t", "_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        items.filter(F.col("_slot") == over["_slot"])
        .withColumn("_end", F.sum("size").over(inside) + F.lit(over["_end"] - over["_sum"]))
        .filter(F.col("_end") <= budget)
        .agg(F.max(item).alias("m"))
        .first()["m"]
    )
    return last or items.filter(F.col("_slot") < over["_slot"]).agg(F.max(item).alias("m")).first()["m"]


def mixture(mixed: DataFrame) -> DataFrame:
    """The mixture itself: one row per pass the mix holds, range-sorted by finish time."""
    return mixed.withColumn("finish", F.explode("vft")).orderBy("finish", "doc_id")


def sized(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", words_in(F.col("text")).alias("size"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    sizes = stage(sized(table(spark, sf_dir, "documents")), "mix-sizes")
    return fair_mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM src),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked),
filled AS (
  SELECT *, 2.0::DOUBLE * source_size AS capacity, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0.0) AS given, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0) AS open,
    source_size::DOUBLE / weight AS per
  FROM weighed WINDOW w AS (ORDER BY source_size::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levelled AS (SELECT *, (budget - given) / open AS level, ((budget - given) / open) * weight >= capacity AS stops FROM filled),
common AS (SELECT first(level ORDER BY per, rk) AS level FROM levelled WHERE NOT stops),
targets AS (
  SELECT source, source_size, CASE WHEN stops THEN capacity ELSE least(capacity, (SELECT level FROM common) * weight) END AS target FROM levelled),
queue AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, ('0x' || substr(md5('0:' || s.doc_id), 1, 15))::BIGINT AS k,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY ('0x' || substr(md5('0:' || s.doc_id), 1, 15))::BIGINT, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS run
  FROM s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT q.doc_id, q.size, q.k, (q.run + p.p * q.source_size)::DOUBLE / q.target AS t
  FROM queue q, (VALUES (0), (1)) p(p) WHERE q.size > 0 AND q.target > 0),
cut AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY t, k, doc_id, size ROWS UNBOUNDED PRECEDING) <= (SELECT sum(target) FROM targets) AS fits FROM items),
got AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM cut WHERE fits GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken FROM queue q LEFT JOIN got g USING (doc_id)
"""
