"""Operator 10: benchmark passages in documents, by SimHash of item-sized windows. DataFrame functions only.

A window as long as an item can only reach the similarity if it shares a five-word shingle with it, so windows are laid where a
document has a shingle of an item, shifted by the shingle's place in the item. A window that would begin before the text is laid
without the words that lie there, as at the end of a text, and at its full length from the first word too. Each window and each item gets a
64-bit SimHash of its shingles, weighted by how often they occur. The fingerprints are cut into one block more than the
radius: two fingerprints within the radius agree on a block, so joining on blocks misses none of them.
Candidates within the radius are verified by the weighted Jaccard similarity of their shingles, 0.75 or more.

At that similarity fingerprints differ in 11 bits on average (standard deviation 3); the radius of 23 is four deviations away.

Words are runs of letters and digits, lower-cased, so punctuation and case do not hide a passage. An item of fewer
than five words is one shingle of its own length.

Defined cases: null and empty texts and items match nothing; several items and several places in a text count each; rows that
repeat an id are judged each by its own text; items with the same id are kept apart by text; an empty benchmark leaves every document clean;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.text import table
from cardwatch.session import stage

SHINGLE = 5
RADIUS = 23
SIMILARITY = 0.75
NOT_WORD = r"[^\p{L}\p{N}]+"
BITS = 64


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shingles(of: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words."""
    count = F.size(of) - size + 1
    run = lambda i: F.xxhash64(*[F.get(of, i + k) for k in range(size)])
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), run)).otherwise(
        F.array().cast("array<bigint>")
    )


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the hashes have it set; a hash counts as often as it occurs."""
    votes = lambda b: F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.getbit(h, b).cast("int") * 2 - 1)
    bit = lambda acc, b: acc.bitwiseOR(F.when(votes(b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), bit)


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 pairs of (block number, its bits)."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND((1 << (b - a)) - 1).alias("value"))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
        ]
    )


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (own key), item_id, n_words, size (of its shingles), shingles, fingerprint."""
    split = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    sized = split.select(
        "item_id",
        F.xxhash64("item_id", "w").alias("item"),
        F.size("w").alias("n_words"),
        F.least(F.size("w"), F.lit(SHINGLE)).alias("size"),
        "w",
    )
    of_size = F.coalesce(*[F.when(F.col("size") == k, shingles(F.col("w"), k)) for k in range(1, SHINGLE + 1)])
    return sized.withColumn("shingles", of_size).withColumn("fingerprint", simhash(F.col("shingles"))).drop("w").dropDuplicates(["item"])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, start (word), similarity for every window that holds an item."""
    items = stage(benchmark_items(benchmark), "bench-items")
    sizes = [r[0] for r in items.select("size").distinct().orderBy("size").collect()]  # at most five
    if not sizes:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start int, similarity double"
        )
    places = stage(items.select("item", "size", "n_words", F.posexplode("shingles").alias("at", "hash")), "bench-places")

    # where a document shares a shingle with an item
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    found = None
    for size in sizes:
        seen = read.select("doc_id", "text_hash", F.posexplode(shingles(F.col("w"), size)).alias("pos", "hash"))
        own = places.filter(F.col("size") == size)
        begin = F.col("pos") - F.col("at")
        of = lambda start, length: F.struct(start.alias("start"), length.alias("length"))
        whole, cut = of(F.greatest(begin, F.lit(0)), F.col("n_words")), of(F.lit(0), F.col("n_words") + begin)
        hit = seen.join(own, "hash").select("doc_id", "text_hash", "item", "size", F.inline(F.when(begin < 0, F.array(whole, cut)).otherwise(F.array(whole))))
        found = hit if found is None else found.unionByName(hit)
    laid = stage(found.distinct(), "bench-windows")

    # fingerprints of the windows
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    window = F.slice(F.col("w"), F.col("start") + 1, F.col("length"))
    of_size = F.coalesce(*[F.when(F.col("size") == k, shingles(F.col("words"), k)) for k in sizes])
    windows = stage(
        texts.join(laid, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
        .select("doc_id", "text_hash", "item", "start", "length", "size", words(F.col("text")).alias("w"))
        .select("doc_id", "text_hash", "item", "start", "length", "size", window.alias("words"))
        .select("doc_id", "text_hash", "item", "start", "length", of_size.alias("shingles"))
        .filter(F.size("shingles") > 0)
        .withColumn("fingerprint", simhash(F.col("shingles"))),
        "bench-fingerprints",
    )

    # multi-index: agree on a block, then be within the radius
    side = lambda df, *more: df.select(*more, "item", "fingerprint", F.inline(blocks(F.col("fingerprint"), RADIUS)))
    left = side(windows, "doc_id", "text_hash", "start", "length").withColumnRenamed("fingerprint", "of_window")
    near = F.bit_count(F.col("of_window").bitwiseXOR(F.col("fingerprint"))) <= RADIUS
    close = left.join(side(items), ["item", "block", "value"]).filter(near).select("doc_id", "text_hash", "start", "length", "item").distinct()
    close = stage(close, "bench-close")

    # weighted Jaccard similarity on the shingles themselves
    key = ["doc_id", "text_hash", "start", "length", "item"]
    counted = (
        close.join(windows.select(*[F.col(k).alias(f"_{k}") for k in key], "shingles"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
        .dropDuplicates(key)
        .select(*key, F.size("shingles").alias("n"), F.explode("shingles").alias("hash"))
        .groupBy(*key, "n", "hash")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    weights = places.groupBy("item", "hash").agg(F.count(F.lit(1)).alias("own"))
    shared = counted.join(weights, ["item", "hash"]).groupBy(*key, "n").agg(F.sum(F.least("times", "own")).alias("both"))
    whole = items.select("item", "item_id", F.size("shingles").alias("m"))
    similarity = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    return (
        shared.join(whole, "item").withColumn("similarity", similarity).filter(F.col("similarity") >= SIMILARITY).select("doc_id", "text_hash", "item_id", "start", "similarity")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, items (sorted distinct), similarity (the largest) of documents that hold an item."""
    found = stage(matches(docs, benchmark), "bench-matches")
    per_item = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max("similarity").alias("similarity"))
    # one entry per benchmark item at most
    return per_item.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (all columns) with contaminated, items and similarity."""
    docs = docs.drop("contaminated", "items", "similarity")
    bad = stage(contaminated(docs, benchmark), "bench-contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "items", "similarity")
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    return keyed.join(bad, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left").select(
        "doc.*", F.col("items").isNotNull().alias("contaminated"), "items", "similarity"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    bad = stage(contaminated(docs, benchmark), "bench-contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    return keyed.join(bad, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_anti").select("doc.*")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select(
        "doc_id", "contaminated", F.coalesce(F.array_join("items", ","), F.lit("")).alias("item_ids"), "similarity"
    )


OP10_SQL = f"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
bs AS (
  SELECT item_id, len(w) AS n_words, i.i - 1 AS at, array_to_string(w[i.i:i.i + 4], ' ') AS s
  FROM b, unnest(range(1, len(w) - 3)) i(i) WHERE len(w) >= 5),
ds AS (SELECT doc_id, i.i - 1 AS pos, array_to_string(w[i.i:i.i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) i(i) WHERE len(w) >= 5),
laid AS (SELECT DISTINCT ds.doc_id, bs.item_id, bs.n_words, greatest(ds.pos - bs.at, 0) AS start FROM ds JOIN bs USING (s)),
win AS (
  SELECT l.doc_id, l.item_id, l.start, x.s, count(*) AS times
  FROM laid l JOIN ds x ON x.doc_id = l.doc_id AND x.pos >= l.start AND x.pos <= l.start + l.n_words - 5 GROUP BY ALL),
size AS (SELECT doc_id, item_id, start, sum(times) AS n FROM win GROUP BY ALL),
own AS (SELECT item_id, s, count(*) AS own FROM bs GROUP BY ALL),
total AS (SELECT item_id, count(*) AS m FROM bs GROUP BY ALL),
both_ AS (SELECT win.doc_id, win.item_id, win.start, sum(least(times, own)) AS both_ FROM win JOIN own USING (item_id, s) GROUP BY ALL),
sim AS (
  SELECT doc_id, item_id, both_::DOUBLE / (n + m - both_)::DOUBLE AS similarity
  FROM both_ JOIN size USING (doc_id, item_id, start) JOIN total USING (item_id)),
hit AS (
  SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items, max(similarity) AS similarity
  FROM sim WHERE similarity >= {SIMILARITY} GROUP BY doc_id)
SELECT d.doc_id, h.doc_id IS NOT NULL AS contaminated, coalesce(array_to_string(h.items, ','), '') AS item_ids, h.similarity
FROM documents d LEFT JOIN hit h USING (doc_id)
"""
