"""Operator 8: near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of five-word shingles, 128 minima, the hashes of 32 bands of four of them, and
   the low two bits of every minimum packed into four longs. Equal sets are one node from here on, so copies cost nothing.
2. Nodes that agree on a band are candidates. The packed bits give an estimate of the similarity,
   corrected for bits that agree by chance; five standard deviations below the threshold a candidate is dropped.
3. What is left is confirmed on the full sets. Components are the transitive closure of confirmed links.

A band shared by many nodes is not expanded into pairs. Its nodes are first compared with the smallest of
them, then, where the band still joins several components, with one drawn by hash, and only nodes of
different components that share a band after that are compared with each other: as rows where a band has few nodes, block by block inside
tasks where it has many. A pair inside one component needs no comparison: it cannot change the result.

Defined cases: null and empty texts have an empty set and are linked with nothing; repeated rows and ids
are rows of their own; ``component_id`` is the smallest id in the component, null only if it holds no other; one row of each component
is ``elected``: smallest id (null last), then text hash, then row. ``kept`` are the rows whose id is their component's, which may be several where ids repeat, and
of a component without ids the elected one; rows of an empty set are all elected and kept; very long texts are read whole, in pieces;
an empty table gives no rows; other columns are not looked at.

A link of similarity 0.75 shares no band once in 200 000 cases. Sets are compared as sets of 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.linking import merge, several, still_open, with_drawn, with_first
from cardwatch.llm.marks import marked
from cardwatch.llm.shingles import mix, shingle_sets
from cardwatch.llm.text import table
from cardwatch.session import discard, freed_shuffles, own_folder, scratch, stage

MINIMA, ROWS, BITS = 128, 4, 2
BANDS, LONGS = MINIMA // ROWS, MINIMA * BITS // 64
THRESHOLD = 75  # per cent
LEAST_ESTIMATE = 0.52
FEW = 64  # nodes of a band that are compared as pairs of rows
BLOCK, BLOCK_SHINGLES = 4_096, 1 << 20  # sets and shingles of a block, two of which meet in a task
ROWS_AT_ONCE = 1_000

_MULTIPLIERS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_LOW = np.uint64((1 << BITS) - 1)
_SHIFTS = (np.arange(MINIMA, dtype=np.uint64) % np.uint64(64 // BITS)) * np.uint64(BITS)


def minima(shingles: np.ndarray) -> np.ndarray:
    found = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 8192):
        np.minimum(found, (_MULTIPLIERS[:, None] * shingles[None, i : i + 8192]).min(axis=1), out=found)
    return found


def packed(found: np.ndarray) -> np.ndarray:
    """Low bits of the minima (of a mixed copy: the minima themselves are small numbers), packed."""
    low = (mix(found) & _LOW) << _SHIFTS
    return np.bitwise_or.reduce(low.reshape(LONGS, -1), axis=1).view(np.int64)


def band_keys(found: np.ndarray) -> np.ndarray:
    step = np.uint64(0xD1342543DE82EF95)
    rows = found.reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        acc = acc * step + mix(rows[:, k])
    return mix(acc).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set), bands, bits per row; bands and bits are null for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, b.num_rows, ROWS_AT_ONCE)):
            n, digest, bands, bits = [], [], [], []
            for found in shingle_sets(batch.column("text")):
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                least = minima(found) if len(found) else None
                bands.append(None if least is None else band_keys(least))
                bits.append(None if least is None else packed(least))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            made = [pa.array(x, type=t) for x, t in zip((n, digest, bands, bits), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *made], names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "bits"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, digest binary, bands array<long>, bits array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sign, schema)


def shingle_arrays(texts: DataFrame) -> DataFrame:
    """node, shingles of every row of (node, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, ROWS_AT_ONCE) for b in batches for a in range(0, b.num_rows, ROWS_AT_ONCE)):
            arrays = [found.view(np.int64) for found in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(arrays, pa.list_(pa.int64()))], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(sets, "node long, shingles array<long>")


def text_key(doc_id: Column, text_hash: Column) -> Column:
    """A key by which a text is found again: rows without an id are told apart by their text."""
    return F.xxhash64(doc_id, text_hash)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed bits: equal pairs of bits, less those that agree by chance."""
    ones = int("01" * 32, 2)
    same = F.lit(0)
    for i in range(LONGS):
        differ = a[i].bitwiseXOR(b[i])
        either = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(ones))
        same = same + (64 // BITS - F.bit_count(either))
    chance = 2.0**-BITS
    return (same / MINIMA - chance) / (1 - chance)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, component_size, elected for every row of docs (doc_id, text, ...)."""
    spark = docs.sparkSession
    with scratch() as own:
        signed, by_set, keep = _components_of(docs)
    discard(spark, [f for f in own if f not in keep])
    joined = signed.select("doc_id", "text_hash", "n_shingles", "digest", "row").join(by_set, "digest", "left")
    elected = F.col("row") == F.col("best.row")
    named = F.col("component_id") == F.col("doc_id")
    of_set = lambda x: F.when(F.col("n_shingles") > 0, F.coalesce(x, F.lit(False))).otherwise(F.lit(True))
    return joined.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        of_set(F.when(F.col("component_id").isNull(), elected).otherwise(named)).alias("kept"),
        F.coalesce("component_size", F.lit(1)).alias("component_size"),
        of_set(elected).alias("elected"),
    )


def _components_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Signed rows, components by set, and the folders these two are read from."""
    with scratch() as rows:
        signed = stage(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "minhash-rows")
    # one node per distinct set; its key is the smallest row that has it
    nodes = stage(
        signed.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("row").alias("node"),
            F.min("doc_id").alias("low_id"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row")).alias("best"),
            F.count(F.lit(1)).alias("copies"),
            F.min(text_key(F.col("doc_id"), F.col("text_hash"))).alias("key"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("bits").alias("bits"),
        ),
        "minhash-nodes",
    )
    in_band = nodes.select(F.explode("bands").alias("key"), "node")
    shared = stage(in_band.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "minhash-shared")
    some = marked(in_band, F.col("key"), shared.select("key")).filter("marked").drop("marked")
    members = stage(some.join(shared.select("key", "first"), "key"), "minhash-members")
    arrays = _arrays(members, docs, nodes)

    found = None
    for pairs_of in (with_first, with_drawn):
        pairs = stage(_promising(pairs_of(members, found), nodes), "minhash-pairs")
        found = merge(found, stage(_confirm(pairs, arrays), "minhash-links"))
    few, many = _across(members, nodes, found)
    pairs = stage(_promising(few, nodes), "minhash-pairs")
    links = _confirm(pairs, arrays).unionByName(_in_blocks(many, arrays, nodes))
    found = merge(found, stage(links, "minhash-links"))

    comp = nodes.join(found, "node", "left").select("digest", "low_id", "best", "copies", F.coalesce("component", "node").alias("component"))
    comp = stage(comp, "minhash-sets")
    whole = stage(comp.groupBy("component").agg(F.min("low_id").alias("component_id"), F.min("best").alias("best"), F.sum("copies").alias("component_size")), "minhash-whole")
    with scratch() as last:
        by_set = stage(comp.select("digest", "component").join(whole, "component").select("digest", "component_id", "best", "component_size"), "minhash-by-set")
    return signed, by_set, [*rows, *last]


def _across(members: DataFrame, nodes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of nodes of different components in bands of few nodes, and the members of bands of many."""
    inside = stage(still_open(members, found), "minhash-open")
    few = inside.filter(F.col("n") <= FEW).join(nodes.select("node", "bits"), "node")
    left, right = few.alias("l"), few.alias("r")
    close = (F.col("l.component") < F.col("r.component")) & (estimate(F.col("l.bits"), F.col("r.bits")) >= LEAST_ESTIMATE)
    pairs = left.join(right, (F.col("l.key") == F.col("r.key")) & close)
    return (
        pairs.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct(),
        inside.filter(F.col("n") > FEW),
    )


def _in_blocks(many: DataFrame, arrays: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between different components inside bands of many nodes, on full sets.

    A band is cut into blocks by hash and every two blocks meet in a task, which counts common shingles and keeps
    one link for each two components it joins; no pair leaves the task but those.
    """
    sized = many.join(nodes.select("node", F.col("n").alias("size")), "node")
    totals = sized.groupBy("key").agg(F.sum("size").alias("total"))
    # a block holds BLOCK sets, or fewer if they are large
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    cut = sized.join(totals, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    dealt = cut.withColumn("at", meet).select("key", "at.i", "at.j", "own", "node", "component")
    return dealt.join(arrays, "node").groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long").distinct()


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    node, own = pdf["node"].to_numpy(), pdf["own"].to_numpy()
    _, label = np.unique(pdf["component"].to_numpy(), return_inverse=True)
    sets = pdf["shingles"].to_list()
    size = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    inside = np.zeros(int(ids.max()) + 1, dtype=bool)
    right = np.flatnonzero(own == j)
    ids_right = np.concatenate([ids[first[x] : first[x] + size[x]] for x in right]) if len(right) else ids[:0]
    starts = np.concatenate([[0], np.cumsum(size[right])[:-1]]).astype(int) if len(right) else np.zeros(0, int)
    links = []
    for x in np.flatnonzero(own == i):
        if not (label[right] != label[x]).any():
            continue
        mine = ids[first[x] : first[x] + size[x]]
        inside[mine] = True
        both = np.add.reduceat(inside[ids_right].astype(np.int64), starts)
        inside[mine] = False
        near = 100 * both >= THRESHOLD * (size[x] + size[right] - both)
        for y in right[near]:
            if label[y] != label[x]:
                links.append((min(node[x], node[y]), max(node[x], node[y])))
                label[label == label[y]] = label[x]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _promising(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes and estimate leave the similarity possible."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    near = 100 * F.least("n_a", "n_b") >= THRESHOLD * F.greatest("n_a", "n_b")
    return (
        pairs.join(side("a"), "a").join(side("b"), "b").filter(near & (estimate(F.col("bits_a"), F.col("bits_b")) >= LEAST_ESTIMATE)).select("a", "b", "n_a", "n_b")
    )


def _arrays(members: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of all nodes that share a band with another one.

    The texts of these nodes are moved, to be found by their key and then to the bucket of their node, where the sets are made and written once, so the joins
    of all rounds read them where they lie and move only what their pairs need.
    """
    spark = docs.sparkSession
    wanted = stage(members.select("node").distinct().join(nodes.select("node", F.col("key").alias("text_key")), "node"), "minhash-wanted")
    keyed = docs.select(text_key(F.col("doc_id"), F.xxhash64("text")).alias("text_key"), "text")
    some = marked(keyed, F.col("text_key"), wanted.select("text_key")).filter("marked").drop("marked")
    texts = some.join(wanted, "text_key").dropDuplicates(["text_key"])
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), own_folder(spark, "minhash-arrays")
    name = f"minhash_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        shingle_arrays(texts.repartition(parts, "node")).write.bucketBy(parts, "node").option("path", path).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay with the run
    return found


def _confirm(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Pairs that are similar on their full sets."""
    side = lambda x: arrays.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * both >= THRESHOLD * (F.col("n_a") + F.col("n_b") - both)).select("a", "b")


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
