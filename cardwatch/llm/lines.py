"""Operator 3: repeated and nearly repeated lines, by a segment-partition edit join.

Lines within ``edits`` of each other, cut into edits + 1 segments, agree on at least one segment, shifted by no more than the edits allow. A line
is filed under its segments (length, number, text) and looked up under the substrings that a shorter or equally long line could have there.
What shares a key is verified by banded bit-parallel edit distance. Lines and their links form classes; the first line
of a class, by document id and line number, stays and the others are removed.

Equal lines are one node from the start. Keys shared by many nodes are not expanded into pairs (see linking).

Lines are compared lower-cased (A-Z) and without ASCII white space at their ends. Lines shorter than ``min_chars`` repeat only if
equal: one edit in a few characters is another line. Blank lines stay.

Defined cases: null and empty texts have one blank line and lose none; a null id comes after all others; rows that repeat id and text
are one document and lose the same lines; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.linking import merge, still_open, with_drawn, with_first
from cardwatch.llm.text import LOWER, UPPER, lower_ascii, table
from cardwatch.session import freed_shuffles, run_folder, stage

EDITS, MIN_CHARS = 1, 48
FEW, BLOCK = 64, 256


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: bit-parallel over the 2 edits + 1 diagonals around the main one.

    Bit r of a column stands for row column - edits + r. Vertical differences are kept as two bit vectors, moved
    down one row per column; the distance is followed along the lowest diagonal, then along the last row.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < end - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if min(len(a), len(b)) <= edits:  # a band as high as the rest
        return _plain_distance(a, b) <= edits
    rows, width = len(a), 2 * edits + 1
    every, low = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down = every & ~((1 << edits) - 1), 0  # differences to the row above: +1, -1
    distance, last = edits, low
    spare = len(b) - rows + edits  # columns along the last row
    for column, c in enumerate(b, 1):
        shift = column - edits - 1
        equal = places.get(c, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & every
        same = ((((equal & up) + up) ^ up) | equal | down) & every
        right_up = (down | ~(same | up)) & every
        right_down = same & up
        if column <= rows - edits:
            distance += not same & low
            if distance - spare > edits:
                return False
        else:
            last >>= 1
            distance += bool(right_up & last) - bool(right_down & last)
        below = same >> 1
        up, down = (right_down | ~(below | right_up)) & every, below & right_up
    return distance <= edits


def _plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def normal(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def segment_keys(line: str, edits: int) -> list[Column]:
    """Keys of a line: one per length it can meet, segment and place where that segment can begin."""
    keys = []
    for shorter in range(edits + 1):
        size = f"(length({line}) - {shorter})"
        base, extra = f"({size} div {edits + 1})", f"({size} % {edits + 1})"
        for i in range(edits + 1):
            begin = f"({i} * {base} + greatest(0, {i} - ({edits + 1} - {extra})))"
            length = f"({base} + if({i} >= {edits + 1} - {extra}, 1, 0))"
            first, final = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            keys += [
                F.expr(f"xxhash64({size}, {i}, if({begin} + {move} < 0, null, substring({line}, cast({begin} + {move} + 1 as int), cast({length} as int))))")
                for move in range(first, final + 1)
            ]
    return keys


def by_key(docs: DataFrame) -> DataFrame:
    """docs as (key, doc), bucketed by a key of id and text.

    The documents are moved once; the joins that follow bring small tables to their buckets instead of moving the texts again.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lines_{uuid.uuid4().hex}"
    placed = docs.select(key.alias("key"), F.struct("*").alias("doc")).repartition(parts, "key")
    with freed_shuffles(spark):
        placed.write.bucketBy(parts, "key").option("path", f"{run_folder(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay with the run
    return found


def split_lines(keyed: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """place (first places sort first), digest, node and the segment keys of every line; blank lines have no digest."""
    exploded = keyed.select(
        "key", F.col("doc.doc_id").alias("doc_id"), F.posexplode(F.split(F.coalesce("doc.text", F.lit("")), "\n")).alias("line_no", "line")
    ).withColumn("line", normal(F.col("line")))
    keys = [F.when(F.length("line") >= min_chars, k).alias(f"k{i}") for i, k in enumerate(segment_keys("line", edits))]
    digest = F.when(F.col("line") != "", F.unhex(F.md5("line")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", F.col("key"))
    return exploded.select(place.alias("place"), digest.alias("digest"), F.xxhash64("line").alias("node"), *keys)


def _texts(nodes: DataFrame, lines: DataFrame, keyed: DataFrame) -> DataFrame:
    """node, line of the wanted nodes, from one place each."""
    wanted = lines.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("place").alias("at"))
    wanted = stage(wanted.select("node", "at.key", "at.line_no"), "line-wanted")
    line = F.get(F.split("doc.text", "\n"), F.col("line_no"))
    found = keyed.join(wanted, "key").select("node", normal(line).alias("line"))
    return stage(found.dropDuplicates(["node"]), "line-texts")


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, edits) for x, y in zip(a, b, strict=True)], dtype=bool)

    side = lambda x: texts.select(F.col("node").alias(x), F.col("line").alias(f"line_{x}"))
    apart = F.abs(F.length("line_a") - F.length("line_b"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(apart <= edits)
    return both.filter(near("line_a", "line_b")).select("a", "b")


def _in_blocks(many: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Links between components inside keys of many nodes: every two blocks of a key meet in a task."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        _, label = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        node, own, line = pdf["node"].to_numpy(), pdf["own"].to_numpy(), pdf["line"].to_list()
        right = np.flatnonzero(own == pdf["j"].iloc[0])
        size = np.array([len(x) for x in line])
        links = []
        for x in np.flatnonzero(own == pdf["i"].iloc[0]):
            for y in right[(label[right] != label[x]) & (np.abs(size[right] - size[x]) <= edits)]:
                if label[x] != label[y] and within(line[x], line[y], edits):
                    links.append((min(node[x], node[y]), max(node[x], node[y])))
                    label[label == label[y]] = label[x]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    cut = many.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))))
    dealt = cut.withColumn("at", meet).select("key", "at.i", "at.j", "own", "node", "component")
    return dealt.join(texts, "node").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def repeated_lines(keyed: DataFrame, *, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """key, removed (numbers of the lines that go, from 0) of the documents of ``by_key`` that lose lines."""
    lines = stage(split_lines(keyed, edits, min_chars), "lines")
    names = [c for c in lines.columns if c.startswith("k")]
    nodes = lines.filter(f"{names[0]} IS NOT NULL").select("node", *names).dropDuplicates(["node"])
    filed = stage(nodes.select("node", F.explode(F.array_distinct(F.array(*names))).alias("key")), "line-keys")
    counted = filed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = stage(counted.filter("n > 1"), "line-shared")
    members = stage(filed.join(shared.filter("n > 2").drop("last"), "key"), "line-members")

    # keys of two lines: these; of few lines: their pairs; of many: step by step
    few, many = members.filter(F.col("n") <= FEW), members.filter(F.col("n") > FEW).select("key", "node", "first")
    close = (F.col("l.key") == F.col("r.key")) & (F.col("l.node") < F.col("r.node"))
    pairs = few.alias("l").join(few.alias("r"), close).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
    pairs = stage(pairs.unionByName(shared.filter("n = 2").select(F.col("first").alias("a"), F.col("last").alias("b"))).distinct(), "line-pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(many.select("node"))
    texts = _texts(ends.distinct(), lines, keyed)

    found = merge(None, stage(_verified(pairs, texts, edits), "line-links"))
    for pairs_of in (with_first, with_drawn):
        found = merge(found, stage(_verified(stage(pairs_of(many, found), "line-pairs"), texts, edits), "line-links"))
    found = merge(found, stage(_in_blocks(still_open(many, found), texts, edits), "line-links"))

    # a line's class: its component, or its own text
    eight = F.unhex(F.lpad(F.hex("component"), 16, "0"))
    classed = lines.filter("digest IS NOT NULL").select("place", "digest", "node").join(found, "node", "left")
    classed = stage(classed.select("place", F.coalesce(eight, F.col("digest")).alias("class")), "line-classes")
    firsts = stage(classed.groupBy("class").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("class", "first"), "line-firsts")
    gone = classed.join(firsts, "class").filter("place <> first")
    # one list per document, of its own lines
    return stage(gone.groupBy("place.key").agg(F.array_sort(F.collect_set("place.line_no")).alias("removed")), "line-removed")


def without_repeats(docs: DataFrame, *, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with n_lines, n_removed, and text without the removed lines."""
    docs = docs.drop("n_lines", "n_removed")
    keyed = by_key(docs)
    joined = keyed.join(repeated_lines(keyed, edits=edits, min_chars=min_chars), "key", "left")
    split = F.split("doc.text", "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("doc.text")).otherwise(left)
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns],
        F.coalesce(F.size(split), F.lit(1)).alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"),
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


_NORMAL = f"translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}')"
OP3_SQL = f"""
WITH RECURSIVE split_ AS (
  SELECT doc_id, i.i - 1 AS line_no, line AS raw, {_NORMAL} AS line FROM (
    SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) i),
nodes AS (SELECT line, row_number() OVER (ORDER BY line) AS node FROM (SELECT DISTINCT line FROM split_ WHERE line <> '')),
long_ AS (SELECT *, length(line) AS n FROM nodes WHERE length(line) >= {MIN_CHARS}),
links AS (
  SELECT a.node AS x, b.node AS y FROM long_ a JOIN long_ b ON b.n IN (a.n, a.n + 1) AND a.node <> b.node WHERE levenshtein(a.line, b.line) <= {EDITS}),
both_ AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT node AS x, node AS y FROM nodes UNION SELECT reach.x, both_.y FROM reach JOIN both_ ON reach.y = both_.x),
class AS (SELECT x AS node, min(y) AS class FROM reach GROUP BY x),
placed AS (
  SELECT s.doc_id, s.line_no, s.raw,
    n.node IS NOT NULL AND row_number() OVER (PARTITION BY c.class ORDER BY s.doc_id, s.line_no) > 1 AS gone
  FROM split_ s LEFT JOIN nodes n ON n.line = s.line LEFT JOIN class c ON c.node = n.node)
SELECT doc_id, count(*)::INTEGER AS n_lines, (count(*) FILTER (WHERE gone))::INTEGER AS n_removed,
  md5(coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS text_md5
FROM placed GROUP BY doc_id
"""
