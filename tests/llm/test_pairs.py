"""Near-duplicates, exact copies, lines and benchmark passages against brute force."""

import hashlib
import os
import random
from contextlib import nullcontext

import numpy as np
import pytest
from cases import LOWER, SCHEMA, components, frame, messy_rows, prose, shingles, words
from pyspark.sql import functions as F

from cardwatch.llm import decontaminate, exact, fuse, lines, marks, neardup
from cardwatch.llm.components import components as connected
from cardwatch.llm.shingles import shingle_sets


@pytest.fixture(scope="module")
def messy(spark):
    return frame(spark, messy_rows()).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_family(n, seed, changes):
    """Copies of one text with so many words changed that some pairs are just below and some just above the threshold."""
    rng = random.Random(seed)
    base = prose(seed, 150, 10_000).split()
    found = []
    for i in range(n):
        own = list(base)
        for k in range(rng.randrange(changes + 1)):
            own[rng.randrange(len(own))] = f"v{i}_{k}"
        found.append(" ".join(own))
    return found


def test_minhash_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 4)  # so that small bands take the path of full ones
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = [r for r in messy_rows() if r[0] is not None]
    rows += [(1000 + i, t, "n") for i, t in enumerate(near_family(60, 5, 9))]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    sets = [shingles(t) for _, t, _ in rows]
    root = components(sets)
    low = {}
    for (d, _, _), r in zip(rows, root, strict=True):
        low[r] = min(d, low.get(r, d))
    want = sorted((d, len(s), low[r] if s else d, (low[r] if s else d) == d) for (d, _, _), s, r in zip(rows, sets, root, strict=True))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_minhash_null_ids_and_empty_tables(spark, messy, empty):
    got = neardup.near_duplicates(messy).collect()
    assert len(got) == messy.count()
    assert all(r.n_shingles == 0 and r.kept for r in got if r.doc_id in (4, 5, 6))
    assert neardup.near_duplicates(empty).count() == 0


def test_minhash_elects_one_row_of_a_group(spark):
    import corpus_pipeline

    text, other = prose(31, 80), prose(32, 80)
    near = text.replace(text.split()[40], "changed", 1)
    rows = [(None, text, "a")] * 3 + [(None, near, "b"), (7, other, "c"), (7, other + " more", "c"), (7, other, "c"), (None, other, "c")]
    rows += [(None, None, "d"), (None, "", "d"), (8, prose(33, 60), "e")]
    docs = frame(spark, rows).repartition(3)
    got = neardup.near_duplicates(docs).collect()
    without = [r for r in got if r.component_id is None and r.n_shingles]
    assert len(without) == 4 and sum(r.kept for r in without) == 1 and sum(r.elected for r in without) == 1
    seven = [r for r in got if r.component_id == 7]
    assert len(seven) == 4 and sum(r.elected for r in seven) == 1
    assert all(r.kept == (r.doc_id == r.component_id) for r in seven) and sum(r.elected for r in seven) == 1
    left = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or -1, len(r.text or "") > 0) for r in left) == [(-1, False), (-1, False), (-1, True), (7, True), (8, True)]


def test_minhash_full_bands_keep_links_of_one_band(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 2)
    members = spark.createDataFrame([(1, k, 0) for k in range(6)], "key long, node long, first long")
    nodes = spark.createDataFrame([(k, [1, 100 + k], [0] * neardup.LONGS) for k in range(6)], "node long, bands array<long>, bits array<long>")
    found = spark.createDataFrame([], "node long, component long")
    few, many = neardup._across(members, nodes, found)
    assert few.count() == 0 and sorted(r.node for r in many.collect()) == list(range(6))


def test_minhash_moves_no_text_that_shares_no_band(spark, monkeypatch):
    monkeypatch.setattr(neardup, "freed_shuffles", lambda _: nullcontext())  # so that what was moved can be counted
    texts = [prose(5_000 + i, 300, 1_000_000) for i in range(200)]
    docs = frame(spark, [(i, t, "n") for i, t in enumerate([*texts, texts[0] + " end"])]).select("doc_id", "text").repartition(2)
    nodes = docs.select(F.col("doc_id").alias("node"), neardup.text_key(F.col("doc_id"), F.xxhash64("text")).alias("key"))
    members = spark.createDataFrame([(0, 1), (200, 1)], "node long, key long")
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    moved = lambda: {f: os.path.getsize(f) for f in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f and f.endswith(".data")}
    docs = neardup.stage(docs, "test-docs")
    before = moved()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        arrays = neardup._arrays(members, docs, nodes)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sorted(r.node for r in arrays.collect()) == [0, 200]
    assert sum(size for f, size in moved().items() if f not in before) < sum(map(len, texts)) / 10


@pytest.mark.parametrize("most", [1 << 15, 1 << 27])
def test_marks_miss_no_key_and_few_others_have_one(spark, monkeypatch, most):
    monkeypatch.setattr(marks, "MOST", most)
    rows = spark.range(-20_000, 20_000).selectExpr("id * 7919 AS id", "'x' AS marked_by")
    rows = rows.unionByName(spark.createDataFrame([(None, "x")], "id long, marked_by string"))
    keys = spark.range(0, 20_000).selectExpr("id * 7919")
    got = marks.marked(rows, F.col("id"), keys).groupBy(F.col("id") >= 0).agg(F.count(F.lit(1)), F.count_if("marked"))
    found = {r[0]: (r[1], r[2]) for r in got.collect()}
    assert found[True] == (20_000, 20_000) and found[None][0] == 1
    assert found[False][0] == 20_000 and found[False][1] < (20_000 if most == 1 << 15 else 20_000 / 14)
    assert marks.marked(rows, F.col("id"), keys.limit(0)).filter("marked").count() == 0


def test_shingle_sets_do_not_depend_on_pieces(monkeypatch):
    import pyarrow as pa

    from cardwatch.llm import shingles as S

    texts = [t for _, t, _ in messy_rows()]
    whole = [x.tolist() for x in shingle_sets(pa.array(texts))]
    monkeypatch.setattr(S, "PIECE", 300)
    assert [x.tolist() for x in shingle_sets(pa.array(["skipped", *texts]).slice(1))] == whole
    assert [len(x) for x in whole] == [len(shingles(t)) for t in texts]
    assert len({tuple(x) for x in whole}) == len({shingles(t) for t in texts})


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 450)] + [(900, 900)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert got == {x: root(x) for x in list(parent)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fuse_filters_hold_all_their_keys():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 1000, 60_000):
        keys = rng.integers(-(2**63), 2**63 - 1, n)
        found = fuse.build(np.concatenate([keys, keys[: n // 2]]))
        assert fuse.contains(found, keys).all()
        if n == 60_000:
            assert len(found[3]) < 1.4 * n
            assert fuse.contains(found, rng.integers(-(2**63), 2**63 - 1, 50_000)).mean() < 0.01


@pytest.mark.parametrize("old", ["doc_id <= 9", "doc_id % 2 = 0", "false", "true"])
def test_exact_copies_whatever_the_snapshot(messy, old):
    got = exact.deduplicate(messy, F.expr(old)).collect()
    groups = {}
    for d, t, _ in messy_rows():
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    want = []
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        want += [(d or -1, keep or -1, len(ids), hashlib.sha256(text.encode()).hexdigest()) for d in ids]
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.text_sha256) for r in got) == sorted(want)
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_copies_of_nothing(empty):
    assert exact.deduplicate(empty, F.lit(True)).count() == 0


def test_edit_distance_is_exact():
    rng = random.Random(4)
    for _ in range(3000):
        edits = rng.randrange(1, 5)
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 16)))
        b = list(a)
        for _ in range(rng.randrange(0, edits + 2)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randrange(2)] = rng.choice(["", "a", "b", "c"])
        b = "".join(b)
        assert lines.within(a, b, edits) == (lines._plain_distance(a, b) <= edits), (a, b, edits)


@pytest.mark.parametrize("edits", [1, 2])
def test_lines_match_brute_force(spark, monkeypatch, edits):
    monkeypatch.setattr(lines, "FEW", 3)
    monkeypatch.setattr(lines, "BLOCK", 4)
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 40))).strip() for _ in range(12)]

    def bent(x):
        x = list(x)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(x))
            x[i : i + rng.randrange(2)] = rng.choice(["", "z", "y"])
        return "".join(x)

    rows = [(i, "\n".join(rng.choice(["", "short", bent(rng.choice(base)), " " + rng.choice(base).upper()]) for _ in range(8)), "a") for i in range(25)]
    rows += [(None, base[0], "b"), (40, None, "b"), (41, "", "b")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.without_repeats(frame(spark, rows), edits=edits, min_chars=16).collect()}

    flat = [(d is None, d or 0, n, line) for d, t, _ in rows for n, line in enumerate((t or "").split("\n"))]
    plain = [x[3].strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in flat]
    texts = sorted({x for x in plain if x})
    parent = {x: x for x in texts}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= 16 and lines._plain_distance(a, b) <= edits:
                parent[root(a)] = root(b)
    first = {}
    for place, x in sorted(zip(flat, plain, strict=True)):
        if x:
            first.setdefault(root(x), place[:3])
    for d, t, _ in rows:
        own = list(enumerate((t or "").split("\n")))
        left = [x for n, x in own if not (p := x.strip(" \t\n\x0b\x0c\r").translate(LOWER)) or first[root(p)] == (d is None, d or 0, n)]
        assert got[d] == (len(own), len(own) - len(left), None if t is None else "\n".join(left))


def test_lines_keep_other_columns_and_empty_tables(messy, empty):
    out = lines.without_repeats(messy)
    assert out.columns == [*messy.columns, "n_lines", "n_removed"] and out.count() == messy.count()
    assert {r.doc_id: r.n_removed for r in out.collect()}[18] == 2
    assert lines.without_repeats(empty).count() == 0


def leaked(rng, item, i):
    return f"{prose(500 + i, rng.randrange(0, 90))} {item} {prose(600 + i, rng.randrange(0, 90))}"


def test_benchmark_passages_match_brute_force(spark):
    rng = random.Random(8)
    items = [(i, prose(700 + i, n, 3_000)) for i, n in enumerate([12, 20, 30, 45, 60, 3, 1, 30])]
    items += [(50, None), (51, ""), (2, prose(720, 25, 3_000)), (52, " ".join(["same"] * 20))]
    rows = [(i, leaked(rng, items[i % 5][1], i), "a") for i in range(15)]
    rows += [(20 + i, leaked(rng, items[i % 5][1].upper().replace(" ", ",  "), 30 + i), "a") for i in range(5)]
    for i in range(15):  # some words changed: similarities on both sides of the threshold
        w = items[4][1].split()
        for _ in range(i // 4):
            w[rng.randrange(len(w))] = "other"
        rows.append((40 + i, leaked(rng, " ".join(w), 60 + i), "b"))
    rows += [(90, items[5][1], "c"), (91, "a " + items[6][1], "c"), (92, None, "c"), (93, "", "c"), (94, "same " * 30, "c"), (None, items[0][1], "c")]
    rows += [(100 + i, prose(900 + i, 80, 3_000), "d") for i in range(20)] + [(120, items[1][1], "d"), (120, "clean text of a repeated id", "d")]
    docs, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    judged = decontaminate.judge(docs, bench).collect()

    def split(t):
        import regex

        return [x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]

    def held(text):
        found, w = set(), split(text)
        for item, own in items:
            v = split(own)
            k = min(5, len(v))
            if not v:
                continue
            grams = lambda x, k=k: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]
            want = grams(v)
            for at in range(max(1, len(w) - len(v) + 1 + len(v))):
                seen = grams(w[at : at + len(v)])
                both = sum(min(seen.count(g), want.count(g)) for g in set(want))
                if both and both / (len(seen) + len(want) - both) >= 0.75:
                    found.add(item)
        return sorted(found)

    want = sorted((d if d is not None else -1, held(t)) for d, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["items"] or []) for r in judged) == want
    assert all(r.contaminated == bool(r["items"]) for r in judged)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x for _, x in want)


def test_benchmark_passages_cut_by_either_end_of_a_text(spark):
    w = [f"i{k}" for k in range(100)]
    more = prose(41, 200)
    docs = frame(spark, [(1, " ".join(w[14:]) + " " + more, "a"), (2, more + " " + " ".join(w[:86]), "a"), (3, " ".join(w[30:]) + " " + more, "a")])
    judged = decontaminate.judge(docs, spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"))
    got = {r.doc_id: r.similarity and round(r.similarity, 3) for r in judged.collect()}
    assert got == {1: 0.854, 2: 0.854, 3: None}


def test_nothing_to_decontaminate(spark, messy, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(messy, none).filter("contaminated").count() == 0
    assert decontaminate.judge(empty, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert words("A b") == ["a", "b"]
