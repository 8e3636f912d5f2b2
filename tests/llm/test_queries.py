"""Registered queries of the subpackage against SQL, and the pipeline stage by stage."""

import re

import duckdb
import pytest
from cases import shingles
from oracle import compare

import corpus_pipeline
from cardwatch.llm import toxicity
from cardwatch.llm.queries import ORACLE, QUERIES
from cardwatch.session import stage


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, name, QUERIES[name], ORACLE[name], sf_dir)
    assert ok, note


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 1 + len(QUERIES)))


def test_held_out_rows_are_not_learned_from(spark, con, sf_dir):
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, sf_dir).collect()}
    assert len(got) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for d, r in got.items())


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest table has too few toxic documents to learn from
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, function in corpus_pipeline.STAGES:
        kept.append(stage(function(spark, kept[-1], sf_dir), "test-stage"))
        assert kept[-1].columns == columns or name == "sharding"
    clean, unique, uncontaminated, mixed, sharded = kept[1:]
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in kept]
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False))
    assert 0.8 * docs.count() < clean.count() < docs.count()
    sets = [shingles(r.text) for r in unique.collect()]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a & b)
            assert not (a and b and 100 * both >= 75 * (len(a) + len(b) - both))
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not [r for r in uncontaminated.collect() if any(t in r.text for t in items)]
    # clean documents stay: what goes holds most five-word runs of an item
    runs = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", t.lower())] for i in range(len(w) - 4)}
    wanted = [runs(t) for t in items]
    for r in unique.collect():
        if r.doc_id not in ids[3]:
            own = runs(r.text)
            assert max(len(own & w) / len(w) for w in wanted) >= 0.75
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    assert sharded.count() == mixed.count()


def test_pipeline_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and set(QUERIES) <= set(__spark_entry__.queries())
    assert isinstance(duckdb.__version__, str)


def test_toxicity_learns_nothing_from_held_out_labels(spark, tmp_path):
    """Held-out labels turned over give the same scores; learned ones rank held-out documents."""
    from pyspark.sql import functions as F

    from cardwatch.llm.text import table

    sf_dir = "/root/testdata/sf0.01"
    labels = table(spark, sf_dir, "labels")
    table(spark, sf_dir, "documents").write.parquet(f"{tmp_path}/documents.parquet")
    flipped = F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast(labels.schema["toxic"].dataType)
    labels.withColumn("toxic", flipped).write.parquet(f"{tmp_path}/labels.parquet")
    score = lambda d: {r.doc_id: (r.held_out, round(r.score, 12)) for r in toxicity.op4_toxicity(spark, str(d)).collect()}
    found = score(sf_dir)
    assert found == score(tmp_path)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    bad = [s for d, (held, s) in found.items() if held and truth.get(d) == 1]
    good = [s for d, (held, s) in found.items() if held and truth.get(d) == 0]
    wins = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert bad and good and wins >= 0.8


def test_pipeline_stages_take_any_row(spark):
    """Null ids and texts, repeated rows, columns named like the stages' own, and empty tables pass every stage unchanged."""
    from cases import SCHEMA, frame, messy_rows

    sf_dir = "/root/testdata/sf0.01"
    for docs in (stage(frame(spark, messy_rows()), "messy"), stage(spark.createDataFrame([], SCHEMA), "none")):
        columns, rows = docs.columns, {str(r) for r in docs.collect()}
        for name, function in corpus_pipeline.STAGES:
            if name == "toxicity" and not rows:
                continue  # nothing to learn from
            docs = stage(function(spark, docs, sf_dir), "test-stage")
            if name == "sharding":  # gives the column its own values
                assert set(columns) <= set(docs.columns) and docs.filter("shard IS NULL").isEmpty()
            else:
                assert docs.columns == columns and {str(r) for r in docs.collect()} <= rows
        assert (docs.count() > 0) == (len(rows) > 0)
