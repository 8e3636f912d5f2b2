"""From raw documents to training shards: five stages, each one operator, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents; the last adds the shard. What the operators need of a row travels beside it, the row itself in a struct, so columns of any name pass unchanged.

A stage's own tables are deleted when the next stage begins, which reads the written result, unless that is not so: what the given documents
still read stays.

Defined cases, in all stages: null and empty texts, null ids and repeated rows are rows like others; ties are broken as the operators say; an empty table gives an
empty table with the same columns. Toxicity: an empty text is not toxic. Near-duplicates: texts without words are all kept; of rows with equal id and text one
stays. Decontamination: a text without words holds no item. Mixing: a document without words is in no source's share and goes.
Shards: rows without an id are placed by their content; a column named shard gets the shard.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from cardwatch.llm.decontaminate import clean
from cardwatch.llm.marks import marked
from cardwatch.llm.mixing import fair_mix
from cardwatch.llm.neardup import near_duplicates, text_key
from cardwatch.llm.sharding import shard
from cardwatch.llm.text import table, words_in
from cardwatch.llm.toxicity import score_texts, train
from cardwatch.session import discard, scratch, stage


_LEFT: list[str] = []


def _stage(function):
    """The stage with its own tables owned: they go when the next one begins."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        done = [folder for folder in _LEFT if not any(f"{folder.rsplit('/', 1)[1]}/" in file for file in read)]
        discard(spark, done)
        _LEFT[:] = [folder for folder in _LEFT if folder not in done]
        with scratch() as own:
            found = function(spark, docs, sf_dir)
        _LEFT.extend(own)
        return found

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not call toxic."""
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", *([F.struct(*others).alias("_row")] if others else []))
    return score_texts(rows, model).filter("toxicity < 0.5").select(*[F.col("_row")[c].alias(c) if c in others else F.col(c) for c in docs.columns])


@_stage
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: smallest id, null last. Which of the rows that repeat both id and text stays is left open."""
    found = near_duplicates(docs).filter("n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    judged = stage(found.agg(F.max("elected").alias("_stays"), F.count(F.lit(1)).alias("_n")).filter("NOT _stays OR _n > 1"), "near-duplicates")
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash"))
    # most documents are not judged: they need not be moved to find that out
    seen = marked(keyed, text_key(F.col("_doc"), F.col("_text")), judged.select(text_key(F.col("_id"), F.col("_hash"))))
    left = seen.filter("NOT marked").select("doc.*").unionByName(seen.filter("marked").join(judged, same, "left_anti").select("doc.*"))
    repeated = judged.filter("_stays").select("_id", "_hash")
    if repeated.isEmpty():
        return left
    return left.unionByName(seen.filter("marked").join(repeated, same).dropDuplicates(["_doc", "_text"]).select("doc.*"))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    mixed = fair_mix(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.struct("*").alias("_row")))
    return mixed.select("_row", F.explode("vft")).select("_row.*")


@_stage
def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard that takes them."""
    return shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: A trained classifier and MinHash cannot be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, function in STAGES[:-1]:
        found = function(spark, docs, sf_dir)
        with scratch() as own:
            docs = stage(found, f"pipeline-{name.replace(' ', '-')}")
        discard(spark, before)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
