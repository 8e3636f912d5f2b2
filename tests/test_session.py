"""Written intermediate tables."""

import time

import pytest
from pyspark.sql import functions as F

from cardwatch.session import FREED, freed_shuffles, stage, stage_by


def shuffled(spark):
    """Shuffle files on this machine's disks."""
    names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {name for name in names.split("\n") if "/shuffle_" in name}


@pytest.mark.parametrize("write", [lambda df: stage(df, "freed"), lambda df: stage_by(df, "freed", ["k"])])
def test_a_written_table_leaves_no_shuffle_files(spark, write):
    before = shuffled(spark)
    rows = spark.range(20_000).repartition(8, "id").withColumn("k", F.col("id") % 700).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    written = write(rows)
    end = time.time() + 20  # files go a moment after the write
    while shuffled(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert written.agg(F.count(F.lit(1)), F.sum("n")).first() == (700, 20_000)


def test_settings_are_put_back(spark):
    with pytest.raises(ZeroDivisionError), freed_shuffles(spark):
        assert spark.conf.get(FREED) == "true"
        1 / 0  # noqa: B018
    assert spark.conf.get(FREED, "false") == "false"
    spark.conf.set(FREED, "true")
    try:
        with freed_shuffles(spark):
            pass
        assert spark.conf.get(FREED) == "true"
    finally:
        spark.conf.unset(FREED)
