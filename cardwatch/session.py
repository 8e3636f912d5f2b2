"""Session settings and the written intermediate tables the plans share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings every job relies on: UTC clock and runtime re-planning."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else one beside the warehouse's tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


_OWNED: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    folder = f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"
    if folder not in _OWNED:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _OWNED.add(folder)
    return folder


_OWNERS: list[list[str]] = []


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The folders that ``stage`` and ``own_folder`` hand out inside the block, inner blocks included. They stay until the application ends, or until ``discard``."""
    own: list[str] = []
    _OWNERS.append(own)
    try:
        yield own
    finally:
        _OWNERS.pop()
        if _OWNERS:
            _OWNERS[-1].extend(own)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in this application's part of the shared folder."""
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


def discard(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders that nothing reads any more."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a write inside the block shuffled is deleted when the write ends; else it stays until the driver collects its garbage.

    Only for writes, which run once: a result that is run again would have to shuffle again. Threads that share a session may end each other's
    block early, which leaves files as long as they stayed before.
    """
    if spark.conf.get(FREED, "false") == "true":
        yield
        return
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED)


def stage_by(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """``stage``, bucketed by the keys: groups and joins that contain them find their rows together and move none."""
    spark = df.sparkSession
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), own_folder(spark, name)
    stored = f"staged_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.repartition(parts, *keys).write.bucketBy(parts, *keys).option("path", path).saveAsTable(stored)
    found = spark.table(stored)
    spark.sql(f"DROP TABLE {stored}")  # an external table: its files stay with the run
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back.

    Used where several branches read one expensive result. The copy survives lost executors,
    keeps column pruning and filter pushdown for its readers, and gives the optimiser a real
    size, so a join against it is broadcast only when it is below the session's threshold.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
