"""Running streams in micro-batches.

Nothing that a report counts is decided by a watermark: a batch writes its own rows, keyed by its id, and readers merge them (``state``), so late rows count and a
batch that runs again after a failure replaces itself. The state folder given by the caller holds the checkpoint and the tables; a job
started anew on it goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Step = Callable[[DataFrame, int], None]

#: Keyed state of Spark's own operators lives in files on the executors' disks, with a bounded cache, instead of their heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def run(stream: DataFrame, state: str, step: Step, *, trigger: dict | None = None, mode: str = "append") -> StreamingQuery:
    """Call ``step`` for every batch. Without a trigger: process what is there and stop."""
    for key, value in STATE.items():
        stream.sparkSession.conf.set(key, value)
    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", f"{state}/checkpoint")
    started = writer.trigger(**(trigger or {"availableNow": True})).start()
    if trigger is None or "availableNow" in trigger:
        started.awaitTermination()
    return started


def put(rows: DataFrame, path: str, batch_id: int) -> None:
    """Rows that a batch gives out."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
