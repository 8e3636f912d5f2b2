"""Tables that are rewritten in part: copy on write by key bucket, with a version file that names what counts.

A row lies in the bucket of its key's hash. A change reads and writes the buckets it touches and no others; the new version's file names the folder of every
bucket, and appears under its name only when it is complete. Until then, and after a failure, readers have the old version. Folders that a version
no longer names are deleted one version later, so a reader that holds the version before still finds its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BUCKETS = 64


class VersionFiles:
    """Small JSON files with ascending numbers in a folder; one writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def store(self):
        return self.at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        store, at = self.store(), self.at(folder)
        return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []

    def newest(self, folder: str, default: dict) -> dict:
        made = sorted(n for n in self.names(folder) if n.endswith(".json"))
        if not made:
            return default
        stream = self.store().open(self.at(f"{folder}/{made[-1]}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, folder: str, number: int, content: dict) -> None:
        """The file appears whole or not at all; a number that exists already is an error, as then two jobs write one table."""
        store, name = self.store(), f"{folder}/{number:012d}.json"
        out = store.create(self.at(f"{name}.tmp"), True)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        if not store.rename(self.at(f"{name}.tmp"), self.at(name)):
            raise RuntimeError(f"{self.path}: {name} exists already; two jobs write one table")

    def delete(self, names: Sequence[str]) -> None:
        for name in names:
            self.store().delete(self.at(name), True)


class SnapshotTable:
    """Rows by key, as of the newest committed version; every row has a key, and there is one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, like: T.StructType, key: str, *, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path, key
        self.like = T.StructType([T.StructField(f.name, f.dataType) for f in like.fields])
        self.files = VersionFiles(spark, path)
        self._buckets = buckets

    def version(self) -> dict:
        """``number``, ``buckets`` (how many there are), ``folders`` (of each bucket that has rows) and ``gone`` (folders it left out)."""
        return self.files.newest("versions", {"number": 0, "buckets": self._buckets, "folders": {}, "gone": []})

    def _bucket(self, version: dict) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(version["buckets"])).cast("int")

    def _rows(self, version: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        places = [f"{self.path}/{f}/bucket={b}" for b, f in sorted(version["folders"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.like).parquet(*places) if places else self.spark.createDataFrame([], self.like)

    def read(self) -> DataFrame:
        return self._rows(self.version())

    def _touched(self, version: dict, keys: DataFrame) -> list[int]:
        return [r["b"] for r in keys.select(self._bucket(version).alias("b")).distinct().collect()]  # as many as there are buckets at most

    def change(self, keys: DataFrame, step: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put ``step`` of the rows in place of them, in the buckets of ``keys``; returns these buckets. ``step`` keeps the rows' keys or drops rows."""
        version = self.version()
        touched = self._touched(version, keys)
        if not touched:
            return []
        name = f"rows-{version['number'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        made = step(self._rows(version, touched)).select(*self.like.names).withColumn("bucket", self._bucket(version))
        made.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        full = {n[7:] for n in self.files.names(name) if n.startswith("bucket=")}
        folders = {b: f for b, f in version["folders"].items() if int(b) not in touched} | {b: name for b in full}
        gone = [f"{f}/bucket={b}" for b, f in version["folders"].items() if int(b) in touched]
        self.files.write("versions", version["number"] + 1, {"number": version["number"] + 1, "buckets": version["buckets"], "folders": folders, "gone": gone})
        self.files.delete(version["gone"])
        return sorted(touched)

    def put(self, rows: DataFrame) -> list[int]:
        """Rows of new keys, or in place of rows with their keys."""
        given = rows.select(*self.like.names)
        return self.change(given, lambda old: old.join(given.select(self.key).distinct(), self.key, "left_anti").select(*self.like.names).unionByName(given))

    def change_where(self, condition: Column, step: Callable[[DataFrame], DataFrame]) -> list[int]:
        """The same in the buckets that hold a row for which the condition is true."""
        return self.change(self.read().filter(condition).select(self.key), step)
