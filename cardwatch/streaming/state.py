"""State tables of streams: one small folder per batch, merged into bucketed runs as batches go by.

A batch puts its rows into a folder of its own, so a batch that runs again replaces itself. Once FANOUT batches are done their folders are merged into a
run: rows merged by key, a partition folder per bucket, sorted by key in it. FANOUT runs of one level become one run of the next,
so a row is rewritten a logarithmic number of times and a reader opens a bounded number of folders however many batches there were.

What counts is named by a manifest, one small file per generation that appears under its name only when it is complete. A run whose manifest was never
written does not count and is replaced when the merge runs again; folders that a manifest leaves out are deleted one
generation later, so a reader that still holds the last manifest finds its files.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cardwatch.sources.versions import VersionFiles

FANOUT = 8
BUCKETS = 32

Merge = Callable[[DataFrame], DataFrame]


def same_keys(a: str, b: str, keys: Sequence[str]) -> Column:
    """Rows of aliases a and b agree on the keys; null agrees with null."""
    found = F.lit(True)
    for k in keys:
        found &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return found


class StateTable:
    """Rows of a stream's state.

    ``keys`` say which rows belong together, ``merge`` turns the rows of any set of batches into fewer with the same meaning (None: they stay).
    ``bucket`` is the column by which runs are cut into folders; without one it is a hash of the keys.
    """

    def __init__(self, spark: SparkSession, path: str, like: T.StructType, keys: Sequence[str], merge: Merge | None = None, *, bucket: Column | None = None):
        self.spark, self.path, self.keys, self.merge = spark, path, list(keys), merge
        self.bucket = (F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) if bucket is None else bucket).cast("long")
        self.like = T.StructType([T.StructField(f.name, f.dataType) for f in like.fields if f.name != "bucket"])
        self.files = VersionFiles(spark, path)
        self.stored = T.StructType([*self.like.fields, T.StructField("bucket", T.LongType())])

    def manifest(self) -> dict:
        """The newest one: ``generation``, ``upto`` (batches before it are in runs), ``runs`` (name, level), ``gone`` (folders it leaves out)."""
        return self.files.newest("manifest", {"generation": 0, "upto": 0, "runs": [], "gone": []})

    def _commit(self, manifest: dict) -> None:
        self.files.write("manifest", manifest["generation"], manifest)

    def _batches(self) -> list[int]:
        return sorted(int(n[6:]) for n in self.files.names("") if n.startswith("batch="))

    # --- rows -------------------------------------------------------------------------------------

    def read(self, *, before: int | None = None, touched: DataFrame | None = None, buckets: Column | None = None) -> DataFrame:
        """Rows that count, unmerged: of batches before one if given, only of the keys in ``touched`` if given, only of the buckets that a condition on ``bucket`` keeps."""
        manifest = self.manifest()
        batches = [b for b in self._batches() if b >= manifest["upto"] and (before is None or b < before)]
        rows = self._rows([r["name"] for r in manifest["runs"]], batches)
        if buckets is not None:
            rows = rows.filter(buckets)
        if touched is None:
            return rows.drop("bucket")
        wanted = touched.select(*self.keys).distinct()
        places = [r["bucket"] for r in wanted.select(self.bucket.alias("bucket")).distinct().collect()]  # as many as there are buckets at most
        known = [p for p in places if p is not None]
        rows = rows.filter(F.col("bucket").isin(known) | F.col("bucket").isNull() if len(known) < len(places) else F.col("bucket").isin(known))
        return rows.alias("a").join(wanted.alias("b"), same_keys("a", "b", self.keys), "left_semi").drop("bucket")

    def _rows(self, runs: Sequence[str], batches: Sequence[int]) -> DataFrame:
        reader = self.spark.read.schema(self.stored)
        frames = [reader.parquet(f"{self.path}/{name}") for name in runs]
        if batches:
            frames.append(reader.parquet(*[f"{self.path}/batch={b}" for b in batches]))
        if not frames:
            return self.spark.createDataFrame([], self.stored)
        found = frames[0]
        for more in frames[1:]:
            found = found.unionByName(more)
        return found

    def now(self, **which) -> DataFrame:
        """Rows that count, merged."""
        rows = self.read(**which)
        return rows if self.merge is None else self.merge(rows)

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of a batch; earlier batches are merged first if there are enough of them."""
        self.settle(batch_id)
        rows.select(*self.like.names).withColumn("bucket", self.bucket).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def settle(self, before: int) -> None:
        """Merge the folders of batches before one, which are done, into a run, and full levels of runs into runs of the next level."""
        old = self.manifest()
        done = [b for b in self._batches() if old["upto"] <= b < before]
        if len(done) < FANOUT:
            return
        runs, gone = list(old["runs"]), [f"batch={b}" for b in done]
        runs.append({"level": 0, "name": self._merged(f"run-0-{done[0]}-{done[-1]}", [], done)})
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= FANOUT:
            level += 1
            runs = [r for r in runs if r not in full]
            runs.append({"level": level, "name": self._merged(f"run-{level}-{done[-1]}", [r["name"] for r in full], [])})
            gone += [r["name"] for r in full]
        self._commit({"generation": old["generation"] + 1, "upto": done[-1] + 1, "runs": runs, "gone": gone})
        self.files.delete(old["gone"])

    def _merged(self, name: str, runs: Sequence[str], batches: Sequence[int]) -> str:
        rows = self._rows(runs, batches).drop("bucket")
        rows = (rows if self.merge is None else self.merge(rows)).select(*self.like.names).withColumn("bucket", self.bucket)
        # a large bucket becomes several files
        laid = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.keys)
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")
        return name


def newest_per(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the newest batch of each key; a key's rows may be several."""
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.alias("a").join(last.alias("b"), same_keys("a", "b", [*keys, "batch"]), "left_semi")


def added_up(keys: Sequence[str], sums: Sequence[str]) -> Merge:
    """Merge by adding; rows that cancel out go."""

    def merge(rows: DataFrame) -> DataFrame:
        total = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
        some = F.lit(False)
        for c in sums:
            some |= F.col(c) != 0
        return total.filter(some)

    return merge
