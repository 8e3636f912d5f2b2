"""Compare registered queries with their SQL twins: python tests/oracle.py SF [name ...]."""

from __future__ import annotations

import glob
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession


def session(cpus: str = "8") -> SparkSession:
    shared = tempfile.mkdtemp(prefix="cardwatch-")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cardwatch")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints").config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "0.0" if v == 0 else repr(v)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    left, lc = canon([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return True, f"rows={len(left)} (no SQL twin)"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    right, rc = canon(cur.fetchall(), cols)
    if lc != rc:
        return False, f"columns differ {lc} vs {rc}"
    if left != right:
        only_l = [r for r in left if r not in set(right)][:3]
        only_r = [r for r in right if r not in set(left)][:3]
        return False, f"rows {len(left)} vs {len(right)}; columns {lc}; spark only {only_l}; sql only {only_r}"
    return True, f"rows={len(left)}"


def main() -> int:
    from cardwatch.catalog import ORACLE, QUERIES

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as err:  # report and go on with the next query
            ok, note = False, f"{type(err).__name__}: {str(err)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names) - bad} of {len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
