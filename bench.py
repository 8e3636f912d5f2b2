"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from cardwatch.catalog import QUERIES

HEADLINE = (
    "per_payment",
    "features_all",
    "traffic_context",
    "rules_eval",
    "decide",
    "open_incident",
    "resolve_attempt",
    "late_flag",
    "join_observations",
    "link_incident",
    "device_velocity",
    "network_sharing",
    "tileize",
    "merge_tiles",
    "sliding_features",
    "change_detect",
    "incident_sessions",
    "policy_decide",
    "containment_state",
    "blocked_attempts",
    "audit_verify",
    "overview_kpis",
    "risk_trend",
    "latency_percentiles",
    "scenario_metrics",
    "canonicalize",
    "pii_scan",
    "price_cart",
    "ml_pr_auc",
    "ml_threshold",
    "st_payments",
    "st_evaluate",
    "ml_logistic",
    "ml_forest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="cardwatch-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cardwatch-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{shared}/checkpoints")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["per_payment"](spark, sf_dir).count()  # start-up cost stays out of the first query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
