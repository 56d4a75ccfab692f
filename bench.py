"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyward.plans import all_queries  # noqa: E402

HEADLINE = (
    "quality_run",
    "quality_unique",
    "profile_columns",
    "classify_columns",
    "detect_pii_values",
    "bias_test",
    "psi",
    "ks_test",
    "drift_check",
    "facets",
    "search_assets",
    "upsert_assets",
    "resolve_refs",
    "table_edges",
    "impact",
    "openlineage_edges",
    "model_cards",
    "risk_score",
    "etl_customer_revenue",
    "etl_product_performance",
    "etl_payment_summary",
    "stream_quality",
    "stream_drift",
    "global_importance",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    if names == ["all"]:
        names = list(all_queries())
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyward-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "6g"))
    )
    if "SPARK_CHECKPOINT_DIR" not in os.environ:
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallyward-bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times: dict[str, float] = {}
    for name in names:
        measured = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
        times[name] = round(statistics.median(measured), 3)
        print(f"{name} {times[name]} {[round(m, 2) for m in measured]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
