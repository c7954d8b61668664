"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1), BENCH_CPUS: local cores.
A query runs once untimed on the smallest tables next to BENCH_SF_DIR (JVM and
code warm-up, other data), then once timed on the whole tables."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "two_level_weights",
    "two_level_weights_by_period",
    "topsis_vector",
    "vikor",
    "copras",
    "edas",
    "promethee_vshape",
    "method_scores",
    "rank_suppliers",
    "final_ranking",
    "reweighed_composites",
    "method_agreement",
    "weight_sensitivity_tiers",
    "features_lags",
    "features_cross_entity",
    "metric_summary",
    "conformal_symmetric",
    "chained_imputation",
    "customer_panel_long",
    "user_trend",
    "forecast_metrics",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from catalog import QUERIES

    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    seconds = {}
    for name in HEADLINE:
        if os.path.isdir(warm):
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
