"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each query twice (cold, then warm) on ``local[$BENCH_CPUS]``; every
query is executed to completion through the ``noop`` sink (no collect to
the driver).  Prints one JSON line; ``value`` is the sum of warm times.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fraudframe.plans.catalog import QUERIES  # noqa: E402
from fraudframe.session import get_session  # noqa: E402

HEADLINE = [
    "headline_metrics",          # flagship: fx1 processed -> headline metrics
    "build_features_fx3",        # largest view (line items): full feature table
    "build_features_fx2",        # orders x customer x nation join + three categoricals
    "amount_percentile",         # average-rank percentile over line items
    "amount_stats_by_class",     # per-class exact medians
    "detect_columns_fx3",        # column detection, one aggregate
    "correlation_matrix",        # 18x18 pairwise-complete Pearson
    "daily_timeline",
    "top_fraud_merchant",
    "fraud_by_hour",
    "roc_auc",
    "classification_metrics",
    "duplicate_rows",
    "basic_stats",
    "iqr_outliers",
    "train_logreg",
]


def run(spark, name, sf_dir):
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                        driver_memory=os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = round(run(spark, name, sf_dir), 3)
        warm[name] = round(run(spark, name, sf_dir), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_warm", "value": round(sum(warm.values()), 3),
                      "unit": "sec", "queries": warm, "queries_cold": cold,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))


if __name__ == "__main__":
    main()
