"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no driver collection).
Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "A15_anomaly_rate_by_city",    # flagship: join, global stats, flags, grouped rates
    "J1_join_demand_weather",
    "A1_daily_summary",
    "A6_describe",
    "A12_corr_matrix",
    "M4_impute_chain",
    "F8_box_stats",
    "G2_lag_grid",
    "G4_rolling_stats",
    "G6_ewm_mean",
    "N6_stratified_sample",
    "N12_split_chronological",
    "L5_stack_ridge",
    "A18_compare_models",
    "D3_interpolate_linear",
    "G3_lag_grid_adaptive",
    "N3_anomaly_isolation_forest",
    "N9_sample_validation",
    "X1_stream_hourly_demand",
    "L2_train_boosted_trees",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from loadstats.session import checkpoint_root, get_spark
    spark = get_spark(f"local[{cpus}]", int(cpus))
    checkpoint_root(spark)
    from loadstats.plans import QUERIES

    times = {}
    # warm-up: JVM, class loading and parquet footers (not timed)
    QUERIES["J1_join_demand_weather"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
