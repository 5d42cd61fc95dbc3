"""Times the headline queries; prints one JSON line.

    BENCH_SF_DIR  folder of the tables   (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores            (default 8)
    BENCH_RUNS    timed runs per query   (default 2, after one warm-up); the best counts
"""

from __future__ import annotations

import json
import os
import re
import time

from gridlore.queries import QUERIES
from gridlore.session import build_session

HEADLINE = (
    "top_customers", "customer_segments", "sales_trend_monthly", "product_performance", "regional_analysis",
    "cross_sell_pairs", "coerce_types", "sql_over_table", "group_agg_sum", "value_distribution",
    "numeric_summary", "correlations", "check_missing", "check_duplicates", "check_outliers_iqr",
    "fix_fill_missing_mean", "fix_remove_outliers_iqr", "audit_merged_cell_gaps", "trends", "anomalies_zscore",
    "kpis", "dashboard_summary", "duplicate_groups", "timing_patterns", "round_numbers", "benford",
    "risk_score", "health_score", "stock_classes", "salary_by_department", "overtime_by_employee",
    "regression_metrics", "train_linear", "linear_forecast_by_key", "seasonal_forecast_by_key",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g",
        spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        best = None
        for run in range(runs + 1):
            began = time.perf_counter()
            # the noop sink runs the whole plan without moving rows to the driver
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            if run:
                best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(found.group(1)) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
