"""Time the headline queries: one warm-up of the whole list, then the median of three runs each.

Prints one JSON line; ``build`` is the part of each time that passed before the result's own job.
``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from fleetgauge import catalogue

HEADLINE = (
    "scope_unprioritized",
    "item_pair",
    "usage_detail",
    "usage_daily",
    "usage_period_rolling",
    "p95_discrete",
    "latest_value",
    "current_usage",
    "power_state",
    "diag_clock_skew",
    "gen_latest_event_per_user",
    "gen_nearest_rank_price",
    "gen_mean_of_daily_means",
    "gen_paired_ratio",
    "report_tbn",
    "report_critical",
    "report_unprioritized",
    "report_tbn_monthly",
    "report_all_bands",
)
RUNS = 3


def seconds(query, spark: SparkSession, sf_dir: str) -> tuple[float, float]:
    """(all, before the result's own job)"""
    start = time.perf_counter()
    result = query(spark, sf_dir)
    built = time.perf_counter() - start
    result.write.format("noop").mode("overwrite").save()
    whole = time.perf_counter() - start
    spark.catalog.clearCache()
    return whole, built


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetgauge-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    times, built = {}, {}
    for name in HEADLINE:
        seconds(queries[name], spark, sf_dir)
    for name in HEADLINE:
        runs = sorted(seconds(queries[name], spark, sf_dir) for _ in range(RUNS))
        whole, before = runs[RUNS // 2]
        times[name], built[name] = round(whole, 3), round(before, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "build": built,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
