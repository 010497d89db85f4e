"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Every result is
fully computed into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.catalog.queries import all_queries  # noqa: E402

HEADLINE = [
    "illiq_rolling",
    "illiq_monthly_panel",
    "vol_scaled_momentum",
    "composite_exposure_signal",
    "quantile_bins",
    "rank_quantile_bins",
    "signal_stats",
    "zscore_by_date",
    "information_coefficients",
    "mvo_weights",
    "mvo_weights_factor_risk",
    "portfolio_returns",
    "study_monthly_quantile",
    "study_daily_quantile",
    "study_daily_quantile_regression",
    "study_exposure_quantile",
    "study_illiq_backtest",
    "study_monthly_illiq_backtest",
    "study_mvo_report",
    "study_signal_comparison",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelspark-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = all_queries()
    # One untimed run brings up the JVM's code paths.
    chosen["study_daily_quantile"](spark, folder).write.format("noop").mode(
        "overwrite"
    ).save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        result = chosen[name](spark, folder)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
