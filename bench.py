"""Times the headline queries: one JSON line, the median of three warm runs each."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from kestrova.queries import QUERIES

HEADLINE = [
    "feature_grid", "feature_average", "feature_volatility", "feature_kurtosis", "feature_linear_tempreg", "feature_kama", "feature_stochastic_rsi", "feature_shannon_entropy", "feature_lempel_ziv_entropy",
    "feature_vortex", "feature_ou", "label_triple_barrier", "label_regression_rank", "bars_cumulative", "series_decomposition", "event_extraction", "sample_weights", "metrics_performance", "correlation_selector", "model_ols",
    "signal_confirmation", "backtest_operations", "options_black_scholes", "distance_correlation",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, failed = {}, {}
    for name in HEADLINE:
        runs = []
        try:
            for _ in range(4):
                began = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - began)
            took[name] = round(statistics.median(runs[1:]), 4)
        except Exception as e:  # one query must not cost the others their figures
            failed[name] = str(e).splitlines()[0][:200]
        print(name, took.get(name, failed.get(name)), file=sys.stderr)
    print(json.dumps({"metric": "total of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "failed": failed, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
