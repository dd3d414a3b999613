"""Time the headline jobs and print one JSON line.

Each query runs once to warm up and three times to the noop sink; the median counts.
BENCH_SF_DIR chooses the data (default sf0.1), BENCH_CPUS the local cores.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgersight.catalog import QUERIES  # noqa: E402
from ledgersight.session import build_session  # noqa: E402

HEADLINE = (
    "job_velocity_features",      # gaps, rolling windows, distinct counts, sessions, ratios
    "job_training_rows",          # union, label join, windows, sampling, categories
    "job_scored_rows",            # customer reduction, windows, scored rows
    "job_full_feature_table",     # four periods, history block, sampling mask
    "job_full_with_priors",       # and 7 prior tables fitted, applied and mean-filled
    "win_28_cust_prev_amt_std",   # history block alone
    "win_12_unique_mcc_7d",       # sliding distinct count alone
    "ml_12_average_precision",
    "ml_13_blend_search",         # 96 weight triples
    "agg_9_numeric_correlations",
    "agg_14_histograms",
    "job_disagreement_report",
)
REPEATS = 3


def run(spark, name, base):
    start = time.perf_counter()
    QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", cpus,
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        run(spark, name, base)
        times[name] = round(statistics.median(run(spark, name, base) for _ in range(REPEATS)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": base.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
