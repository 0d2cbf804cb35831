"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up code generation and the page cache, then one timed run counts.
A run writes to the no-op sink, so every row and column is produced.
"""

import contextlib
import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = (
    "W05_rolling_mode", "I13_best_option", "I15_quota_assign", "M05_auc", "M29_metrics_report", "I30_compare_runs",
    "J09_asof_backward", "I29_meta_recommend", "T01_series_summary", "W11_prefix_sum", "A16_exact_percentile", "A28_describe_by",
    "K09_woe_iv", "I27_kaplan_meier", "W09_last_k_items", "X06_tfidf", "X13_nearest_vectors", "J13_radius_counts", "R01_service_stats",
)


def main() -> None:
    from tabloom.plans import registry
    from tabloom.session import local_session

    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(CPUS)
        registry.load_all()
        times = {}
        for name in HEADLINE:
            runs = []
            for _ in range(2):
                start = time.perf_counter()
                registry.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - start)
            times[name] = round(runs[-1], 3)
            print(name, times[name], file=sys.stderr, flush=True)
        spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
