"""Time the headline queries and print one JSON line.

Each query is planned and executed into a no-op sink; the figure is the median
of three runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "day_spine_panel", "daily_panel", "unit_by_day", "service_by_day", "return_within_30d", "prior_visits_6m_capped",
    "point_in_interval", "interval_volume_per_bin", "active_rate_median_max", "running_balance", "hold_with_expiry",
    "gap_interpolation", "icu_panel", "replay_table", "history_vector", "padded_sequences", "binary_metrics", "spearman",
    "balance_table", "bootstrap_effect", "dr_ope", "exhaustive_policy", "column_groups", "coverage_profile",
]


def main() -> None:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    from episodia.catalog import load_queries
    from episodia.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cores)
    queries = load_queries()
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    times: dict[str, float] = {}
    for name in wanted:
        if name not in queries:
            continue
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 4)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(scale),
    }))


if __name__ == "__main__":
    main()
