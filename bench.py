"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables (default sf0.1), BENCH_CPUS the number of local cores. Every query is
run to completion into a no-op sink; the reported time is the best of BENCH_REPEATS runs after one
warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import time

from hourloom import queries as registry
from hourloom.session import local_session

HEADLINE = [
    "flagship_baseline", "hourly_grid", "hourly_by_location", "pivot_parameters", "join_station_left",
    "frequency_check", "diurnal_profile", "monthly_coverage", "season_matrix", "series_audit",
    "describe_values", "exceedance_24h", "extreme_events", "correlation_matrix", "linear_fit",
    "histogram", "box_stats", "qq_points", "lag_features", "rolling_min_count", "halo_features",
    "many_series_windows", "feature_set_t1", "feature_set_v2", "distributed_rank", "expanding_folds",
    "persistence_metrics", "dm_statistic", "fit_linear",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    registry.RUNNERS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    registry.load()
    spark = local_session(cpus, name="bench")
    run(spark, "hourly_grid", sf_dir)
    seconds = {n: round(min(run(spark, n, sf_dir) for _ in range(repeats)), 3) for n in names}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
