"""Run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from curveboard.plans.queries import QUERIES  # noqa: E402
from curveboard.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_leaderboard",
    "A1_A6_curve_aggregates",
    "A8_learning_stability_5",
    "A11_biggest_drop",
    "A13_ramp_cutoff",
    "M1_M7_standard_metrics",
    "L11_minmax_zero",
    "L12_robust_scaling",
    "L16_board_family",
    "L17_parameter_slices",
    "R2_metric_correlation",
    "R6_jaccard",
    "R8_multiset_jaccard",
    "R10_kendall_matrix",
    "R15_bootstrap_tau",
    "R23_greedy_elimination",
    "N1_start_point_scenario",
    "N1_start_point_3000",
    "N3_dataset_3000",
    "W7_open_runs",
    "W20_prune_dense",
    "C4_duplicate_combinations",
    "P3_mean_times",
    "D2_avg_dist_labeled",
    "D6_class_manhattan_added_up",
    "E8_stratified_splits",
    "E12_knn",
    "K1_wrong_classifications",
    "K4_region_density",
    "K3_boundary_closeness",
    "K9_cluster_center_closeness",
    "K11_average_uncertainty",
    "Q4_entropy",
    "Q8_k_center_coreset",
    "ST1_ingest_late_copies",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # one throw-away run starts the JVM, the Python workers and the file cache
    QUERIES["flagship_leaderboard"](spark, path).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    scale = os.path.basename(path.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
