"""Wall time of the headline queries: prints one JSON line.

``BENCH_SF_DIR`` (default the sf0.1 tables) and ``BENCH_CPUS`` (default all) choose data and cores;
``BENCH_QUERIES`` (comma separated) narrows the list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cpgloom.plans import catalog
from cpgloom.session import local_session

HEADLINE = [
    "s03_top_correlated_probes",
    "s04_two_stage_selection",
    "d03_probe_correlation",
    "d04_probe_correlation_by_sex",
    "d01_sample_moments",
    "d09_error_metrics",
    "d15_demographic_hierarchy",
    "d17_model_agreement",
    "d21_calibration_curve",
    "d31_error_density",
    "d35_wilcoxon_signed_rank",
    "d36_spearman",
    "w01_rolling_bands",
    "w02_moving_average",
    "i02_mean_fill",
    "i04_knn_fill",
    "a03_wide_matrix_ingest",
    "c03_submission_scores",
    "w03_leaderboard",
    "m17_clock_scores",
    "m18_clock_calibration",
    "m02_tuned_elastic_net",
    "m24_training_run",
    "v06_out_of_fold_predictions",
    "r02_stream_sample_moments",
]


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores=cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{data}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the executors
    took = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, data).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {took[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(data.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
