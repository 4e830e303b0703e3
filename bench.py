"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS
(default 1; the best run counts) choose data, cores and repetitions. A few queries run
once untimed first, to start the Python workers and load the code.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidewright.catalog import QUERIES  # noqa: E402
from tidewright.session import build_session  # noqa: E402

HEADLINE = """scan_csv clean_all iqr_sequential mahalanobis_chi2 assign_periods override_lookup
profile_columns summary_stats corr_matrix histogram residual_kde boxplot_stats time_resolution
resample_mean_dense lag_features lag_features_chunked lag_features_by_key rolling_mean_std rolling_median
features_split_scoped temporal_split ts_cv_folds persistence_by_period standard_scale augment_noise
cross_correlation autocorrelation knn_regress fit_random_forest fit_gbt grid_search forecast
permutation_importance shap_importance experiment""".split()

WARM_UP = "lag_features residual_kde summary_stats".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="20g")
    for name in WARM_UP:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(sf).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
