"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], warm, median of
three; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardframe.plans.queries import QUERIES  # noqa: E402
from wardframe.session import local_session  # noqa: E402

HEADLINE = [
    "code_filter", "label_map_cap", "interval_left_join", "labs_24h_pivot", "labs_long_ranked",
    "nearest_liver", "nearest_vitals", "stay_order_rank", "dense_rank_by_day", "latest_service",
    "latest_service_left", "mortality_flags", "multi_source_flag", "phenotype_primary_secondary",
    "dictionary_join_fanout", "cohort_exclusions", "star_features", "missing_pct", "median_impute",
    "column_quantiles", "kfold_contiguous", "roc_curve", "auc_scores", "tableone_continuous",
    "kruskal_h", "chi2_stat", "final_cohort", "view_cohort", "long_cohort", "renal_replacement",
    "tableone_report", "l1_logistic_odds",
]
# cross-validated trees are many jobs, so one timed run says enough
ONCE = ["gbt_cv_auc"]


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, "12g")
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in [n for n in HEADLINE if not only or n in only]:
        seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(3)), 3)
    for name in [n for n in ONCE if not only or n in only]:
        times[name] = round(seconds(spark, name, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
