"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tabsieve.plans import REGISTERED
from tabsieve.session import local_session

HEADLINE = [
    "a01_class_balance", "a02_sentinel_profile", "a05_a06_duplicates_and_conflicts", "w01_clean_dedup_and_conflicts",
    "a08_dominance", "a12_pearson_matrix", "a13_pearson_with_label", "a17_anova_f", "x01_stratified_holdout",
    "x03_stratified_kfold", "i05_median_and_indicators", "e02_standard_scaler", "k02_correlation_pruning",
    "c02_c06_full_report", "c13_expected_cost", "g16_holdout_report", "g01_g02_cross_validation",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    only = os.environ.get("BENCH_QUERIES")
    spark = local_session("bench")
    times: dict[str, float] = {}
    REGISTERED["a01_class_balance"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up is not timed
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        REGISTERED[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
