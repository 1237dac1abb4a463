"""Seconds per headline query; prints one JSON line.

Every query runs once on the smallest data set first, so that start-up and code
generation of the session are not counted, and is then timed in full: building the
plan, running it and writing the result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "alert_timeline", "alert_events", "alert_kpis", "worst_moment", "site_status", "machine_history",
    "incident_window_join", "reaction_times", "labelled_replay", "debounce",
    "duplicate_label_audit", "conflict_report", "drop_conflicting_groups", "duplicate_groups", "unique_patterns",
    "group_split", "stratified_split", "exact_stratified_split", "sample_per_class",
    "numeric_profile", "mixed_profile", "describe_features", "stats_by_class", "correlation_matrix", "class_histograms",
    "metric_row", "average_precision", "model_comparison", "threshold_sweep", "operating_modes",
    "bootstrap_hash", "bootstrap_counts", "bootstrap_ranking", "class_breakdown", "mode_recall", "unseen_family_eval",
    "quarantine", "linear_contributions", "global_importance",
    "dummy_classifier", "logistic", "forest", "boosted", "tree_shap",
    "stream_debounce", "stream_events", "stream_kpis",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from plantwatch.plans.catalog import QUERIES
    from plantwatch.session import build_session

    spark = build_session("plantwatch-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    times = {}
    for name in names:
        if os.path.isdir(small):
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
