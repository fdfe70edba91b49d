"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run once to warm up and then timed: the median of three runs when
a run is short, one run otherwise. Every result row is produced, into a no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tsprobe.plans.catalogue import QUERIES
from tsprobe.session import local_session

HEADLINE = [
    "window_class_split", "count_windows_majority", "lookback_horizon", "znorm_series", "channel_scaler", "stft_power",
    "stratified_split", "stratified_sample", "group_split", "shuffle_reindex", "kfold_stratified",
    "classification_metrics", "bootstrap_ci", "pass_at_k", "majority_vote", "run_completeness",
    "clean_results", "keep_latest", "variant_summary", "probe_curve_mean", "last_layer",
    "trend_segments", "trend_summary", "extract_letter", "digit_text", "serialize_series", "collect_answers",
    "vector_mean", "knn_cosine", "knn_grid", "ridge_probe", "logistic_probe", "stream_count_windows",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    timings: dict[str, float] = {}
    for name in HEADLINE:
        try:
            run(spark, name, sf_dir)
            runs = [run(spark, name, sf_dir)]
            runs += [run(spark, name, sf_dir) for _ in range(2 if runs[0] < 0.8 else 0)]  # quick queries are noisy
            timings[name] = round(statistics.median(runs), 3)
            print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
        except Exception as e:  # keep the line complete: a failed query is reported as null
            timings[name] = None
            print(f"{name}: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
    total = sum(t for t in timings.values() if t is not None)
    line = {"metric": "headline_total", "value": round(total, 3), "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}
    if timings.get("bootstrap_ci"):
        line["bootstrap_replicates_per_sec"] = round(40_000 / timings["bootstrap_ci"])
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
