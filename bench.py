"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "clean_chain", "fill_median", "fill_forward", "fill_interpolate", "dedup_first", "outliers_iqr", "standardize",
    "label_encode_wide", "onehot", "infer_types", "column_stats_lineitem", "top_values", "correlation", "histogram",
    "quantiles", "duplicate_count", "stratified_folds", "roc_auc", "weighted_prf", "leaderboard", "leaderboard_all_jobs",
    "lookup_join", "latest_by_key", "log_parse", "log_stats", "ofx_extract", "content_checksum", "window_counts",
    "knn_classify", "ridge_score",
)


def main() -> None:
    from tabwright.plans import suite
    from tabwright.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = build_session("bench", cpus)
    names = sys.argv[1:] or HEADLINE
    # one untimed query starts the JVM code paths
    suite.QUERIES["status_rollup"](spark, sf_dir).collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": float(scale)}))


if __name__ == "__main__":
    main()
