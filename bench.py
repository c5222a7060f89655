"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's plan is executed to completion with the ``noop`` sink (no driver
collection) and timed; prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewright.registry import QUERIES  # noqa: E402
from tablewright.session import build_session  # noqa: E402

HEADLINE = [
    "column_profile", "null_profile", "distinct_profile", "iqr_outliers", "duplicate_row_count",
    "date_order_conflicts", "dedup_full_row", "dedup_keep_first", "apply_canonical_map",
    "impute_median", "clip_iqr", "date_to_epoch", "one_hot_encode", "fuzzy_pairs", "fuzzy_clusters",
    "stratified_split", "cross_split_duplicates", "gate_report", "profile_issues",
    "clean_conservative_median",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8),
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    # warm-up: JVM, parquet footers, codegen cache
    QUERIES["dataset_shape"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, errors = {}, {}
    for name in names:
        t0 = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # noqa: BLE001 -- a failed query is reported, not fatal
            times[name] = None
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "total_wall_time", "value": round(sum(t for t in times.values() if t), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
