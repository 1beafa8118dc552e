"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS], consumes the whole result through the ``noop`` sink
(every row computed, nothing collected) and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query runs once to warm up, then $BENCH_REPEAT times (default 3); the
median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "combined_sales", "sheet_monthly", "dashboard", "dashboard_rep", "dashboard_by_rep",
    "lost_sales", "lost_sales_by_rep", "lost_sales_latest4", "reminders",
    "sales_page", "sales_search", "prescription_page", "tender_page",
    "upsert_manual", "kpi_upsert", "apply_sales", "purge_cascade",
    "orphans", "domain_checks", "duplicate_keys",
    "sheet_normalise", "derive_customer", "snapshot_diff",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = os.environ.get("BENCH_QUERIES")
    # One shuffle partition per core measured fastest at sf0.1 (8: 24.0 s, 16: 26.4 s, 32: 27.8 s on a
    # six-query subset); AQE coalesces further. On a cluster use many more (see README).
    shuffle = int(os.environ.get("BENCH_SHUFFLE", cpus))
    from fieldlens.catalog import QUERIES
    from fieldlens.session import build_session

    log_dir = tempfile.mkdtemp(prefix="fieldlens-events-")
    spark = build_session(f"local[{cpus}]", shuffle, app_name="fieldlens-bench",
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.driver.memory": "16g"})
    results, errors = {}, {}
    for name in (names.split(",") if names else HEADLINE):
        try:
            run = lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            run()
            times = []
            for _ in range(repeat):
                t0 = time.perf_counter()
                run()
                times.append(time.perf_counter() - t0)
            results[name] = round(statistics.median(times), 3)
        except Exception as e:  # keep going; report the failure
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"# {name}: {results.get(name, errors.get(name))}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total_median_sec", "value": round(sum(results.values()), 3), "unit": "sec",
           "queries": results, "sf": sf, "cpus": int(cpus), "repeat": repeat}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
