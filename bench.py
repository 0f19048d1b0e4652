"""Benchmark of the headline queries.

Runs each query's full plan at $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS] and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
Every query is executed end to end into the no-op sink (all rows produced,
nothing collected to the driver). Each query runs twice: ``queries`` holds
the second (warm: JIT-compiled code paths, parquet footers cached) time,
``cold`` the first. BENCH_ALL=1 runs every registered query.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "agg01_event_heatmap",
    "mkt01_asof_price",
    "mkt02_event_returns",
    "prd02_verify_predictions",
    "prd04_accuracy_by",
    "fea06_label_breakout",
    "eda01_lag_correlation",
    "txt01_dedup_articles",
    "txt05_relevance_score",
    "txt06_categorize_news",
    "txt11_extract_countries",
    "flt01_search_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from eventlens.session import get_session
    from eventlens.plans import REGISTRY

    spark = get_session(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    names = list(REGISTRY) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in REGISTRY]
    extra = os.environ.get("BENCH_EXTRA")
    if extra:
        names += [n for n in extra.split(",") if n in REGISTRY and n not in names]
    # Warm-up: JVM, parquet footers, codegen caches.
    REGISTRY[names[0]].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        for rep in range(2):
            t0 = time.time()
            REGISTRY[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            (cold if rep == 0 else times)[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "cold": cold,
                      "cold_total_sec": round(sum(cold.values()), 3),
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
