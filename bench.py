"""Time every registered query; prints one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query, the median counts (default 1, after one warm-up)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from millrace.plans import QUERIES
from millrace.session import build_session


def timed(spark, key: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main(keys: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(f"local[{cpus}]", "bench", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for key in keys or list(QUERIES):
        timed(spark, key, sf_dir)
        seconds[key] = round(statistics.median(timed(spark, key, sf_dir) for _ in range(runs)), 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main(sys.argv[1:])
