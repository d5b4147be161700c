"""Bench: headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each workload is planned and fully executed into Spark's ``noop`` sink (no collect);
one warm-up run, then the median of three.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyrake.plans.queries import BENCH  # noqa: E402
from tallyrake.session import get_spark  # noqa: E402


def run_once(spark, fn, sf):
    t = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    elapsed = time.perf_counter() - t
    spark.catalog.clearCache()          # each run starts from the same (empty) cache
    return elapsed


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2)
    times = {}
    for name, fn in BENCH.items():
        if only and name not in only:
            continue
        run_once(spark, fn, sf)                       # warm-up
        times[name] = round(statistics.median(run_once(spark, fn, sf) for _ in range(reps)), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
