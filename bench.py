"""Timed headline queries; prints one JSON line.

Every query starts from the given tables: shared intermediate tables are forgotten
before each run, so a time covers all its stages.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from moundlake.runtime import session  # noqa: E402
from moundlake.workload import catalogue, stages  # noqa: E402

HEADLINE = [
    "process", "AGG-01", "JON-09", "WIN-02", "GEO-15", "PRJ-20", "GEO-16", "AGG-16", "AGG-18", "AGG-07",
    "GEO-10", "GEO-11", "AGG-27", "AGG-22", "SRC-10",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    names = sys.argv[1:] or HEADLINE
    # one warm-up so that the first query does not pay for the JVM start
    queries["SRC-01"](spark, sf_dir).collect()
    times = {}
    for name in names:
        stages.clear()
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
