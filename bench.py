"""Time the registered queries and print one JSON line.

Results go to Spark's ``noop`` sink, so every row is computed and none comes to
the driver. ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_QUERIES`` (names
separated by commas) choose data, cores and queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from harness.registry import QUERIES
from harness.roles import stored_training
from labelloom.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = local_session("bench", cores, driver_memory="16g")
    seconds = {}

    started = time.perf_counter()
    stored_training(spark, sf_dir)
    seconds["build_training_table"] = round(time.perf_counter() - started, 3)
    for name in chosen:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of all registered queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
