"""Benchmark the headline queries; prints one JSON line.

Config from the environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1),
``BENCH_CPUS`` (default 8), ``BENCH_REPS`` (default 3). Each query is run once
to warm up, then timed ``BENCH_REPS`` times; the median is reported. A run
covers building the query (including its one-row global aggregates) and
executing the whole plan into Spark's ``noop`` sink, so no result rows are
pulled to the driver. ``run_cold`` is the first complete run of the session
(derive and load the tables, clean, impute, join and write the final table),
timed once with nothing loaded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.plans import catalog, pipeline  # noqa: E402
from tillroll.session import get_session  # noqa: E402

# imputation and profiling.
HEADLINE = ["impute_price", "final_output", "median_price", "hour_box",
            "impute_total", "share_state", "imputation_levels"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=2 * cpus)

    def once(name: str) -> float:
        t0 = time.perf_counter()
        df = catalog.REGISTRY[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    def cold() -> float:
        t0 = time.perf_counter()
        out = tempfile.mkdtemp(prefix="bench-run-") + "/final"
        pipeline.run(spark, pipeline.Inputs.from_fixtures(spark, sf_dir), out, pipeline.FIXTURE_PARAMS)
        return time.perf_counter() - t0

    results = {}
    if not sys.argv[1:]:
        results["run_cold"] = round(cold(), 3)
    for name in names:
        once(name)
        results[name] = round(statistics.median(once(name) for _ in range(reps)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "median_query_seconds_total", "value": round(sum(results.values()), 3),
                      "unit": "sec", "queries": results, "sf": sf, "cpus": cpus, "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
