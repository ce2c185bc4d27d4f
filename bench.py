"""Time the headline queries on $BENCH_SF_DIR with $BENCH_CPUS cores and print one line of JSON.

Each query is built anew, run unmeasured until the JVM has compiled it, and then measured; its time is the median. Results are fully computed and
thrown away (``noop``), input and output included. $BENCH_RUNS, $BENCH_WARM
(runs before) and $BENCH_ONLY (a regular expression) change what is run.
"""

from __future__ import annotations

import json
import math
import os
import re
import statistics
import sys
import time

HEADLINE = [f"tpch_q{n}" for n in range(1, 23)]
HEADLINE += [f"h2o_gb{n}" for n in range(1, 11)] + [f"h2o_j{n}" for n in range(1, 6)]
HEADLINE += ["asof_backward", "dynamic_sliding_by_key", "rolling_by_time", "rank_methods", "pivot_sum", "interval_join"]


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    os.environ["PYTHONPATH"] = here + os.pathsep + os.environ.get("PYTHONPATH", "")
    from lumenfold.plans import registry
    from lumenfold.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    warm = int(os.environ.get("BENCH_WARM", "3"))
    only = re.compile(os.environ.get("BENCH_ONLY", "."))
    spark = local_session(int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1)), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    times = {}
    for name in filter(only.search, HEADLINE):
        took = []
        for k in range(warm + runs):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if k >= warm:
                took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took), 4)
    total = round(sum(times.values()), 4)
    mean = lambda kind: round(math.exp(statistics.fmean([math.log(v) for n, v in times.items() if n.startswith(kind)] or [0])), 4)
    out = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    print(json.dumps(out | {"geomean_tpch": mean("tpch"), "geomean_h2o": mean("h2o")}))
    spark.stop()


if __name__ == "__main__":
    main()
