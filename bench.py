"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is run to completion into Spark's ``noop`` sink (full execution,
no driver-side collection), once to warm up and then timed.  Prints one JSON
line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weirline.plans.catalog import queries  # noqa: E402
from weirline.session import local_session  # noqa: E402

HEADLINE = [
    "enriched_view",      # disjunctive join, rewritten to equi-joins
    "overview",           # three summaries incl. the enriched view
    "country_analysis",   # fan-out join aggregated without the fan-out
    "cascade_kept",       # cascading semi/anti joins through four tables
    "region_rollup",      # dams -> stations -> readings rollup
    "monitoring_coverage",
    "infrastructure_types",
    "recent_readings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="weirline-bench")
    qs = queries()
    spark.range(1).count()
    times = {}
    for name in HEADLINE:
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
