"""Write PLANS.md: the final (post-AQE) physical plan outline of the headline
queries, after running each one to completion.

Usage: python tools/plans.py [sf_dir] [out_file]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from weirline.plans.catalog import queries  # noqa: E402
from weirline.session import local_session  # noqa: E402

KEEP = ("Join", "Exchange", "Aggregate", "Window", "Expand", "TakeOrdered", "Generate", "AQEShuffleRead",
        "Union", "Scan parquet", "InMemoryTableScan", "Scan ExistingRDD")


def outline(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        if "Initial Plan" in line:
            break
        if any(k in line for k in KEEP):
            out.append(line.rstrip()[:160])
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out_file = sys.argv[2] if len(sys.argv) > 2 else "PLANS.md"
    spark = local_session(8, 8, app="weirline-plans")
    qs = queries()
    parts = ["# Final physical plans of the headline queries", "",
             f"Data: `{sf_dir}`, local[8], AQE on.  Outline of the final adaptive plan after one run",
             "(joins, exchanges, aggregates, windows, scans); generated by `tools/plans.py`.", ""]
    for name in HEADLINE:
        df = qs[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        parts += [f"## {name}", "", "```", *outline(plan), "```", ""]
    with open(out_file, "w") as f:
        f.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main()
