"""Summarise the physical plan of every registered query (writes PLANS.md).

Usage: python tools/plan_summary.py [sf_dir]

For each query: exchanges by kind, sorts, window operators, joins by
strategy, aggregates, and the columns each Parquet scan reads.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from faretrail.plans import catalog  # noqa: E402
from faretrail.session import get_session  # noqa: E402


def summarise(plan: str) -> dict:
    c = Counter()
    for line in plan.split("\n"):
        s = line.strip().lstrip(":+- ")
        m = re.match(r"Exchange (\w+)(\(([^)]*)\))?", s)
        if m:
            keys = [k.strip() for k in (m.group(3) or "").split(",")][:-1]  # last item: partition count
            keys = [re.sub(r"#\d+L?", "", k) for k in keys]
            c["exchange " + m.group(1) + (f"({', '.join(keys)})" if keys else "")] += 1
        elif s.startswith("BroadcastExchange"):
            c["broadcast"] += 1
        elif s.startswith("Window "):
            c["window"] += 1
        elif s.startswith("Sort "):
            c["sort"] += 1
        elif s.startswith(("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin")):
            c[s.split(" ")[0]] += 1
        elif s.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")):
            c["aggregate"] += 1
        elif s.startswith("Scan ExistingRDD"):
            c["checkpoint read"] += 1
    scans = []
    for m in re.finditer(r"FileScan parquet [^\n]*?Location: [^\n]*?\[file:[^\]]*/(\w+)\.parquet\][^\n]*?ReadSchema: struct<([^>]*)>",
                         plan):
        scans.append(f"{m.group(1)}({len(m.group(2).split(','))} cols)")
    return {"ops": dict(sorted(c.items())), "scans": scans}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", "faretrail-plans")
    out = ["# Physical plans of the registered queries", "",
           f"Generated by `tools/plan_summary.py` on `{sf_dir}` (AQE initial plans). "
           "Queries that write an intermediate (e.g. `journeys`, whose numbering job runs "
           "when the DataFrame is built) show only the plan after it: a scan of the stage "
           "files in the checkpoint folder (not listed under parquet scans).", "",
           "| query | operators | parquet scans (columns read) |", "| --- | --- | --- |"]
    for name in catalog.QUERIES:
        df = catalog.run(name, spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        ops = ", ".join(f"{k} ×{v}" for k, v in s["ops"].items())
        out.append(f"| `{name}` | {ops} | {', '.join(s['scans'])} |")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
