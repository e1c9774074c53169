"""Summarise the physical plan of every catalogue query (before AQE's runtime
re-planning): shuffles, broadcasts, join strategies, scans with their pruned
read schema and pushed filters, and Python stages. Writes markdown to stdout.

usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ratecraft.plans.catalog import QUERIES  # noqa: E402
from ratecraft.session import local_session  # noqa: E402

SKIP = {"als_rank_search", "als_select_best", "stream_ingest", "stream_item_stats",
        "report_sink"}


def summarise(plan: str) -> dict:
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?Location: \S+\(\d+ paths?\)\[[^\]]*/(\w+)\.parquet\]"
                       r".*?PushedFilters: \[([^\]]*)\]", plan)
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "cartesian": plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin"),
        "partial_agg": len(re.findall(r"HashAggregate\(keys=\[[^\]]*\], functions=\[partial_", plan)),
        "python": len(re.findall(r"FlatMapCoGroupsInPandas|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)),
        "scans": sorted({f"{t}({len(cols.split(','))} cols{'; ' + f if f else ''})"
                         for cols, t, f in scans}),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    print(f"| query | shuffles | broadcasts | SMJ | BHJ | cartesian | partial aggs | python stages | scans (columns read; pushed filters) |")
    print("|---|---|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        if name in SKIP:
            continue
        df = fn(spark, sf)
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {name} | {s['shuffles']} | {s['broadcasts']} | {s['smj']} | {s['bhj']} | "
              f"{s['cartesian']} | {s['partial_agg']} | {s['python']} | {'; '.join(s['scans'])} |")


if __name__ == "__main__":
    main()
