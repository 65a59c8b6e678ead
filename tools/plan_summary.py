"""Summarise the executed physical plan of every registered query into PLANS.md.

Usage: python tools/plan_summary.py [sf_dir]

Each query is run once so the summary reflects the final
adaptive plan: shuffles, join strategies, windows, Python evaluation and
Parquet scans with their pushed filters.
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cytotide.session import get_session  # noqa: E402
import workload  # noqa: E402

COUNTS = [
    ("shuffles", r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition"),
    ("broadcast joins", r"\bBroadcastHashJoin\b"),
    ("sort-merge joins", r"\bSortMergeJoin\b"),
    ("shuffled hash joins", r"\bShuffledHashJoin\b"),
    ("nested-loop joins", r"\bBroadcastNestedLoopJoin\b|\bCartesianProduct\b"),
    ("windows", r"\bWindow\b"),
    ("python", r"\bBatchEvalPython\b|\bArrowEvalPython\b|\bFlatMapGroupsInPandas\b|\bMapInPandas\b|\bMapInArrow\b"),
]


def summarise(df) -> dict:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    try:  # adaptive plan: use the final plan
        text = plan.finalPhysicalPlan().toString()
    except Exception:  # noqa: BLE001
        pass
    if "Scan parquet" not in text:  # a part found empty at run time has left the plan: show what was planned
        text = df._jdf.queryExecution().sparkPlan().toString()
    out = {name: len(re.findall(rx, text)) for name, rx in COUNTS}
    scans = [line for line in text.splitlines() if "Scan parquet" in line]
    out["parquet scans"] = len(scans)
    out["pushed filters"] = sum(1 for line in scans if re.search(r"PushedFilters: \[[^\]]", line))
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = workload.load()
    rows = []
    for name, fn in queries.items():
        s = summarise(fn(spark, sf))
        rows.append((name, s))
    cols = [c for c, _ in COUNTS] + ["parquet scans", "pushed filters"]
    lines = ["# Physical plans of the registered queries", "",
             f"Final adaptive plans at `{sf}` (local[8]); counts of operators in the final job of each",
             "query. Small sides measured and materialised beforehand (checkpointed plan intervals,",
             "range tables) appear as `Scan ExistingRDD` and are not counted as scans. The shuffle",
             "column also counts the single-partition exchange inside scalar subqueries over those",
             "small tables (e.g. the plan cap of a range join); particle rows are shuffled only by",
             "the final partially aggregated count/sum of a flow.", "",
             "| query | " + " | ".join(cols) + " |", "|---|" + "---|" * len(cols)]
    for name, s in rows:
        lines.append(f"| `{name}` | " + " | ".join(str(s[c]) for c in cols) + " |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
