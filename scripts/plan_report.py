"""Physical-plan summary of the headline queries (operators, exchanges, scans).

Usage: python scripts/plan_report.py [sf_dir] > PLANS.md
"""

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from canopy.session import get_spark  # noqa: E402

OPS = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
       "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "HashAggregate", "ObjectHashAggregate", "SortAggregate", "WindowGroupLimit", "Window", "TakeOrderedAndProject",
       "Generate", "MapInArrow", "MapInPandas", "ArrowEvalPython", "FlatMapGroupsInPandas", "WholeStageCodegen")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark(shuffle_partitions=16)
    from canopy.plans.catalog import QUERIES
    print("# Physical plans of the headline queries\n")
    print(f"Generated by `scripts/plan_report.py` on `{sf}` (AQE on; final plans may coalesce partitions "
          "or switch joins at run time).  Counts are operator occurrences in the executed plan.\n")
    for n in HEADLINE:
        df = QUERIES[n](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        c = Counter()
        for op in OPS:
            c[op] = len(re.findall(r"\b" + re.escape(op) + r"\b", plan))
        scans = sorted(set(re.findall(r"ReadSchema: (struct<[^\n]*?>)(?:\n|,|$)", plan)))
        pushed = sorted(set(re.findall(r"PushedFilters: (\[[^\]]*\])", plan)))
        print(f"## {n}\n")
        print("| operator | count |\n|---|---|")
        for op, k in c.items():
            if k:
                print(f"| {op} | {k} |")
        for s in scans:
            print(f"\n* scan `{s[:200]}`")
        for p in pushed:
            if p != "[]":
                print(f"* pushed filters `{p[:200]}`")
        print()
    spark.stop()


if __name__ == "__main__":
    main()
