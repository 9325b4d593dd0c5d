"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of per-query medians, sec),
"unit", "queries": {name: sec}, "sf", ...}.  Each query is fully executed
with the ``noop`` sink (no driver collect); the median of $BENCH_REPS runs
is reported after one warm-up run of the whole set.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "directory_rollup", "directory_summary", "declaration_chunks", "incremental_new_content",
    "topk_similar", "topk_similar_batch", "domain_assignment", "cluster_quality", "ontology_links",
    "context_search", "bm25_topk", "hybrid_topk", "ann_ivf_topk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    names = sys.argv[1:] or HEADLINE
    os.environ.setdefault("CANOPY_MASTER", f"local[{cpus}]")
    from canopy.session import get_spark
    from canopy.plans.catalog import QUERIES
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        return time.perf_counter() - t0

    for n in names:  # warm-up: JIT, Python workers, file listing caches
        run(n)
    out = {}
    for n in names:
        out[n] = round(statistics.median(run(n) for _ in range(reps)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(m.group(1)) if m else None, "cpus": int(cpus),
                      "reps": reps}))
    spark.stop()


if __name__ == "__main__":
    main()
