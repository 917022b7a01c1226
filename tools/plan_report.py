"""Summarise the final (adaptive) physical plan of every registered query.

Runs each query once on ``sf_dir`` and counts, in the final plan: shuffle
exchanges, broadcasts, sort-merge / broadcast-hash joins, parquet scans and how
many of them carry pushed filters, window group limits and checkpointed inputs.
Prints a markdown table (used for PLANS.md).

    python tools/plan_report.py /root/testdata/sf0.1
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from funnelkit import catalog  # noqa: E402
from funnelkit.session import get_session  # noqa: E402


def summarise(plan: str) -> dict:
    plan = plan.split("== Initial Plan ==")[0]     # final adaptive plan only
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "scans": len(scans),
        "pushed": sum(1 for s in scans if "PushedFilters: [" in s and "PushedFilters: []" not in s),
        "wgl": plan.count("WindowGroupLimit"),
        "ckpt": plan.count("Scan ExistingRDD") + plan.count("LogicalRDD"),
        "python": plan.count("EvalPython") + plan.count("InPandas"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session(cores="8", shuffle_partitions=16, app="funnelkit-plans")
    cols = ["shuffles", "broadcasts", "smj", "bhj", "scans", "pushed", "wgl", "ckpt", "python"]
    print("| query | " + " | ".join(cols) + " |")
    print("|---" * (len(cols) + 1) + "|")
    for name in catalog.names():
        df = catalog.run(spark, sf_dir, name)
        qe = df._jdf.queryExecution()
        qe.executedPlan().execute().count()          # run it, so the adaptive plan is final
        s = summarise(qe.executedPlan().toString())
        print(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |", flush=True)


if __name__ == "__main__":
    main()
