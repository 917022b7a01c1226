"""Benchmark: run the headline reports on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from funnelkit import catalog  # noqa: E402
from funnelkit.session import get_session  # noqa: E402

HEADLINE = [
    "q1_rep_count_by_quarter", "q2_accounts_touched", "q3_activity_volume", "q4_active_reps",
    "q5_discovery_calls", "q6_full_funnel", "q7_lead_validation", "q8_inbound_leads",
    "q9_won_with_lead", "q10_opps_created", "q11_win_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    spark = get_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", int(cpus) * 2)), app="funnelkit-bench")
    # JVM / reader warm-up, not timed
    catalog.run(spark, sf_dir, "q11_win_rate").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.run(spark, sf_dir, name).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
