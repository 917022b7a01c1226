"""Wall time and shuffle volume per query, from Spark's event log.

Runs the named queries through the noop sink with the event log written to a fresh
scratch folder, tags each query's jobs with ``setJobDescription`` and sums the
task metrics of their stages.

    python tools/shuffle_report.py /root/testdata/sf0.1 q5_discovery_calls,q6_full_funnel
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from funnelkit import catalog  # noqa: E402
from funnelkit.sources import crm  # noqa: E402


def session(log_dir: str) -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("funnelkit-shuffle")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16").config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parse(log_dir: str) -> dict:
    stage_owner, out = {}, defaultdict(lambda: defaultdict(int))
    for path in [p for p in glob.glob(f"{log_dir}/**/*", recursive=True) if os.path.isfile(p)]:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (ev.get("Properties") or {}).get("spark.job.description")
                    for sid in ev.get("Stage IDs", []):
                        stage_owner[sid] = desc
                elif kind == "SparkListenerTaskEnd":
                    owner = stage_owner.get(ev.get("Stage ID"))
                    m = ev.get("Task Metrics") or {}
                    owner = owner or "(untagged)"
                    out[owner]["shuffle_write_bytes"] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                    out[owner]["shuffle_records"] += m.get("Shuffle Write Metrics", {}).get("Shuffle Records Written", 0)
                    out[owner]["tasks"] += 1
    return out


def main() -> None:
    sf_dir = sys.argv[1]
    names = sys.argv[2].split(",")
    log_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = session(log_dir)
    sc = spark.sparkContext
    views = crm.load(spark, sf_dir)
    timing = {}
    for name in names:
        sc.setJobDescription(name)
        t0 = time.perf_counter()
        df = catalog.run(spark, sf_dir, name)
        df.write.format("noop").mode("overwrite").save()
        timing[name] = round(time.perf_counter() - t0, 2)
    sc.setJobDescription(None)
    spark.stop()
    metrics = parse(log_dir)
    print("| query | wall s | shuffle write MB | shuffle records | tasks |")
    print("|---|---|---|---|---|")
    for name in names + ["(untagged)"]:
        m = metrics.get(name, {})
        print(f"| {name} | {timing.get(name, '')} | {m.get('shuffle_write_bytes', 0) / 1e6:.2f} | "
              f"{m.get('shuffle_records', 0)} | {m.get('tasks', 0)} |")


if __name__ == "__main__":
    main()
