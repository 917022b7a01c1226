"""Time every report on the driver tables and on a copy in which one customer holds a third of orders and events.

``python tools/skew_compare.py SF_DIR [--timeout SEC]`` prints one JSON line with seconds per report for both.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from funnelkit.plans import reports  # noqa: E402
from funnelkit.session import get_session  # noqa: E402
from funnelkit.sources import crm  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
HOT = 7


def skewed_copy(spark, sf_dir: str, out_dir: str) -> None:
    for t in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        if t == "orders":
            df = df.withColumn("o_custkey", F.when(F.xxhash64("o_orderkey") % 3 == 0, F.lit(HOT).cast("bigint"))
                               .otherwise(F.col("o_custkey")))
        if t == "events":
            df = df.withColumn("user_id", F.when(F.xxhash64("event_id") % 3 == 0, F.lit(HOT).cast("bigint"))
                               .otherwise(F.col("user_id")))
        df.write.parquet(f"{out_dir}/{t}.parquet")


def timed(spark, fn, timeout: float):
    group = f"skew-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    timer = threading.Timer(timeout, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    t0 = time.perf_counter()
    try:
        fn().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - t0, 2)
    except Exception:  # cancelled
        return f">{timeout}"
    finally:
        timer.cancel()


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("sf_dir")
    ap.add_argument("--timeout", type=float, default=300)
    args = ap.parse_args()
    spark = get_session(cores="8", shuffle_partitions=16, app="funnelkit-skew")
    scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    skewed_copy(spark, args.sf_dir, scratch)
    out = {}
    for label, d in (("original", args.sf_dir), ("skewed", scratch)):
        views = crm.load(spark, d)
        out[label] = {name: timed(spark, lambda: report(views), args.timeout) for name, report in reports.REPORTS.items()}
    print(json.dumps({"sf_dir": args.sf_dir, "scratch": scratch, **out}))


if __name__ == "__main__":
    main()
