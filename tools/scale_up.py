"""Write an N-times larger copy of a driver-table folder, derived with Spark.

Each table is unioned N times; copy k shifts every key by k times the key's
range (orders, customers, parts, suppliers, events, users), so joins keep their
shape and per-key distributions match the source, like a larger TPC-H scale
factor.  Used to see how the reports scale with data volume.

    python tools/scale_up.py /root/testdata/sf0.1 10 [out_dir]
"""

from __future__ import annotations

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from funnelkit.session import get_session  # noqa: E402

# table -> {column: key family}
KEYS = {
    "customer": {"c_custkey": "cust"},
    "supplier": {"s_suppkey": "supp"},
    "part": {"p_partkey": "part"},
    "orders": {"o_orderkey": "order", "o_custkey": "cust"},
    "lineitem": {"l_orderkey": "order", "l_partkey": "part", "l_suppkey": "supp"},
    "events": {"event_id": "event", "user_id": "user"},
}
RANGE_OF = {"cust": ("customer", "c_custkey"), "supp": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"),
            "order": ("orders", "o_orderkey"), "event": ("events", "event_id"), "user": ("events", "user_id")}


def main() -> None:
    src, n = sys.argv[1], int(sys.argv[2])
    out = sys.argv[3] if len(sys.argv) > 3 else tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = get_session(cores="8", shuffle_partitions=16, app="funnelkit-scale-up")
    read = {t: spark.read.parquet(f"{src}/{t}.parquet") for t in ["region", "nation", *KEYS]}
    span = {fam: read[t].agg(F.max(c) + 1).first()[0] for fam, (t, c) in RANGE_OF.items()}
    for t in ["region", "nation"]:
        read[t].write.parquet(f"{out}/{t}.parquet")
    for t, cols in KEYS.items():
        # n copies of every row: a fixed replication factor, generated per row
        df = read[t].withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
        for c, fam in cols.items():
            df = df.withColumn(c, (F.col(c) + F.col("_k") * F.lit(span[fam])).cast(read[t].schema[c].dataType))
        df.drop("_k").write.parquet(f"{out}/{t}.parquet")
    print(out)


if __name__ == "__main__":
    main()
