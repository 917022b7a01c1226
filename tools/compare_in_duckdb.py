"""Compare reports with their DuckDB oracle inside DuckDB (for outputs too big for pandas).

Spark writes each report to a fresh scratch folder; DuckDB runs the literal
oracle SQL over the same input folder and counts rows in ``EXCEPT ALL`` both
ways, so multiplicities count.  Inputs may be single parquet files or folders
of parquet parts (as written by ``tools/skew_compare.py`` / ``scale_up.py``).

    python tools/compare_in_duckdb.py /tmp/run-xxxx q5_discovery_calls,q6_full_funnel
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from funnelkit import oracle  # noqa: E402
from funnelkit.plans import reports  # noqa: E402
from funnelkit.session import get_session  # noqa: E402
from funnelkit.sources import crm  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def main() -> None:
    data, names = sys.argv[1], sys.argv[2].split(",")
    spark = get_session(cores="8", shuffle_partitions=16, app="funnelkit-compare")
    views = crm.load(spark, data)
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{src}')")
    for name in names:
        out = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/spark_out"
        t0 = time.perf_counter()
        reports.REPORTS[name](views).write.parquet(out)
        t1 = time.perf_counter()
        con.execute(f"CREATE OR REPLACE TABLE o AS {oracle.QUERIES[name]}")
        t2 = time.perf_counter()
        con.execute(f"CREATE OR REPLACE TABLE s AS SELECT * FROM read_parquet('{out}/*.parquet')")
        cols = ", ".join(sorted(c[0] for c in con.execute("DESCRIBE o").fetchall()))
        n_s = con.execute("SELECT count(*) FROM s").fetchone()[0]
        n_o = con.execute("SELECT count(*) FROM o").fetchone()[0]
        diff = con.execute(
            f"SELECT (SELECT count(*) FROM (SELECT {cols} FROM s EXCEPT ALL SELECT {cols} FROM o))"
            f" + (SELECT count(*) FROM (SELECT {cols} FROM o EXCEPT ALL SELECT {cols} FROM s))").fetchone()[0]
        print(f"{name}: spark {n_s} rows ({t1 - t0:.1f} s), oracle {n_o} rows ({t2 - t1:.1f} s), "
              f"differing rows {diff}", flush=True)


if __name__ == "__main__":
    main()
