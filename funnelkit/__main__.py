"""Run one registered report from the command line.

    python -m funnelkit q6_full_funnel --data /root/testdata/sf0.1 \
        --start 1997-07-01 --end 1998-10-01 --out /shared/reports/q6 [--format parquet|csv]

Without ``--out`` the result is shown (first rows only).  Report keys: ``--list``.
"""

from __future__ import annotations

import argparse

from funnelkit import catalog
from funnelkit.params import DEFAULT, ReportParams
from funnelkit.plans import reports
from funnelkit.session import get_session
from funnelkit.sources import crm


def main() -> None:
    ap = argparse.ArgumentParser(prog="funnelkit")
    ap.add_argument("query", nargs="?")
    ap.add_argument("--data", default="/root/testdata/sf0.1", help="folder with the driver-shaped parquet tables")
    ap.add_argument("--start", default=DEFAULT.start)
    ap.add_argument("--end", default=DEFAULT.end)
    ap.add_argument("--history-start", default=DEFAULT.history_start)
    ap.add_argument("--out")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    ap.add_argument("--list", action="store_true")
    args = ap.parse_args()
    if args.list or not args.query:
        print("\n".join(catalog.names()))
        return
    spark = get_session(app=f"funnelkit-{args.query}")
    if args.query in reports.REPORTS:
        df = reports.REPORTS[args.query](crm.load(spark, args.data),
                                         ReportParams(args.start, args.end, args.history_start))
    else:
        df = catalog.run(spark, args.data, args.query)
    if args.out:
        df.write.mode("overwrite").format(args.format).option("header", "true").save(args.out)
    else:
        df.show(20, truncate=False)


if __name__ == "__main__":
    main()
