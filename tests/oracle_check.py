"""Run registered Spark queries and their DuckDB oracle on the same parquet files and compare.

Compares row count, column names and an order-insensitive hash of the exact
values (floats by their round-trip representation; both sides round floating
aggregates to the same scale in SQL), the way the driver's correctness gate does.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "∅"
    if isinstance(v, (float, int)) and not isinstance(v, bool):
        # exact: integral values print as integers (pandas turns nullable bigint into
        # float), everything else by its shortest round-trip representation
        f = float(v)
        if math.isnan(f):
            return "∅"
        return str(int(v)) if f.is_integer() else repr(f)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v)


def fingerprint(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        sp = qs[name](spark, sf_dir).toPandas()
        t1 = time.time()
        if name not in sql:
            out[name] = {"rows": len(sp), "oracle": None}
            continue
        dd = con.execute(sql[name]).df()
        t2 = time.time()
        a, b = fingerprint(sp), fingerprint(dd)
        ok = a == b
        out[name] = {"ok": ok, "spark_rows": a[0], "oracle_rows": b[0], "spark_s": round(t1 - t0, 2),
                     "oracle_s": round(t2 - t1, 2)}
        if not ok:
            out[name]["cols"] = (a[1], b[1]) if a[1] != b[1] else "same"
        if verbose:
            print(name, out[name], flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from funnelkit.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    compare(get_session(), sf, names)
