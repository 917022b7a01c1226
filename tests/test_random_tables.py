"""Every query vs its oracle on randomly generated driver-shaped tables.

The generated tables concentrate a third of orders on one customer and a third of
events on one user (hot account / hot contact), hit the 5M and 100M band edges,
and spread dates over the whole fiscal range, so the factored funnel meets
NULL-segment opportunities with mixed-segment sides that the fixed test data
rarely produces.
"""

import datetime as dt
import os
import tempfile

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import oracle_check as oc
from funnelkit import catalog, oracle
from funnelkit.params import ReportParams
from funnelkit.plans import reports
from funnelkit.sources import crm as crm_views


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _skewed(rng, n, size, hot=0):
    out = rng.integers(0, n, size)
    out[rng.random(size) < 1 / 3] = hot
    return out


def _days(rng, size, start=dt.datetime(1995, 1, 1), span=2400):
    return np.array([start + dt.timedelta(days=int(d)) for d in rng.integers(0, span, size)], dtype="datetime64[us]")


def make_tables(seed: int, path: str) -> None:
    rng = np.random.default_rng(seed)
    n_cust, n_part, n_ord, n_ev = 60, 80, 500, 800
    tabs = {}
    tabs["region"] = pd.DataFrame({"r_regionkey": np.arange(5, dtype="int32"),
                                   "r_name": [f"R{i}" for i in range(5)]})
    tabs["nation"] = pd.DataFrame({"n_nationkey": np.arange(25, dtype="int32"),
                                   "n_name": [f"NATION_{i}" for i in range(25)],
                                   "n_regionkey": (np.arange(25) % 5).astype("int32")})
    bal = rng.uniform(-1000, 10000, n_cust).round(2)
    bal[:4] = [5000.0, 250.0, 4999.99, 5000.01]   # amount exactly 1e8, exactly 5e6, around 1e8
    tabs["customer"] = pd.DataFrame({
        "c_custkey": np.arange(n_cust, dtype="int64"), "c_name": [f"C{i}" for i in range(n_cust)],
        "c_nationkey": rng.integers(0, 25, n_cust).astype("int32"), "c_acctbal": bal,
        "c_mktsegment": rng.choice(["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE"], n_cust)})
    tabs["supplier"] = pd.DataFrame({"s_suppkey": np.arange(10, dtype="int64"),
                                     "s_name": [f"S{i}" for i in range(10)],
                                     "s_nationkey": rng.integers(0, 25, 10).astype("int32"),
                                     "s_acctbal": rng.uniform(0, 1000, 10)})
    tabs["part"] = pd.DataFrame({
        "p_partkey": np.arange(n_part, dtype="int64"), "p_name": [f"P{i}" for i in range(n_part)],
        "p_brand": [f"Brand#{i}" for i in rng.integers(1, 26, n_part)], "p_type": ["T"] * n_part,
        "p_size": rng.integers(1, 51, n_part).astype("int32"), "p_retailprice": rng.uniform(1, 100, n_part)})
    tabs["orders"] = pd.DataFrame({
        "o_orderkey": np.arange(n_ord, dtype="int64"), "o_custkey": _skewed(rng, n_cust, n_ord, hot=7).astype("int64"),
        "o_orderstatus": rng.choice(["F", "O", "P"], n_ord), "o_totalprice": rng.uniform(500, 500000, n_ord).round(2),
        "o_orderdate": _days(rng, n_ord),
        "o_orderpriority": rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], n_ord)})
    n_li = 900
    tabs["lineitem"] = pd.DataFrame({
        "l_orderkey": rng.integers(0, n_ord, n_li).astype("int64"), "l_partkey": rng.integers(0, n_part, n_li).astype("int64"),
        "l_suppkey": rng.integers(0, 10, n_li).astype("int64"), "l_linenumber": rng.integers(1, 8, n_li).astype("int32"),
        "l_quantity": rng.uniform(1, 50, n_li), "l_extendedprice": rng.uniform(100, 100000, n_li),
        "l_discount": rng.uniform(0, 0.1, n_li), "l_tax": rng.uniform(0, 0.08, n_li),
        "l_returnflag": rng.choice(["A", "N", "R"], n_li), "l_linestatus": rng.choice(["O", "F"], n_li),
        "l_shipdate": _days(rng, n_li)})
    tabs["events"] = pd.DataFrame({
        "event_id": np.arange(n_ev, dtype="int64"),
        "ts": np.array([dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 2_500_000, n_ev)],
                       dtype="datetime64[us]"),
        "user_id": _skewed(rng, n_cust, n_ev, hot=7).astype("int64"),
        "event_type": rng.choice(["view", "click", "signup", "purchase", "error"], n_ev),
        "value": rng.uniform(0, 10, n_ev), "props": ["{}"] * n_ev})
    for name, df in tabs.items():
        pq.write_table(pa.Table.from_pandas(df, preserve_index=False), os.path.join(path, f"{name}.parquet"))


@pytest.fixture(scope="module", params=[11, 23])
def random_dir(request):
    path = tempfile.mkdtemp(prefix=f"funnelkit-rand{request.param}-", dir="/tmp")
    make_tables(request.param, path)
    return path


def _duck(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def _check(spark_df, con, sql):
    a = oc.fingerprint(spark_df.toPandas())
    b = oc.fingerprint(con.execute(sql).df())
    assert a == b, (a[:2], b[:2])
    return a[0]


def test_all_queries_on_random_tables(spark, random_dir):
    con = _duck(random_dir)
    for name in sorted(catalog.names()):
        _check(catalog.run(spark, random_dir, name), con, catalog.oracle()[name])


@pytest.mark.parametrize("p", [ReportParams("1995-01-01", "2002-01-01", "1994-01-01"),
                               ReportParams("1996-07-01", "1998-01-01", "1995-07-01")],
                         ids=["wide", "narrow"])
def test_funnel_and_calls_on_random_tables(spark, random_dir, p):
    con = _duck(random_dir)
    views = crm_views.load(spark, random_dir)
    built = oracle.build(p)
    for name in ["q5_discovery_calls", "q6_full_funnel", "q7_lead_validation", "q8_inbound_leads",
                 "q9_won_with_lead", "q10_opps_created", "q11_win_rate", "q1_rep_count_by_quarter"]:
        _check(reports.REPORTS[name](views, p), con, built[name])
