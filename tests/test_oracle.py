"""Every registered query equals its DuckDB oracle; the restructured plans equal the literal SQL."""

import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle_check as oc
from conftest import SF0001, SF001
from funnelkit import catalog, oracle
from funnelkit.params import ReportParams
from funnelkit.plans import reports
from funnelkit.sources import crm as crm_views


def _same(spark_df, con, sql):
    a = oc.fingerprint(spark_df.toPandas())
    b = oc.fingerprint(con.execute(sql).df())
    assert a[1] == b[1], (a[1], b[1])
    assert a[0] == b[0]
    assert a[2] == b[2]
    return a[0]


@pytest.mark.parametrize("view", crm_views.ALL_VIEWS)
def test_crm_view_matches_duckdb(spark, crm0001, view):
    con = oc.duck(SF0001)
    _same(getattr(crm0001, view), con, f"WITH {crm_views.oracle_ctes([view])} SELECT * FROM crm_{view}")


@pytest.mark.parametrize("name", sorted(catalog.names()))
def test_registered_query_matches_oracle(spark, name):
    con = oc.duck(SF0001)
    _same(catalog.run(spark, SF0001, name), con, catalog.oracle()[name])


def _copy(spark, change: dict) -> str:
    """The smallest tables in a new folder, some of them changed."""
    out = tempfile.mkdtemp(prefix="funnelkit-copy-", dir="/tmp")
    for t in oc.TABLES[:8]:
        df = spark.read.parquet(f"{SF0001}/{t}.parquet")
        change.get(t, lambda x: x)(df).coalesce(1).write.parquet(f"{out}/{t}.parquet")
    return out


def _duck(path: str):
    con = duckdb.connect()
    for t in oc.TABLES[:8]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    return con


def test_calls_with_repeated_people_and_accounts(spark, crm0001):
    """Doubled user, account and contact rows repeat no call row."""
    path = _copy(spark, {t: lambda x: x.unionByName(x) for t in ("supplier", "customer")})
    n = _same(reports.q5_discovery_calls(crm_views.load(spark, path)), _duck(path), oracle.QUERIES["q5_discovery_calls"])
    assert n == reports.q5_discovery_calls(crm0001).count()


def test_reports_outside_the_nineties(spark, crm0001):
    """Dates moved by 24 years give the same counts under labels moved by 24 years."""
    later = {"orders": lambda x: x.withColumn("o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 24 YEARS")).cast(x.schema["o_orderdate"].dataType))}
    moved = crm_views.load(spark, _copy(spark, later))
    p, q = ReportParams(), ReportParams("2021-07-01", "2022-10-01", "2020-07-01")
    for report in (reports.q10_opps_created, reports.q1_rep_count_by_quarter):
        was = [tuple(r) for r in report(crm0001, p).collect()]
        now = [tuple(r) for r in report(moved, q).collect()]
        assert now == [tuple(f"{int(v[:4]) + 24}{v[4:]}" if isinstance(v, str) and v[:2] == "19" else v for v in r) for r in was]
        assert len({r[1] for r in now} | {r[0] for r in now}) > 4


WINDOWS = [
    ReportParams("1995-01-01", "2002-01-01", "1994-01-01"),
    ReportParams("1996-03-15", "1997-02-01", "1995-03-15"),
    ReportParams("1998-01-01", "2000-06-30", "1997-01-01"),
]


@pytest.mark.parametrize("p", WINDOWS, ids=lambda p: f"{p.start}_{p.end}")
@pytest.mark.parametrize("name", ["q5_discovery_calls", "q6_full_funnel", "q7_lead_validation",
                                  "q8_inbound_leads", "q9_won_with_lead"])
def test_restructured_plans_equal_literal_sql(spark, crm001, name, p):
    """Factored funnel, per-contact activity pick and binned interval join vs the literal chain."""
    con = oc.duck(SF001)
    n = _same(reports.REPORTS[name](crm001, p), con, oracle.build(p)[name])
    assert n > 0
