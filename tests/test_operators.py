"""Edge cases of the building blocks on tiny hand-made inputs."""

import datetime as dt

from pyspark.sql import functions as F

from funnelkit.functions import exprs as X
from funnelkit.operators.relational import first_per_key, full_outer_join, interval_join
from funnelkit.plans.funnel import coal, seg_code


def _col(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_revenue_band_null_unknown_and_edges(spark):
    out = _col(spark, [("$5M-20M",), (">$75M",), (None,), ("Unknown",), (">$100M",)], "b string",
               X.revenue_band_value(F.col("b")))
    assert out == [10000000, 100000000, None, 0, 105000000]


def test_segment_bands_gap_at_100m_and_null(spark):
    vals = [(4999999.0,), (5000000.0,), (99999999.0,), (100000000.0,), (100000001.0,), (None,)]
    assert _col(spark, vals, "t double", X.segment_by_tas(F.col("t"))) == ["MSS", "SMB", "SMB", "OTHER", "ENT", "OTHER"]
    assert _col(spark, [(1e9,), (1e8,), (5e6,), (4e6,)], "t double", X.segment_by_amount(F.col("t"))) == \
        ["Key", "Enterprise", "SMB", None]


def test_free_mail_three_variants(spark):
    emails = [("a@corp.example",), ("a@gmail.com",), ("gmail.yahoo.aol@x",), (None,), ("gmail",)]
    schema = "e string"
    # OR of negations keeps everything unless all three patterns match
    assert _col(spark, emails, schema, X.free_mail_ok(F.col("e"), "or")) == [True, True, False, None, True]
    # AND drops any match
    assert _col(spark, emails, schema, X.free_mail_ok(F.col("e"), "and")) == [True, False, False, None, False]
    # no wildcards: whole-string comparison, true unless the address is one of the bare words
    assert _col(spark, emails, schema, X.free_mail_ok(F.col("e"), "exact")) == [True, True, True, None, True]


def test_subject_filter_drops_only_both_markers(spark):
    subj = [("plain",), ("<<left",), ("right>>",), ("<<both>>",), (None,)]
    s = F.col("s")
    keep = s.isNull() | ~s.ilike("%<<%") | ~s.ilike("%>>%")
    assert _col(spark, subj, "s string", keep) == [True, True, True, False, True]


def test_role_at_time_inclusive_vs_strict(spark):
    end = dt.date(1998, 1, 1)
    rows = [("Support", "BDA", end, dt.date(1997, 12, 31)),
            ("Support", "BDA", end, dt.date(1998, 1, 1)),
            ("Support", "BDA", end, dt.date(1998, 1, 2)),
            ("Support", "BDA", None, dt.date(1997, 1, 1)),
            ("Regional Sales Manager", None, None, dt.date(1997, 1, 1))]
    schema = "r string, p string, e date, d date"
    args = (F.col("r"), F.col("p"), F.col("e"), F.col("d"), X.ACTIVITY_ROLES)
    incl = _col(spark, rows, schema, X.role_at_time(*args, inclusive=True))
    strict = _col(spark, rows, schema, X.role_at_time(*args, inclusive=False))
    # after the end date every OR term is FALSE; a NULL end date leaves that term NULL
    assert incl == [True, True, False, None, True]
    assert strict == [True, False, False, None, True]


def test_id_prefix_split_falls_through(spark):
    rows = [("001A",), ("006B",), ("701C",), (None,)]
    assert _col(spark, rows, "w string", X.id_type(F.col("w"), X.WHAT_ID_LABELS)) == \
        ["ACCOUNT_ID", "OPPORTUNITY_ID", "701C", None]
    assert _col(spark, rows, "w string", X.id_if_prefix(F.col("w"), "006")) == [None, "006B", None, None]


def test_first_per_key_null_key_is_own_group(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 3), ("b", None)], "k string, o int")
    out = sorted(first_per_key(df, ["k"], [F.col("o").asc_nulls_last()]).collect(), key=str)
    assert sorted(map(tuple, out), key=str) == sorted([("a", 1), (None, 3), ("b", None)], key=str)


def test_interval_join_bounds_and_unmatched(spark):
    ts = dt.datetime
    calls = spark.createDataFrame([
        ("c1", "A", ts(1997, 8, 31, 10, 0)),   # month-end: +6 months clamps to Feb 28
        ("c2", "A", ts(1997, 1, 15, 0, 0)),
        ("c3", "B", ts(1997, 1, 15, 0, 0)),    # no opportunity on B
    ], "call string, acct string, t timestamp_ntz")
    opps = spark.createDataFrame([
        ("o_same", "A", ts(1997, 8, 31, 10, 0)),     # equal time: excluded (strict >)
        ("o_1s", "A", ts(1997, 8, 31, 10, 0, 1)),    # +1 s: included
        ("o_end", "A", ts(1998, 2, 28, 10, 0)),      # exactly +6 months (clamped): excluded
        ("o_in", "A", ts(1998, 2, 28, 9, 59)),       # just inside
        ("o_c2", "A", ts(1997, 7, 14, 23, 59)),      # inside c2's window
    ], "opp string, oacct string, ot timestamp_ntz")
    out = interval_join(calls, opps, left_key="acct", right_key="oacct", left_ts="t", right_ts="ot",
                        months=6, left_id="call")
    got = sorted((r["call"], r["opp"]) for r in out.collect())
    # c2's window ends 1997-07-15; c3 has no match and is kept once
    assert got == sorted([("c1", "o_1s"), ("c1", "o_in"), ("c2", "o_c2"), ("c3", None)])
    assert out.columns == calls.columns + opps.columns


def test_interval_join_repeated_left_ids_and_null_keys(spark):
    ts = dt.datetime
    calls = spark.createDataFrame([("c1", "A", ts(1997, 1, 1)), ("c1", "A", ts(1997, 1, 1)), ("c1", "B", ts(1997, 1, 1)),
                                   ("c2", None, ts(1997, 1, 1)), ("c3", "A", None), (None, "A", ts(1999, 1, 1))],
                                  "call string, acct string, t timestamp_ntz")
    opps = spark.createDataFrame([("o1", "A", ts(1997, 2, 1)), ("o2", "A", ts(1997, 3, 1)), ("o3", None, ts(1997, 2, 1))],
                                 "opp string, oacct string, ot timestamp_ntz")
    out = interval_join(calls, opps, left_key="acct", right_key="oacct", left_ts="t", right_ts="ot", months=6, left_id="call")
    got = sorted((str(r["call"]), str(r["acct"]), str(r["opp"])) for r in out.collect())
    assert got == sorted([("c1", "A", "o1"), ("c1", "A", "o2")] * 2 + [
        ("c1", "B", "None"), ("c2", "None", "None"), ("c3", "A", "None"), ("None", "A", "None")])


def test_full_outer_join_keeps_null_keys_apart(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), (None, 4)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("c", 20), (None, 30)], "j string, y int")
    joined = full_outer_join(left, right, "k", "j")
    assert sorted(map(str, map(tuple, joined.collect()))) == sorted(map(str, [
        ("a", 1, "a", 10), ("b", 2, None, None), (None, None, "c", 20), (None, 3, None, None), (None, 4, None, None), (None, None, None, 30)]))


def test_coalesce_segment_sets(spark):
    # NULL=1 SMB=2 Key=4 Self-Service=8 Enterprise=16 other=32
    df = spark.createDataFrame([(1, 1, 4), (3, 8, 1), (2, 1, 1), (1, 1, 1)], "a int, b int, c int")
    got = [r[0] for r in df.select(coal(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [4, 2 | 8, 2, 1]
    codes = _col(spark, [("SMB",), ("N/A",), (None,), ("Enterprise",)], "s string", seg_code("s"))
    assert codes == [2, 32, 1, 16]


def test_distinct_count_long_keeps_all_null_groups_and_null_key(spark):
    from funnelkit.operators.relational import distinct_count_long
    df = spark.createDataFrame([("g1", None, None), ("g2", "a", "x"), ("g2", "a", "y"), ("g2", "b", None),
                                (None, "c", "z"), (None, "c", "z")], "g string, m1 string, m2 string")
    out = {r["g"]: (r["n1"], r["n2"]) for r in
           distinct_count_long(df, "g", {"n1": F.col("m1"), "n2": F.col("m2")}).collect()}
    assert out == {"g1": (0, 0), "g2": (2, 2), None: (1, 1)}


def test_win_rate_no_closed_quarter_and_closed_upper_bound(spark):
    from funnelkit.plans.opportunities import win_rate
    from funnelkit.sources.crm import GivenViews
    schema = ("opportunity_id string, stage string, opportunity_amount double, close_date timestamp_ntz, "
              "created_date timestamp_ntz, opportunity_owner string, opportunity_owner_role string, "
              "opportunity_owner_segment string, self_service_flag boolean, est_gmv double, "
              "total_sales_cycle_days int, account_id string, vertical string, fiscal_quarter_name_close_date string, "
              "fiscal_year_close_date int, fiscal_quarter_name_create_date string, fiscal_year_create_date int, "
              "opportunity_sales_flag boolean")
    ts = dt.datetime

    def opp(i, stage, created, q, gmv=10.0, days=5):
        return (f"006{i}", stage, 1.0, created, created, "o", "Account Executive", "SMB", False, gmv, days,
                "001", "v", q, 1998, q, 1998, True)

    rows = [opp(1, "Negotiation", ts(1997, 8, 1), "Q1"),                 # quarter with no closed deal
            opp(2, "Closed Won", ts(1997, 11, 1), "Q2", 30.0, 10),
            opp(3, "Closed Lost", ts(1997, 11, 2), "Q2", 10.0, 20),
            opp(4, "Closed Won", ts(1998, 10, 1), "Q3"),                  # exactly the closed upper bound: kept
            opp(5, "Closed Won", ts(1998, 10, 1, 0, 0, 1), "Q4")]         # one second later: dropped
    crm = GivenViews({"opportunity_fact": spark.createDataFrame(rows, schema)})
    out = {r["fq_create"]: r for r in win_rate(crm, "1997-07-01", "1998-10-01").collect()}
    assert set(out) == {"Q1-1998", "Q2-1998", "Q3-1998"}
    assert out["Q1-1998"]["win_rate"] is None and out["Q1-1998"]["open"] == 1
    assert out["Q2-1998"]["win_rate"] == 0.5 and out["Q2-1998"]["win_rate_est_gmv"] == 0.75
    assert out["Q2-1998"]["avg_cycle_closed_won"] == 10.0 and out["Q2-1998"]["avg_cycle_closed_lost"] == 20.0
    assert out["Q3-1998"]["won"] == 1


def test_win_rate_keeps_decimal_money(spark):
    from decimal import Decimal
    from pyspark.sql import types as T

    from funnelkit.plans.opportunities import win_rate
    from funnelkit.sources.crm import GivenViews
    schema = ("opportunity_id string, stage string, opportunity_amount decimal(38,2), close_date timestamp_ntz, "
              "created_date timestamp_ntz, opportunity_owner string, opportunity_owner_role string, "
              "opportunity_owner_segment string, self_service_flag boolean, est_gmv decimal(38,2), "
              "total_sales_cycle_days int, account_id string, vertical string, fiscal_quarter_name_close_date string, "
              "fiscal_year_close_date int, fiscal_quarter_name_create_date string, fiscal_year_create_date int, "
              "opportunity_sales_flag boolean")
    t = dt.datetime(1997, 11, 1)
    rows = [("a", "Closed Won", Decimal("1.00"), t, t, "o", "AE", "SMB", False, Decimal("10.25"), 3, "x", "v",
             "Q2", 1998, "Q2", 1998, True),
            ("b", "Closed Lost", Decimal("1.00"), t, t, "o", "AE", "SMB", False, Decimal("30.75"), 3, "x", "v",
             "Q2", 1998, "Q2", 1998, True)]
    out = win_rate(GivenViews({"opportunity_fact": spark.createDataFrame(rows, schema)}), "1997-07-01", "1998-10-01")
    assert isinstance(out.schema["won_est_gmv"].dataType, T.DecimalType)
    r = out.collect()[0]
    assert r["won_est_gmv"] == Decimal("10.25") and r["lost_est_gmv"] == Decimal("30.75") and r["win_rate"] == 0.5
