"""The factored funnel: value sets against brute force, plan size, the guard on opportunity ids, and the fixed lists."""

import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, SF001
from funnelkit import catalog
from funnelkit.functions import exprs as X
from funnelkit.operators.relational import heavy_keys, spread_join
from funnelkit.operators.value_sets import SegmentSets, VerticalSets
from funnelkit.sources import crm as crm_views

SEGMENTS = [None, "SMB", "Key", "Self-Service", "Enterprise", "N/A"]


def _first(*values):
    return next((v for v in values if v is not None), None)


def _bits(values):
    return sum(1 << SEGMENTS.index(v) for v in set(values))


def _names(bits):
    return {v for k, v in enumerate(SEGMENTS) if bits >> k & 1}


def test_segment_sets(spark):
    """COALESCE over sets, and contexts, against every combination of values."""
    rng, sets = random.Random(1), SegmentSets()
    rows = [[_bits(rng.sample(SEGMENTS, rng.randint(1, 4))) for _ in range(5)] for _ in range(200)]
    frame = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    got = frame.selectExpr(
        "*", f"{sets.then('a', 'b', 'c')} AS chain", f"{sets.labels('a')} AS labels",
        f"{sets.within('(' + sets.context('a', 'b') + ' | ' + sets.context('c', 'd') + ')', 'e')} AS open").collect()
    for r in got:
        a, b, c, d, e = (_names(r[k]) for k in range(5))
        assert _names(r.chain) == {_first(*v) for v in product(a, b, c)}
        assert _names(r.open) - {None} == ({_first(*v) for v in product(a, e, b)} | {_first(*v) for v in product(c, e, d)}) - {None}
        assert sorted(r.labels) == sorted({"SMB" if v == "Self-Service" else v for v in a} & {"SMB", "Key", "Enterprise"})
    own = spark.createDataFrame([(v,) for v in SEGMENTS], "segment string").selectExpr(f"{sets.own()} AS c").collect()
    assert [r.c for r in own] == [1 << k for k in range(6)]
    assert spark.sql(f"SELECT {sets.side('CAST(NULL AS INT)')} AS n, {sets.side('0')} AS e, {sets.side('6')} AS s").first() == (1, 1, 6)


def test_vertical_sets(spark):
    """Segment and vertical come from different sides; only verticals of kept segments are labels."""
    rng, sets = random.Random(2), VerticalSets()
    pair = "array<struct<s:int,v:string>>"
    rows = [[[(rng.randint(0, 2), rng.choice([None, "x", "y", "z"])) for _ in range(rng.randint(1, 3))] for _ in range(5)] for _ in range(150)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} {pair}" for c in "abcde"))

    def brute(*sides):
        return {(_first(*[s or None for s, _ in v]) or 0, _first(*[x for _, x in v])) for v in product(*sides)}

    context = f"concat({sets.context('a', 'b')}, {sets.context('c', 'd')})"
    for r in frame.selectExpr("*", f"{sets.then('a', 'b', 'c')} AS chain", f"{sets.within(context, 'e')} AS open", f"{sets.labels('a')} AS labels").collect():
        a, b, c, d, e = ([tuple(x) for x in r[k]] for k in range(5))
        assert {tuple(x) for x in r.chain} == brute(a, b, c) and len(r.chain) == len(brute(a, b, c))
        assert {tuple(x) for x in r.open} == brute(a, e, b) | brute(c, e, d)
        assert set(r.labels) == {v for s, v in a if s == 1} and len(r.labels) == len(set(r.labels))
    some = spark.sql(f"SELECT {sets.some(f'CAST(NULL AS {pair})')} AS n, {sets.some(sets.empty)} AS e, {sets.some(sets.none)} AS s").first()
    assert some == (False, False, True)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _counts(plan):
    lines = plan.splitlines()
    exchanges = [x for x in lines if re.search(r"Exchange (hash|range|Single|Round)", x) and "ReusedExchange" not in x]
    return len(exchanges), sum("FileScan" in x and "o_orderkey" in x for x in lines)


def test_funnel_plan_shares_its_shuffles(no_broadcast):
    """Where no side is small: few shuffles run, the rest is reused; opportunities are read for deals, roles and reach."""
    df = catalog.run(no_broadcast, SF001, "q6_full_funnel")
    df.collect()
    final, initial = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")
    ran, scans = _counts(final)
    assert 0 < ran <= 25 and scans <= 3 and "ReusedExchange" in final
    planned, scans = _counts(initial)
    assert ran < planned <= 102 and scans <= 6


@pytest.mark.parametrize("name", ["q2_accounts_touched", "q3_activity_volume", "q4_active_reps"])
def test_activity_reports_read_no_opportunities(no_broadcast, name):
    plan = catalog.run(no_broadcast, SF001, name)._jdf.queryExecution().executedPlan().toString()
    assert "orders" not in plan and "o_orderdate" not in plan


def test_activity_volume_has_no_calendar(spark):
    assert "Range" not in catalog.run(spark, SF001, "q3_activity_volume")._jdf.queryExecution().optimizedPlan().toString()


class Doubled:
    """CRM views whose opportunities come twice."""

    def __init__(self, views):
        self._views = views

    def __getattr__(self, name):
        return getattr(self._views, name)

    def pick(self, name, *columns):
        found = self._views.pick(name, *columns)
        return found.unionByName(found) if name == "opportunity_fact" else found


@pytest.mark.parametrize("name", ["q6_full_funnel", "q9_won_with_lead"])
def test_repeated_opportunity_ids_are_an_error(spark, name):
    from funnelkit.plans import reports
    with pytest.raises(Exception, match="opportunity id is not unique"):
        reports.REPORTS[name](Doubled(crm_views.load(spark, SF001))).collect()


def test_calls_with_repeated_opportunities(spark):
    """Doubled opportunities repeat no call row."""
    from funnelkit.plans import reports
    views = crm_views.load(spark, SF0001)
    assert sorted(map(str, reports.q5_discovery_calls(Doubled(views)).collect())) == sorted(map(str, reports.q5_discovery_calls(views).collect()))


def test_calendar_reach(spark):
    days = crm_views.load(spark, SF0001).calendar
    first, last, n = days.agg(F.min("date_key"), F.max("date_key"), F.count("*")).first()
    assert (str(first), str(last)) == ("1900-01-01", "2199-12-31") and n == (last - first).days + 1
    assert days.where("date_key = DATE '1998-07-01'").select("fiscal_year", "fiscal_quarter").first() == (1999, 1)


def test_fixed_lists():
    """The lists that the oracle shares with the code under test, written out."""
    assert X.WHAT_ID_LABELS == [("001", "ACCOUNT_ID"), ("006", "OPPORTUNITY_ID")]
    assert X.WHO_ID_LABELS == [("003", "CONTACT_ID"), ("00Q", "LEAD_ID")]
    assert (X.ACCOUNT_PREFIX, X.CONTACT_PREFIX, X.OPPORTUNITY_PREFIX, X.LEAD_PREFIX) == ("001", "003", "006", "00Q")
    assert dict(X.REVENUE_BANDS) == {
        "$1M-2M": 2_000_000, "$2M-5M": 3_000_000, "$5M-10M": 7_500_000, "$5M-20M": 10_000_000, "$10M-25M": 15_000_000, "$20M-75M": 50_000_000,
        "$25M-100M": 75_000_000, ">$75M": 100_000_000, ">$100M": 105_000_000, None: None}
    assert {source: label for sources, label in X.SOURCE_CONDENSED for source in sources} == {
        "Paid Search": "Paid Search", "Paid Blended": "Paid Search", "Direct traffic": "Organic", "Organic Search": "Organic",
        "Google Natural Search": "Organic", "Display": "Display", "skift_b2b": "Display", "sharma_b2b": "Display", "Email": "Email", "house_email": "Email",
        "Field Event": "Field Event", "Paid Social": "Paid Social", "linkedin_b2b": "Paid Social", "Partner": "Partner", "LinkedIn": "Organic Social",
        "Facebook": "Organic Social", "Webinar": "Webinar", "osa_outreach": "Manually sourced", "ZoomInfo": "ZoomInfo", "Shopify": "Shopify"}
    assert X.DISCOVERY_SUBJECTS == ["%Discovery call%", "%Conference Meeting%", "%In-Person Meeting%"]
    assert sorted(X.OUTBOUND_TYPES) == ["Linkedin", "Outbound Call", "Outbound Email"]
    assert sorted(X.FREE_MAIL_PATTERNS) == ["%aol%", "%gmail%", "%yahoo%"] and sorted(X.FREE_MAIL_EXACT) == ["aol", "gmail", "yahoo"]
    assert sorted(X.WON_STAGES) == ["Closed Won", "Closed Won (Signed)"] and X.LOST_STAGES == ["Closed Lost"]
    assert X.PRE_OPPORTUNITY_STAGES == ["Pre Opportunity"]
    assert sorted(X.OPEN_STAGES) == ["Discovery", "Negotiation", "Pre Opportunity", "Product Decision", "Proposal", "Verbal Commit"]
    assert sorted(X.FUNNEL_SEGMENTS) == ["Enterprise", "Key", "SMB", "Self-Service"]
    manager, head, lead_bda = ("like", "%Sales Manager%"), ("eq", "Head of Sales"), ("eq", "BDA Manager")
    bda, executive, executives = ("eq", "BDA"), ("eq", "Account Executive"), ("ilike", "%account executive%")
    assert sorted(X.ACTIVITY_ROLES) == sorted([bda, executive, manager, head, lead_bda])
    assert sorted(X.DISCOVERY_OWNER_ROLES) == sorted([bda, executives, manager, head, lead_bda])
    assert sorted(X.DISCOVERY_OWNER_ROLES_NARROW) == sorted([bda, executives])
    assert sorted(X.CALL_CURRENT_ROLES) == sorted([bda, executives, manager, executive, ("eq", "Sales Manager"), head, lead_bda])
    assert sorted(X.CALL_PREVIOUS_ROLES) == sorted([executive, ("like", "%Sales Manager"), ("eq", "Sales Manager"), head, lead_bda])


def test_spread_join(spark):
    """Heavy keys on either or both sides, against the plain join; parts of heavy keys meet in several places."""
    rng = random.Random(4)
    left = [(k, rng.choice(["hot"] * 5 + ["left", "both", None, "c1", "c2", "none"])) for k in range(400)]
    right = [(k, rng.choice(["hot"] * 4 + ["right", "both", None, "c1", "c3"])) for k in range(300)] + [(900, "lone")]
    l = spark.createDataFrame(left + [(1000, "right"), (1000, "right")], "a long, k string")
    r = spark.createDataFrame(right, "b long, j string")
    for least in (1, 10, 100_000):
        heavy = heavy_keys({"x": (l, "k", r, "j"), "y": (r, "j", l, "k")}, least)
        got = spread_join(l, r, "k", "j", ["a"], ["b"], heavy, "x")
        assert got.columns == ["a", "k", "b", "j"]
        assert sorted(map(str, got.collect())) == sorted(map(str, l.join(r, F.expr("k = j"), "left").collect()))
    parts = {x.heavy_key: (x.left_parts, x.right_parts) for x in heavy_keys({"x": (l, "k", r, "j")}, 10).collect()}
    assert min(parts["x:hot"]) > 1 and all(max(p) <= 64 for p in parts.values())
    assert heavy_keys({"x": (l, "k", r, "j")}, 1).count() <= 128
