"""Physical-plan properties and data invariants the scale design relies on."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from funnelkit import catalog
from funnelkit.params import DEFAULT
from funnelkit.plans import reports
from funnelkit.plans.activities import activity_union
from funnelkit.plans.opportunities import win_rate

import __spark_entry__ as E


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(catalog.names()))
def test_no_cartesian_without_broadcast(no_broadcast, name):
    plan = _plan(catalog.run(no_broadcast, SF001, name))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan, (name, bad)


@pytest.mark.parametrize("name", ["q1_rep_count_by_quarter", "date_windows", "fiscal_label", "interval_join", "dedup_composite_null"])
def test_no_lookup_that_no_column_reads(no_broadcast, name):
    """The fact view joins customers only for columns that come from them."""
    scans = [ln for ln in _plan(catalog.run(no_broadcast, SF001, name)).splitlines() if "FileScan parquet" in ln]
    assert not any("customer" in ln.split("Location")[-1] for ln in scans), name


def test_opportunity_sides_read_no_customer(crm001):
    from funnelkit.plans.opportunities import sales_opps
    plan = _plan(sales_opps(crm001, "opportunity_id", "account_id", "est_gmv", "created_date", "stage"))
    assert "customer" not in plan and "Join" not in plan
    assert "customer" in _plan(sales_opps(crm001, "account_segment"))


@pytest.mark.parametrize("name", ["q6_full_funnel", "q9_won_with_lead"])
def test_building_a_report_starts_no_job(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build-{name}", "building only")
    try:
        df = catalog.run(spark, SF001, name)
        assert not tracker.getJobIdsForGroup(f"build-{name}") or _only_schema_jobs(tracker, name)
        df.collect()
        assert tracker.getJobIdsForGroup(f"build-{name}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def _only_schema_jobs(tracker, name) -> bool:
    """Parquet schema inference runs one single-task job a table; nothing else may run."""
    stages = [s for j in tracker.getJobIdsForGroup(f"build-{name}") for s in tracker.getJobInfo(j).stageIds]
    return all((info := tracker.getStageInfo(s)) is None or info.numTasks <= 1 for s in stages)


def test_contact_views_scan_their_table_once(crm001):
    for view in (crm001.contact, crm001.opportunity_contact_role):
        assert _plan(view).count("FileScan") == 1


def test_lead_source_map_is_broadcast(crm001):
    plan = _plan(reports.q8_inbound_leads(crm001))
    assert not any("SortMergeJoin" in ln and "c_leadsource" in ln for ln in plan.splitlines())


def _in_order(rows, keys):
    """Ascending by the keys, nulls last."""
    marks = [[(r[k] is None, r[k]) for k in keys] for r in rows]
    return all([(a[0], a[1] or "") if not a[0] else (True, "") for a in x] <= [(a[0], a[1] or "") if not a[0] else (True, "") for a in y]
               for x, y in zip(marks, marks[1:]))


@pytest.mark.parametrize("name, keys", [
    ("q1_rep_count_by_quarter", ["fq", "r_segment"]), ("q4_active_reps", ["owner_name", "fiscal_year", "fiscal_quarter"]),
    ("q10_opps_created", ["fq", "opp_account_segment"]), ("q11_win_rate", ["fq_create"])])
def test_report_order(crm001, name, keys):
    rows = [{k: None if r[k] is None else str(r[k]) for k in keys} for r in reports.REPORTS[name](crm001).collect()]
    assert len(rows) > 1 and _in_order(rows, keys)


def test_validation_order_largest_first(crm001):
    gmv = [r.est_gmv for r in reports.q7_lead_validation(crm001).collect()]
    known = [g for g in gmv if g is not None]
    assert gmv[: len(gmv) - len(known)] == [None] * (len(gmv) - len(known)) and known == sorted(known, reverse=True)


@pytest.mark.parametrize("name", sorted(catalog.names()))
def test_no_python_no_nested_loop_no_cartesian(spark, name):
    plan = _plan(catalog.run(spark, SF001, name))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
                "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan, (name, bad)


def test_filters_and_columns_reach_the_scan(spark, crm001):
    plan = _plan(reports.q11_win_rate(crm001))
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "orders" in ln]
    assert scan, plan
    assert all("PushedFilters: [" in ln and "PushedFilters: []" not in ln for ln in scan)


def test_row_number_first_is_group_limited(spark, crm001):
    assert "WindowGroupLimit" in _plan(reports.q7_lead_validation(crm001))


def test_union_keeps_every_activity(crm001):
    n = activity_union(crm001).count()
    assert n == crm001.task.count() + crm001.event.count()


@pytest.mark.parametrize("view,key", [("account", "id"), ("contact", "id"), ("user", "id"),
                                      ("userrole", "id"), ("opportunity_fact", "opportunity_id"),
                                      ("lead", "id"), ("task", "id"), ("event", "id")])
def test_crm_keys_are_unique(crm001, view, key):
    df = getattr(crm001, view)
    assert df.count() == df.select(key).distinct().count()


def test_call_rows_one_per_call_and_opportunity(crm001):
    q5 = reports.q5_discovery_calls(crm001)
    assert q5.count() == q5.select("discovery_ids", "disco_created_opp_id").distinct().count()


def test_validation_rows_unique(crm001):
    q7 = reports.q7_lead_validation(crm001)
    assert q7.count() == q7.select("opportunity_id", "eligible_lead_ids").distinct().count()


def test_funnel_stage_subsets(crm001):
    rows = reports.q6_full_funnel(crm001).collect()
    assert rows
    for r in rows:
        for m in ("all_won_opps", "all_lost_opps", "all_open_opps", "all_launched_opps",
                  "all_bda_support_op", "all_captured_opps"):
            assert r[m] <= r["all_created_opps"]
        assert r["all_contacts_with_disco"] <= r["all_discos"]
        assert r["outbound_discos"] == r["all_discos"] - r["all_leads_to_disco_call"]


def test_entry_runs_on_smallest_scale(spark):
    df = E.entry(spark)
    assert df.columns[0] == "account_based_segment"
    assert {r.account_based_segment for r in df.collect()} == {"SMB", "Key", "Enterprise"}


def test_entry_has_every_catalog_name():
    assert set(catalog.names()) <= set(E.queries())
    assert set(catalog.oracle()) == set(catalog.names())


def test_from_tables_accepts_the_views_and_checks_columns(crm001):
    from funnelkit.sources import crm
    tables = {n: getattr(crm001, n) for n in crm.REQUIRED_COLUMNS}
    views = crm.from_tables(tables)
    assert reports.q11_win_rate(views).count() == reports.q11_win_rate(crm001).count()
    bad = dict(tables, lead=tables["lead"].drop("email"))
    with pytest.raises(ValueError):
        crm.from_tables(bad)
    with pytest.raises(ValueError, match="wrong type"):
        crm.from_tables(dict(tables, lead=tables["lead"].withColumn("createddate", F.col("createddate").cast("string"))))
    extra = dict(tables, opportunity_fact=tables["opportunity_fact"].withColumn("region", F.lit("north")))
    assert {r.region for r in win_rate(crm.from_tables(extra), DEFAULT.start, DEFAULT.end, ("region",)).collect()} == {"north"}


def test_day_without_calendar_entry_fails(crm001):
    from funnelkit.sources import crm
    tables = {n: getattr(crm001, n) for n in crm.REQUIRED_COLUMNS}
    short = crm.from_tables(dict(tables, calendar=tables["calendar"].where("date_key < DATE '1998-01-01'")))
    with pytest.raises(Exception, match="no calendar entry for 1998"):
        reports.q10_opps_created(short).collect()


def test_interval_join_is_one_pass_keyed_by_account_and_bucket(no_broadcast, crm001):
    """Calls stay one row each, opportunities go to two buckets, and nothing looks at the pairs again."""
    plan = _plan(reports.q5_discovery_calls(crm001)).split("== Initial Plan ==")[-1]
    joins = [ln for ln in plan.splitlines() if "SortMergeJoin" in ln and "_bucket" in ln]
    assert len(joins) == 1 and "v_account_id" in joins[0] and "a_id" in joins[0]
    above = plan[: plan.index(joins[0])]
    assert "Exchange" not in above and "Window" not in above
    assert plan.count("Generate explode(array(") == 1
    assert "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["q6_full_funnel", "q9_won_with_lead"])
def test_funnel_has_no_full_outer_join(no_broadcast, name):
    assert "FullOuter" not in catalog.run(no_broadcast, SF001, name)._jdf.queryExecution().optimizedPlan().toString()


def test_cluster_settings_scale_with_input():
    from funnelkit.session import cluster_settings
    small, big = cluster_settings(10 * 1024 ** 3), cluster_settings(100 * 1024 ** 4)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
