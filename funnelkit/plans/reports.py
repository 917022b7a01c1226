"""The eleven report entry points (Q1-Q11) over CRM views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import exprs as X
from funnelkit.operators.relational import calendar_join, first_per_key
from funnelkit.params import DEFAULT, ReportParams
from funnelkit.plans.activities import qualified_activities
from funnelkit.plans.calls import discovery_call_rows
from funnelkit.plans.combined import full_funnel
from funnelkit.plans.funnel import won_with_lead
from funnelkit.plans.leads import (ACCOUNT_PATH_MAX_GMV, discovery_ids, filtered_leads, lead_rows)
from funnelkit.plans.opportunities import (opps_created, rep_count_by_quarter, sales_opps, win_rate)


def q1_rep_count_by_quarter(crm, p: ReportParams = DEFAULT) -> DataFrame:
    return rep_count_by_quarter(crm, p.history_start, p.end, p.window)


def q2_accounts_touched(crm, p: ReportParams = DEFAULT) -> DataFrame:
    a = qualified_activities(crm, p.window, with_fiscal=True)
    return a.select("activity_account_id", "activity_account_segment", "activity_account_vertical",
                    "owner_role", "fiscal_year", "fiscal_quarter").distinct()


def q3_activity_volume(crm, p: ReportParams = DEFAULT) -> DataFrame:
    a = qualified_activities(crm, p.window)
    a = a.where(F.col("activity_account_id").isNotNull())
    return (a.groupBy("activity_account_id", "activity_account_segment", "activity_account_vertical",
                      "owner_name", "owner_role", "activity_type")
             .agg(F.count("activity_id").alias("activity_count")))


def q4_active_reps(crm, p: ReportParams = DEFAULT) -> DataFrame:
    a = qualified_activities(crm, p.window, with_fiscal=True)
    a = a.where((F.col("owner_role") == "Account Executive") | (F.col("owner_role") == "BDA"))
    keys = ["owner_name", "owner_role", "activity_account_segment", "fiscal_year", "fiscal_quarter"]
    return (a.groupBy(*keys).agg(F.count("owner_name").alias("owner_activity_count"))
             .orderBy(F.col("owner_name").asc_nulls_last(), F.col("fiscal_year").asc_nulls_last(),
                      F.col("fiscal_quarter").asc_nulls_last()))


def q5_discovery_calls(crm, p: ReportParams = DEFAULT) -> DataFrame:
    return discovery_call_rows(crm, p.window, with_fiscal=True)


def q6_full_funnel(crm, p: ReportParams = DEFAULT) -> DataFrame:
    return full_funnel(crm, p.window)


def q7_lead_validation(crm, p: ReportParams = DEFAULT) -> DataFrame:
    """Opportunities credited to a lead through the contact-role path, largest first.

    The lead side needs only (eligible lead, credited opportunity): the
    account-path opportunities enter as an existence test per account and the
    discovery-call lookup only repeats rows, so neither fans the lead out here.
    """
    l = filtered_leads(crm, None)
    c = crm.contact.select(F.col("id").alias("c_id"), F.col("passed_sql").alias("c_passed_sql"))
    v = sales_opps(crm, "opportunity_id").select(F.col("opportunity_id").alias("v_opp"))
    oc = crm.opportunity_contact_role.select(F.col("contactid").alias("oc_contactid"),
                                             F.col("opportunityid").alias("oc_opp"))
    # accounts with an account-path opportunity; distinct first so a busy account
    # collapses map-side instead of shipping all its opportunities to one task
    vao_accounts = (sales_opps(crm, "est_gmv", "account_id").where(F.col("est_gmv") < ACCOUNT_PATH_MAX_GMV)
                    .select(F.col("account_id").alias("al_id")).distinct())
    credited = (l.join(vao_accounts, "al_id", "left_semi")
                 .join(c, F.col("convertedcontactid") == c["c_id"], "left")
                 .where((F.col("c_passed_sql") == F.lit(True)) & X.free_mail_ok(F.col("email"), "exact"))
                 .join(oc, F.col("convertedcontactid") == oc["oc_contactid"], "inner")
                 .join(v, F.col("oc_opp") == v["v_opp"], "inner")
                 .select(X.id_when(F.col("eligibility_status") == "Eligible", F.col("id")).alias("eligible_lead_ids"),
                         F.col("v_opp").alias("total_converted_acc_opp_id")))
    fact = crm.pick("opportunity_fact", "opportunity_name", "opportunity_id", "est_gmv", "account_segment")
    le = crm.lead.select(F.col("id").alias("le_id"), F.col("name").alias("lead_name"),
                         F.col("email").alias("lead_email"))
    j = (fact.join(credited, fact["opportunity_id"] == credited["total_converted_acc_opp_id"], "inner")
             .join(le, F.col("eligible_lead_ids") == le["le_id"], "left"))
    first = first_per_key(j, ["opportunity_id", "eligible_lead_ids"],
                          [F.col("opportunity_id").asc(), F.col("lead_name").asc_nulls_last(),
                           F.col("lead_email").asc_nulls_last()])
    return (first.select("opportunity_name", "opportunity_id", "est_gmv", "account_segment",
                         "eligible_lead_ids", "lead_name", "lead_email")
                 .orderBy(F.col("est_gmv").desc_nulls_first()))


def q8_inbound_leads(crm, p: ReportParams = DEFAULT) -> DataFrame:
    d = discovery_ids(crm, p.window, with_date=True)
    rows = lead_rows(crm, p.window, d, with_dates=True)
    rows = calendar_join(rows, crm.calendar, F.to_date(F.col("createddate")), prefix="lead_")
    return calendar_join(rows, crm.calendar, F.to_date(F.col("disco_create_date")), prefix="disco_")


def q9_won_with_lead(crm, p: ReportParams = DEFAULT) -> DataFrame:
    return won_with_lead(crm, p.window)


def q10_opps_created(crm, p: ReportParams = DEFAULT) -> DataFrame:
    return opps_created(crm, p.window)


def q11_win_rate(crm, p: ReportParams = DEFAULT) -> DataFrame:
    return win_rate(crm, p.start, p.end)


REPORTS = {
    "q1_rep_count_by_quarter": q1_rep_count_by_quarter,
    "q2_accounts_touched": q2_accounts_touched,
    "q3_activity_volume": q3_activity_volume,
    "q4_active_reps": q4_active_reps,
    "q5_discovery_calls": q5_discovery_calls,
    "q6_full_funnel": q6_full_funnel,
    "q7_lead_validation": q7_lead_validation,
    "q8_inbound_leads": q8_inbound_leads,
    "q9_won_with_lead": q9_won_with_lead,
    "q10_opps_created": q10_opps_created,
    "q11_win_rate": q11_win_rate,
}
