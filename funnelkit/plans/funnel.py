"""Won opportunities with a lead (B13), and the lead and segment parts it shares with the chain's row counts.

Row by row this is the combined chain of ``combined`` kept where an opportunity is won and a lead eligible.  Here
everything starts from the won opportunities, and the sides that only matter through their segments are kept as 6-bit
masks of the segments that occur (``value_sets``), gathered map-side per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.functions import exprs as X
from funnelkit.operators.value_sets import NOT_NULL, NULL_BIT, SEGMENT_BITS, SegmentSets
from funnelkit.plans.activities import DateWindow, owners, qualified_activities
from funnelkit.plans.calls import discovery_call_rows
from funnelkit.plans.leads import ACCOUNT_PATH_MAX_GMV, filtered_leads
from funnelkit.plans.opportunities import opportunity_stage_rows

KEEP = sum(SEGMENT_BITS.values())
OPP_COLUMNS = ["opp_account_id", "opp_account_segment", "created_opps", "est_gmv"]


def seg_code(seg: str) -> Column:
    """Bit of a segment column."""
    return F.expr(SegmentSets().own(seg))


def coal(*masks: Column) -> Column:
    """Segments COALESCE can return when each argument ranges over a value set."""
    if not masks:
        return F.lit(NULL_BIT)
    head, rest = masks[0], masks[1:]
    tail = F.when(head.bitwiseAND(F.lit(NULL_BIT)) != 0, coal(*rest)).otherwise(F.lit(0))
    return head.bitwiseAND(F.lit(NOT_NULL)).bitwiseOR(tail)


def _bits(name: str, df: DataFrame, key: str, code: Column) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{name}_key")).agg(
        F.bit_or(code).alias(name))


def lead_base(crm, window: DateWindow) -> DataFrame:
    """One row per lead passing the B4 filters, with lead-level ids and flags."""
    l = filtered_leads(crm, window)
    c = crm.contact.select(F.col("id").alias("c_id"), F.col("passed_sql").alias("c_passed_sql"))
    own = owners(crm).select("owner_id", F.col("owner_current_role").alias("lead_owner_role"))
    j = (l.join(c, F.col("convertedcontactid") == c["c_id"], "left")
          .join(own, F.col("ownerid") == own["owner_id"], "left"))
    lid = F.col("id")
    sql_ok = F.col("c_passed_sql") == F.lit(True)
    return j.select(
        lid.alias("lead_id"), F.col("convertedcontactid").alias("lead_cc"),
        F.col("c_id").alias("lead_contact"), F.col("al_id").alias("lead_account"),
        seg_code("lead_account_segment1").alias("lc"),
        X.revenue_band_value(F.col("annual_sales_band")).alias("l_tas"),
        X.id_when(F.col("eligibility_status") == "Eligible", lid).alias("eligible_lead_ids"),
        X.id_when(F.col("passed_mql") == F.lit(True), lid).alias("mql_lead_id"),
        X.id_when(F.col("lead_owner_role") == "BDA", lid).alias("sal_lead_id"),
        X.id_when(sql_ok, lid).alias("sql_lead_id"),
        (sql_ok & X.free_mail_ok(F.col("email"), "and")).alias("acc_path_ok"),
    )


def summarise(o: DataFrame, calls: DataFrame, leads: DataFrame, voc: DataFrame, activities: DataFrame) -> DataFrame:
    """Per opportunity of ``o``: its columns, its own segment code and the segment sets of each side."""
    sd = _bits("sd", calls, "disco_created_opp_id", seg_code("disco_account_segment"))
    cl = _bits("cl", leads, "lead_cc", F.col("lc"))
    sl = (voc.where(F.col("v_opp").isNotNull())
          .join(cl, voc["voc_contact"] == cl["cl_key"], "inner")
          .groupBy(F.col("v_opp").alias("sl_key")).agg(F.bit_or("cl").alias("sl")))
    call_ = _bits("call", leads, "lead_account", F.col("lc"))
    sa = _bits("sa", activities, "activity_account_id", seg_code("activity_account_segment"))
    j = (o.join(sd, o["created_opps"] == sd["sd_key"], "left")
          .join(sl, o["created_opps"] == sl["sl_key"], "left")
          .join(call_, o["opp_account_id"] == call_["call_key"], "left")
          .join(sa, o["opp_account_id"] == sa["sa_key"], "left"))
    one = F.lit(NULL_BIT)
    slao = F.when(F.col("est_gmv") < ACCOUNT_PATH_MAX_GMV, F.coalesce(F.col("call"), one)).otherwise(one)
    return j.select(
        *o.columns,
        seg_code("opp_account_segment").alias("so"),
        F.coalesce(F.col("sd"), one).alias("sd"),
        F.coalesce(F.col("sl"), one).alias("sl"),
        slao.alias("slao"),
        F.coalesce(F.col("sa"), one).alias("sa"),
    )


def won_with_lead(crm, window: DateWindow) -> DataFrame:
    """Q9 (B13): won opportunities with an eligible contact-path lead, with the TAS band.

    Rows pair a won opportunity with an eligible lead of one of its contact roles; the calls of the opportunity only
    matter through their (TAS, segment) values, the account-path leads and activities only through their segment
    sets.  Each side is semi-joined to the won opportunities, or to their accounts, before it is summarised.  A repeated
    opportunity id is an error when the report runs; the window that counts them deals the rows as the next join needs them.
    """
    won = opportunity_stage_rows(crm, window, [*OPP_COLUMNS, "opp_account_tas", "won_opps_id", "close_date"])
    won = won.where(F.col("won_opps_id").isNotNull())
    times = F.count(F.lit(1)).over(Window.partitionBy("created_opps"))
    repeated = F.raise_error(F.concat(F.lit("opportunity id is not unique: "), F.col("created_opps"))).cast("string")
    keys = won.select(F.col("created_opps").alias("won_key")).distinct()
    accounts = won.select(F.col("opp_account_id").alias("won_account")).distinct()

    oc = crm.opportunity_contact_role
    voc = oc.join(keys, oc["opportunityid"] == keys["won_key"], "left_semi").select(
        F.col("contactid").alias("voc_contact"), F.col("opportunityid").alias("v_opp"))
    leads = lead_base(crm, window)
    calls = discovery_call_rows(crm, window, with_activity=False, accounts=accounts)
    calls = calls.join(keys, calls["disco_created_opp_id"] == keys["won_key"], "left_semi").select(
        "disco_created_opp_id", "disco_account_segment", "disco_account_tas")
    activities = qualified_activities(crm, window, accounts=accounts).select("activity_account_id", "activity_account_segment")
    once = won.withColumn("won_opps_id", F.when(times > 1, repeated).otherwise(F.col("won_opps_id")))
    os_ = summarise(once, calls, leads, voc, activities)

    dred = calls.select(
        F.col("disco_created_opp_id").alias("dr_opp"), F.col("disco_account_tas").alias("d_tas"),
        seg_code("disco_account_segment").alias("dc")).distinct()
    el = leads.where(F.col("eligible_lead_ids").isNotNull())
    pairs = (voc.join(os_, voc["v_opp"] == os_["created_opps"], "inner")
             .join(el, F.col("voc_contact") == el["lead_cc"], "inner")
             .join(dred, F.col("created_opps") == dred["dr_opp"], "left"))
    so, dc, lc = F.col("so"), F.coalesce(F.col("dc"), F.lit(NULL_BIT)), F.col("lc")

    def kept(m):
        return m.bitwiseAND(F.lit(KEEP)) != 0

    ok = F.when(so != NULL_BIT, kept(so)).when(dc != NULL_BIT, kept(dc)).when(lc != NULL_BIT, kept(lc)) \
        .otherwise(kept(coal(F.col("slao"), F.col("sa"))))
    tas = F.coalesce(F.col("opp_account_tas"), F.col("d_tas"), F.col("l_tas").cast("double"))
    return pairs.where(ok).select(
        "won_opps_id", "eligible_lead_ids", X.segment_by_tas(tas).alias("segment_based_tas"),
        "opp_account_tas", "close_date").distinct()
