"""Row counts of the full outer chain (J11), computed without its rows.

The chain o FULL d FULL l FULL lao FULL a has, for each opportunity created in the window, one row for every
combination of its calls, contact-path lead rows, account-path lead rows and activities (one NULL row for a side
without any), and one row for every side row that meets no such opportunity.  ``count(*)`` and ``count(column)`` per
label are sums of products, so each side is kept as a bag: per key, how many rows (``n``) and how many non-NULL values of its counted column (``p``) it has
under each (segment code, TAS band).  A key has at most 36 such pairs, whatever the number of its rows.  The sides are multiplied in one
after another; the segment and the band of a product are those of the first side that knows one.

A lead row stands for lead x contact role x account-path opportunity x discovery; its multiplicity is the product of three counts, each
taken per key.  Counts are long; a count beyond that is an error (ANSI arithmetic), not a wrong number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import exprs as X
from funnelkit.operators.value_sets import NULL_BIT, SEGMENT_BITS, SegmentSets
from funnelkit.plans.activities import DateWindow, qualified_activities, ts_window
from funnelkit.plans.calls import discovery_call_rows
from funnelkit.plans.funnel import lead_base
from funnelkit.plans.leads import ACCOUNT_PATH_MAX_GMV, discovery_ids
from funnelkit.plans.opportunities import sales_opps

#: Counted column of each side: opportunity, call, contact-path lead, account-path lead, activity.
COUNTS = ["n_opps", "n_calls", "n_eligible_leads", "n_account_path_opps", "n_activities"]


def _band(tas: str) -> F.Column:
    return F.when(F.col(tas).isNotNull(), X.segment_by_tas(F.col(tas))).alias("t")


def _bag(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, s, t, n, p) summed per key and label: partial sums leave each task."""
    return rows.groupBy(*keys, "s", "t").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))


def _times(found: DataFrame, side: DataFrame, on: str, key: str, count: str) -> DataFrame:
    """``found`` multiplied by a side's bag; a key that the side does not have meets one NULL row."""
    bag = side.select(F.col(key).alias("_key"), F.col("s").alias("_s"), F.col("t").alias("_t"), F.col("n").alias("_n"), F.col("p").alias("_p"))
    joined = found.join(bag, F.expr(f"{on} = _key"), "left")
    others = [f"{c} * coalesce(_n, 1L) AS {c}" for c in ["n", *COUNTS] if c != count]
    return joined.selectExpr(
        *[c for c in found.columns if c not in ("s", "t", "n", *COUNTS)],
        f"if(s = {NULL_BIT}, coalesce(_s, {NULL_BIT}), s) AS s", "coalesce(t, _t) AS t", *others, f"n * coalesce(_p, 0L) AS {count}")


def _added(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy(*keys, "s", "t").agg(*[F.sum(c).alias(c) for c in ["n", *COUNTS]])


def _alone(rows: DataFrame, count: str) -> DataFrame:
    """Side rows (s, t, n, p) that meet no opportunity of the window."""
    return rows.selectExpr("s", "t", "n", *[f"{'p' if c == count else '0L'} AS {c}" for c in COUNTS])


def full_outer_chain(crm, window: DateWindow) -> DataFrame:
    """raw_segment, segment_based_tas, n_rows and the non-NULL counts of the chain's rows whose segment is kept."""
    code = SegmentSets().own
    deals = sales_opps(crm, "opportunity_id", "account_id", "account_segment", "account_tas", "est_gmv", "created_date").select(
        F.col("opportunity_id").alias("opp"), F.col("account_id").alias("firm"), F.expr(f"{code('account_segment')} AS s"), _band("account_tas"),
        F.expr(f"coalesce(est_gmv < {ACCOUNT_PATH_MAX_GMV}, false) AS capped"), ts_window(window, F.col("created_date")).alias("inside"))
    anchors = deals.where("inside")
    here = anchors.select(F.col("opp").alias("here"))

    # calls, by opportunity
    spoken = discovery_call_rows(crm, window, with_activity=False)
    calls = _bag(spoken.select(F.col("disco_created_opp_id").alias("opp"), F.expr(f"{code('disco_account_segment')} AS s"), _band("disco_account_tas"),
                               F.expr("1L AS n"), F.expr("1L AS p")), "opp")

    # leads, with the number of their contact's roles, their account's opportunities and their contact's discoveries
    roles = crm.opportunity_contact_role.selectExpr("contactid", "opportunityid").join(here, F.expr("opportunityid = here"), "left")
    per_contact = roles.groupBy(F.col("contactid").alias("role_contact")).agg(F.expr("count(*) AS all_roles"), F.expr("count(here) AS roles_here"))
    per_firm = deals.where("capped").groupBy(F.col("firm").alias("deal_firm")).agg(F.expr("count(*) AS all_deals"), F.expr("count_if(inside) AS deals_here"))
    dials = discovery_ids(crm, window).groupBy(F.col("whoid").alias("dialled")).agg(F.expr("count(*) AS all_dials"))
    leads = (lead_base(crm, window)
             .join(dials, F.expr("lead_contact = dialled"), "left").join(per_contact, F.expr("lead_cc = role_contact"), "left")
             .join(per_firm, F.expr("lead_account = deal_firm"), "left"))
    leads = leads.select(
        "lead_cc", "lead_account", F.col("lc").alias("s"), _band("l_tas"),
        *[F.expr(f"coalesce({c}, 0L) AS {c}") for c in ("all_roles", "roles_here", "all_deals", "deals_here")],
        F.expr("coalesce(all_dials, 1L) AS dials"), F.expr("CAST(eligible_lead_ids IS NOT NULL AS bigint) AS eligible"),
        F.expr("CAST(coalesce(acc_path_ok, false) AS bigint) AS credited"))
    by_role, by_deal = "dials * greatest(all_deals, 1L)", "dials * greatest(all_roles, 1L)"
    by_contact = _bag(leads.where("roles_here > 0").selectExpr("lead_cc", "s", "t", f"{by_role} AS n", f"{by_role} * eligible AS p"), "lead_cc")
    by_firm = _bag(leads.where("deals_here > 0").selectExpr(
        "lead_account", "s", "CAST(NULL AS STRING) AS t", f"{by_deal} AS n", f"{by_deal} * credited AS p"), "lead_account")
    met = _bag(roles.where("here IS NOT NULL").join(by_contact, F.expr("contactid = lead_cc"), "inner").selectExpr("here AS opp", "s", "t", "n", "p"), "opp")

    # activities, by account
    done = qualified_activities(crm, window).selectExpr(
        "activity_account_id AS firm", f"{code('activity_account_segment')} AS s", "CAST(NULL AS STRING) AS t", "1L AS n", "1L AS p")
    activities = _bag(done, "firm")

    found = anchors.selectExpr("opp", "firm", "if(capped, firm, NULL) AS path_firm", "s", "t", "1L AS n", *[f"{int(c == 'n_opps')}L AS {c}" for c in COUNTS])
    keys = ["opp", "firm", "path_firm"]
    found = _added(_times(found, calls, "opp", "opp", "n_calls"), *keys)
    found = _added(_times(found, met, "opp", "opp", "n_eligible_leads"), *keys)
    # from here on only the account tells opportunities apart
    found = _added(found, "firm", "path_firm")
    found = _added(_times(found, by_firm, "path_firm", "lead_account", "n_account_path_opps"), "firm")
    found = _times(found, activities, "firm", "firm", "n_activities").drop("firm")

    places = anchors.select(F.col("firm").alias("place")).distinct()
    outside_roles, outside_deals = "if(all_roles = 0, 1L, all_roles - roles_here)", "if(all_deals = 0, 1L, all_deals - deals_here)"
    alone = [
        _alone(calls.join(here, F.expr("opp = here"), "left_anti"), "n_calls"),
        _alone(leads.selectExpr("s", "t", f"{by_role} * {outside_roles} AS n", f"{by_role} * {outside_roles} * eligible AS p"), "n_eligible_leads"),
        _alone(leads.selectExpr("s", "CAST(NULL AS STRING) AS t", f"{by_deal} * {outside_deals} AS n", f"{by_deal} * (all_deals - deals_here) * credited AS p"),
               "n_account_path_opps"),
        _alone(activities.join(places, F.expr("firm = place"), "left_anti"), "n_activities"),
    ]
    rows = reduce(DataFrame.unionByName, [_added(part) for part in [found, *alone]])
    names = F.element_at(F.create_map(*[F.lit(x) for name, bit in SEGMENT_BITS.items() for x in (bit, name)]), F.col("s"))
    kept = rows.where(F.col("s").isin(list(SEGMENT_BITS.values())) & (F.col("n") > 0))
    return kept.groupBy(names.alias("raw_segment"), F.coalesce("t", F.lit("OTHER")).alias("segment_based_tas")).agg(
        F.sum("n").alias("n_rows"), *[F.sum(c).alias(c) for c in COUNTS])
