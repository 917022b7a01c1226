"""B2 discovery-call ids and B4 lead funnel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import exprs as X
from funnelkit.operators.relational import heavy_keys, spread_join
from funnelkit.plans.activities import DateWindow, owners, ts_window
from funnelkit.plans.opportunities import sales_opps

# --- fixed values (neutralised) ------------------------------------------------
# The reference drops leads from one partner lead source and from the company's
# own e-mail domain; both names are replaced by neutral stand-ins that the test
# data also uses.
EXCLUDED_SOURCE_PATTERN = "%partnerco%"
INTERNAL_EMAIL_PATTERN = "%@internal.example"
LEAD_BUSINESS_UNIT = "US"
LEAD_PURCHASE_PATH = "sales"
ACCOUNT_PATH_MAX_GMV = 50000000
# -------------------------------------------------------------------------------


def discovery_ids(crm, window: DateWindow, narrow_roles: bool = False, with_date: bool = False) -> DataFrame:
    """B2: discovery-call events owned by a sales role, created in the window."""
    t = crm.event
    own = owners(crm)
    roles = X.DISCOVERY_OWNER_ROLES_NARROW if narrow_roles else X.DISCOVERY_OWNER_ROLES
    j = (t.where(X.ilike_any(F.col("subject"), X.DISCOVERY_SUBJECTS) & ts_window(window, F.col("createddate")))
          .join(own, t["ownerid"] == own["owner_id"], "left")
          .where(X.role_in(F.col("owner_current_role"), roles)))
    cols = [F.col("id").alias("discovery_ids")]
    if with_date:
        cols.append(F.col("createddate").alias("disco_create_date"))
    return j.select(*cols, "whoid",
                    X.id_if_prefix(F.col("whoid"), X.CONTACT_PREFIX).alias("contact_id"),
                    X.id_if_prefix(F.col("whoid"), X.LEAD_PREFIX).alias("lead_id"))


def counted_leads(crm, window: DateWindow | None) -> DataFrame:
    """Lead rows that pass the tests of the B4 WHERE clause on the lead itself."""
    l = crm.lead
    src = F.col("leadsource")
    cond = ((F.col("business_unit") == F.lit(LEAD_BUSINESS_UNIT))
            & (src.isNull() | ~src.ilike(EXCLUDED_SOURCE_PATTERN))
            & F.col("purchase_path").ilike(LEAD_PURCHASE_PATH)
            & ~F.col("email").ilike(INTERNAL_EMAIL_PATTERN))
    if window is not None:
        cond = cond & ts_window(window, F.col("createddate"))
    return l.where(cond)


def filtered_leads(crm, window: DateWindow | None) -> DataFrame:
    """Lead rows that pass the B4 WHERE clause, with their converted account.

    The account lookup is written as an inner join: the WHERE test on the
    account's self-service flag rejects the NULL-extended rows anyway (J14).
    """
    al = crm.account.select(F.col("id").alias("al_id"),
                            F.col("segment").alias("lead_account_segment1"),
                            F.col("vertical").alias("lead_account_vertical"),
                            F.col("self_service").alias("al_self_service"))
    return (counted_leads(crm, window).alias("l")
             .join(al, F.col("l.convertedaccountid") == al["al_id"], "inner")
             .where(F.col("al_self_service") == F.lit(False))
             .drop("al_self_service"))


def lead_rows(crm, window: DateWindow | None, disco: DataFrame, with_dates: bool = False) -> DataFrame:
    """One row per lead x contact-role opportunity x account opportunity x call (bag).

    Many-to-one lookups (contact, lead-source map, owner) run first; the
    one-to-many joins that fan the lead out run last, starting from the leads
    (lead -> contact role -> opportunity), so the contact-role table is never
    joined to all opportunities.  The two fan-outs cut heavy contacts and accounts on both sides.
    """
    l = filtered_leads(crm, window)
    c = crm.contact.select(F.col("id").alias("c_id"), F.col("passed_sql").alias("c_passed_sql"),
                           F.col("leadsource").alias("c_leadsource"))
    lm = crm.lead_source_map
    own = owners(crm).select("owner_id", F.col("owner_current_role").alias("lead_owner_role"))
    oc = crm.opportunity_contact_role.select(F.col("contactid").alias("oc_contactid"),
                                             F.col("opportunityid").alias("oc_opportunityid"))
    v = sales_opps(crm, "opportunity_id").select(F.col("opportunity_id").alias("v_opportunity_id"))
    vao = (sales_opps(crm, "opportunity_id", "account_id", "est_gmv").where(F.col("est_gmv") < ACCOUNT_PATH_MAX_GMV)
           .select(F.col("account_id").alias("vao_account_id"),
                   F.col("opportunity_id").alias("vao_opportunity_id")))
    d = disco.select(*[F.col(x).alias(f"d_{x}") for x in disco.columns])

    # the joins by contact stand next to one another: the leads are dealt by contact once
    by_contact = F.col("convertedcontactid")
    j = (l.join(c, by_contact == c["c_id"], "left")
          .join(d, (by_contact == d["d_whoid"]) & F.col("c_id").isNotNull(), "left"))
    counted = counted_leads(crm, window)
    heavy = heavy_keys({"contact": (counted, "convertedcontactid", oc, "oc_contactid"), "account": (counted, "convertedaccountid", vao, "vao_account_id")})
    j = spread_join(j, oc, "convertedcontactid", "oc_contactid", ["id", "d_discovery_ids"], ["oc_opportunityid"], heavy, "contact")
    j = (j
          # a contact role on a non-sales opportunity still yields a lead row (with no opportunity)
          .join(v, F.col("oc_opportunityid") == v["v_opportunity_id"], "left")
          .join(lm, F.col("c_leadsource") == lm["leadsource"], "left").drop(lm["leadsource"])
          .join(own, F.col("ownerid") == own["owner_id"], "left"))
    j = spread_join(j, vao, "al_id", "vao_account_id", ["id", "d_discovery_ids", "oc_opportunityid"], ["vao_opportunity_id"], heavy, "account")

    lid = F.col("id")
    sql_ok = F.col("c_passed_sql") == F.lit(True)
    vao_hit = F.col("vao_opportunity_id").isNotNull()
    email = F.col("email")
    cols = [
        F.col("createddate"),
        F.col("lead_account_segment1"),
        F.col("lead_account_vertical"),
        F.col("marketing_qualified_date"),
        X.revenue_band_value(F.col("annual_sales_band")).alias("mapped_lead_tas"),
        X.id_when(F.col("eligibility_status") == "Eligible", lid).alias("eligible_lead_ids"),
        X.id_when(F.col("passed_mql") == F.lit(True), lid).alias("mql_lead_id"),
        X.id_when(F.col("lead_owner_role") == "BDA", lid).alias("sal_lead_id"),
        X.id_when(sql_ok, lid).alias("sql_lead_id"),
        F.col("d_discovery_ids").alias("discovery_ids_lead"),
        X.id_when(F.col("v_opportunity_id").isNotNull(), lid).alias("total_converted_opp_lead_id"),
        F.col("v_opportunity_id").alias("total_converted_opp_opp_id"),
        X.id_when(sql_ok & vao_hit & X.free_mail_ok(email, "or"), lid).alias("total_converted_acc_opp_lead_id"),
        F.col("v_opportunity_id").alias("opportunity_id_lead_opp"),
        X.id_when(sql_ok & vao_hit & X.free_mail_ok(email, "and"),
                  F.col("vao_opportunity_id")).alias("total_converted_acc_opp_id"),
        F.col("leadsource"),
        F.col("lead_source_mapped"),
        F.col("vao_opportunity_id").alias("opportunity_id_lead_account"),
    ]
    if with_dates:
        cols.insert(6, F.col("d_disco_create_date").alias("disco_create_date"))
        cols.append(X.source_condensed(F.col("leadsource")).alias("source_condensed"))
    return j.select(*cols)
