"""B5 discovery-call dataset: one row per (call, opportunity created within 6 months)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import exprs as X
from funnelkit.operators.relational import calendar_join, first_per_key, interval_join
from funnelkit.plans.activities import DateWindow, owners, qualified_activities, ts_window
from funnelkit.plans.opportunities import sales_opps

LOOKAHEAD_MONTHS = 6
ACTIVITY_PICK = ["activity_contact_id", "activity_id", "owner_name", "owner_role", "activity_account_id"]


def lookahead_range(window: DateWindow, created):
    """Opportunities a call in ``window`` can reach: start < created < end + 6 months.

    Implied by the interval condition (call time >= start, call time < end and
    adding months is monotone), so it is exact; it lets the opportunity scan
    skip everything outside the reachable range instead of shuffling it.
    """
    cond = created > F.lit(window.start).cast("timestamp_ntz")
    if window.end is not None:
        cond = cond & (created < F.lit(window.end).cast("timestamp_ntz")
                       + F.make_ym_interval(F.lit(0), F.lit(LOOKAHEAD_MONTHS)))
    return cond


def first_activity_per_contact(activities: DataFrame) -> DataFrame:
    """The qualified activity a call row keeps, per contact.

    The reference joins every qualified activity of the call's contact and then
    keeps one row per (call, opportunity) ordered by the contact's creation
    date, which is constant inside the group; with the tie-break on
    ``activity_id`` the survivor is the contact's smallest activity id whatever
    the opportunity.  Taking it per contact up front is the same result without
    the fan-out.  Planned as a top-1 per contact inside each map partition, so a
    contact with a third of all activities ships one row per partition.
    """
    rows = activities.where(F.col("activity_contact_id").isNotNull()).select(*ACTIVITY_PICK)
    return first_per_key(rows, ["activity_contact_id"], [F.col(c).asc_nulls_first() for c in ACTIVITY_PICK[1:]])


def discovery_call_rows(crm, window: DateWindow, activity_window: DateWindow | None = None,
                        with_fiscal: bool = False, activities: DataFrame | None = None,
                        with_activity: bool = True, accounts: DataFrame | None = None) -> DataFrame:
    """B5; ``activities`` may pass in already computed qualified activities.

    One row per (call, opportunity), as the reference's QUALIFY keeps: the call side is brought
    down to one row per call before the interval join (a call row does not depend on the
    opportunity), and so are the opportunities, so repeated user, account, contact or opportunity rows repeat nothing.

    ``accounts`` (one column of distinct account ids) restricts the calls to those accounts.

    ``with_activity=False`` is for callers that read none of the activity
    columns (they come back NULL): the per-contact activity pick is not built.
    """
    activity_window = activity_window or window
    t = crm.event.where(X.ilike_any(F.col("subject"), X.DISCOVERY_SUBJECTS)
                        & ts_window(window, F.col("createddate")))
    a = crm.account.select(F.col("id").alias("a_id"), F.col("segment").alias("disco_account_segment"),
                           F.col("vertical").alias("disco_account_vertical"),
                           F.col("amount").alias("disco_account_tas"))
    if accounts is not None:
        t = t.join(accounts, t["accountid"] == accounts[accounts.columns[0]], "left_semi")
    own = owners(crm).select("owner_id", F.col("owner_current_role").alias("call_owner_role"),
                             F.col("owner_previous_role").alias("call_owner_previous_role"),
                             F.col("owner_previous_role_end_date").alias("call_owner_previous_role_end_date"))
    c = crm.contact.select(F.col("id").alias("c_id"), F.col("createddate").alias("c_created"))

    calls = (t.join(a, t["accountid"] == a["a_id"], "inner")
              .join(own, t["ownerid"] == own["owner_id"], "left")
              .where(X.call_owner_qualifies(F.col("call_owner_role"), F.col("call_owner_previous_role"),
                                            F.col("call_owner_previous_role_end_date"), F.col("createddate")))
              .join(c, t["whoid"] == c["c_id"], "left"))
    if with_activity:
        if activities is None:
            activities = qualified_activities(crm, activity_window)
        ac = first_activity_per_contact(activities)
        calls = calls.join(ac, F.col("c_id") == ac["activity_contact_id"], "left")
    else:
        calls = calls.select("*", *[F.lit(None).cast("string").alias(n) for n in ACTIVITY_PICK])
    calls = (calls
              .select("a_id", "disco_account_segment", "disco_account_vertical", "disco_account_tas",
                      F.col("id").alias("discovery_ids"), F.col("createddate").alias("disco_create_date"),
                      "activity_id", "owner_name", "owner_role", "activity_account_id", "activity_contact_id", "c_created"))
    calls = first_per_key(calls, ["discovery_ids"], [F.col("c_created").asc_nulls_last(), F.col("activity_id").asc_nulls_last()]).drop("c_created")
    if with_fiscal:
        calls = calendar_join(calls, crm.calendar, F.to_date(F.col("disco_create_date")))

    opps = (sales_opps(crm, "opportunity_id", "account_id", "created_date")
            .where(lookahead_range(window, F.col("created_date")))
            .select(F.col("opportunity_id").alias("disco_created_opp_id"),
                    F.col("account_id").alias("v_account_id"), "created_date")
            .distinct())  # three narrow columns: one row per pair where opportunity rows repeat
    j = interval_join(calls, opps, left_key="a_id", right_key="v_account_id",
                      left_ts="disco_create_date", right_ts="created_date",
                      months=LOOKAHEAD_MONTHS, left_id="discovery_ids")
    hit = F.col("activity_id").isNotNull()
    extra = ["fiscal_year", "fiscal_quarter"] if with_fiscal else []
    return j.select(
        "disco_account_segment", "disco_account_vertical", "disco_account_tas", "discovery_ids",
        "disco_create_date", "disco_created_opp_id", "created_date", "owner_name", "owner_role", *extra,
        F.when(hit, F.col("discovery_ids")).alias("activity_disco_ids"),
        F.when(hit, F.col("activity_account_id")).alias("activity_disco_account_ids"),
        F.when(hit, F.col("activity_contact_id")).alias("activity_disco_contact_ids"),
    )
