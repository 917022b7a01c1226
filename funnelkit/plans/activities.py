"""B1 activity unification and B3 qualified activities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import exprs as X
from funnelkit.operators.relational import calendar_join, union_all


@dataclass(frozen=True)
class DateWindow:
    """Half-open window [start, end); ``end=None`` is open-ended."""

    start: str
    end: str | None


def ts_window(w: DateWindow, col) -> F.Column:
    lo = col >= F.lit(w.start).cast("timestamp_ntz")
    return lo if w.end is None else lo & (col < F.lit(w.end).cast("timestamp_ntz"))


def date_window(w: DateWindow, col) -> F.Column:
    lo = col >= F.lit(w.start).cast("date")
    return lo if w.end is None else lo & (col < F.lit(w.end).cast("date"))


def owners(crm) -> DataFrame:
    """User joined to its current role (J2), shared by every owner lookup."""
    u, r = crm.user.alias("u"), crm.userrole.alias("ur")
    return u.join(r, F.col("u.userroleid") == F.col("ur.id"), "left").select(
        F.col("u.id").alias("owner_id"),
        F.col("u.name").alias("owner_name"),
        F.col("ur.name").alias("owner_current_role"),
        F.col("u.previous_role").alias("owner_previous_role"),
        F.col("u.previous_role_end_date").alias("owner_previous_role_end_date"),
    )


def _keys(df: DataFrame) -> list:
    who, what = F.col("whoid"), F.col("whatid")
    return [
        X.id_type(what, X.WHAT_ID_LABELS).alias("what_id_type"),
        X.id_type(who, X.WHO_ID_LABELS).alias("who_id_type"),
        X.id_if_prefix(what, X.ACCOUNT_PREFIX).alias("account_id"),
        X.id_if_prefix(what, X.OPPORTUNITY_PREFIX).alias("opportunity_id"),
        X.id_if_prefix(who, X.CONTACT_PREFIX).alias("contact_id"),
        X.id_if_prefix(who, X.LEAD_PREFIX).alias("lead_id"),
    ]


ACTIVITY_COLUMNS = ["activity_id", "owner_name", "owner_role", "owner_previous_role",
                    "owner_previous_role_end_date", "date", "subject", "activity_type",
                    "whoid", "whatid", "what_id_type", "who_id_type", "account_id",
                    "opportunity_id", "contact_id", "lead_id"]


def activity_union(crm) -> DataFrame:
    """B1: tasks and calendar events in one 16-column shape.

    A task keeps the role stored on it; an event takes its owner's current role.
    The two sources are unioned first and the owner lookup (J2) is joined once.
    The task branch's role lookup contributes no column and role ids are unique,
    so it is not needed (J15).
    """
    own = owners(crm)
    cols = ["activitydate", "subject", "type", "whoid", "whatid"]
    tasks = crm.task.select("id", "ownerid", F.col("owner_role").alias("_stored_role"),
                            F.lit(True).alias("_task"), *cols)
    events = crm.event.select("id", "ownerid", F.lit(None).cast("string").alias("_stored_role"),
                              F.lit(False).alias("_task"), *cols)
    both = union_all(tasks, events)
    j = both.join(own, both["ownerid"] == own["owner_id"], "left")
    role = F.when(F.col("_task"), F.col("_stored_role")).otherwise(F.col("owner_current_role"))
    return j.select(
        F.col("id").alias("activity_id"), "owner_name", role.alias("owner_role"),
        "owner_previous_role", "owner_previous_role_end_date",
        F.col("activitydate").alias("date"), "subject", F.col("type").alias("activity_type"),
        "whoid", "whatid", *_keys(j))


def qualified_activities(crm, window: DateWindow, with_fiscal: bool = False, lookups: bool = True,
                         accounts: DataFrame | None = None) -> DataFrame:
    """Outbound activities by a sales role (at the time of the activity), with account.

    ``lookups=False`` leaves out contact and account.  ``accounts`` (one column of distinct
    account ids) keeps the activities of those accounts only, found through their contacts.

    Filters on union columns are applied before the contact/account lookups and
    are pushed through the union into both scans by Catalyst.
    """
    ac = activity_union(crm)
    subject = F.col("subject")
    ac = ac.where(
        X.role_at_time(F.col("owner_role"), F.col("owner_previous_role"),
                       F.col("owner_previous_role_end_date"), F.col("date"), X.ACTIVITY_ROLES, inclusive=True)
        & F.col("activity_type").isin(X.OUTBOUND_TYPES)
        & (subject.isNull() | ~subject.ilike("%<<%") | ~subject.ilike("%>>%"))
        & date_window(window, F.col("date"))
    )
    if with_fiscal:
        ac = calendar_join(ac, crm.calendar, F.col("date"))
    if not lookups:
        return ac
    c = crm.contact.select(F.col("id").alias("activity_contact_id"), F.col("accountid").alias("_c_account"))
    if accounts is not None:
        c = c.join(accounts, c["_c_account"] == accounts[accounts.columns[0]], "left_semi")
    a = crm.account.select(F.col("id").alias("activity_account_id"),
                           F.col("segment").alias("activity_account_segment"),
                           F.col("vertical").alias("activity_account_vertical"))
    out = (ac.join(c, ac["whoid"] == c["activity_contact_id"], "left" if accounts is None else "inner")
             .join(a, F.col("_c_account") == a["activity_account_id"], "left")
             .drop("_c_account"))
    extra = ["fiscal_year", "fiscal_quarter"] if with_fiscal else []
    return out.select(*ACTIVITY_COLUMNS, "activity_account_id", "activity_contact_id",
                      "activity_account_segment", "activity_account_vertical", *extra)
