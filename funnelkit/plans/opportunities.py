"""B6 opportunity stage rows, B9 opportunity baseline, B10 win-rate report, B12/B14 counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import exprs as X
from funnelkit.operators.relational import calendar_join, first_per_key
from funnelkit.plans.activities import DateWindow, qualified_activities, ts_window


def sales_opps(crm, *columns: str) -> DataFrame:
    """Sales opportunities; only the named columns (and the lookups behind them) are read."""
    flag = "opportunity_sales_flag"
    wanted = [c for c in columns if c != flag]
    return crm.pick("opportunity_fact", flag, *wanted).where(F.col(flag) == F.lit(True))


def closed_window(col, start: str, end: str):
    """``start <= col <= end``; on a timestamp only midnight of ``end`` is kept."""
    return (col >= F.lit(start).cast("timestamp_ntz")) & (col <= F.lit(end).cast("timestamp_ntz"))


def stage_ids() -> dict[str, tuple[list[str], F.Column]]:
    """Output column of B6 -> (fact columns it reads, expression)."""
    oid, stage = F.col("opportunity_id"), F.col("stage")
    prev_until = (F.col("opportunity_supporter_previous_role") == "BDA") & (
        F.col("close_date") < F.col("opportunity_supporter_previous_role_end_date"))
    supported = (F.col("opportunity_supporter_role") == "BDA") | prev_until
    supporter = ["opportunity_supporter_role", "opportunity_supporter_previous_role",
                 "opportunity_supporter_previous_role_end_date", "close_date"]
    return {
        "opp_account_id": (["account_id"], F.col("account_id")),
        "opp_account_vertical": (["vertical"], F.col("vertical")),
        "opp_account_segment": (["account_segment"], F.col("account_segment")),
        "opp_account_tas": (["account_tas"], F.col("account_tas")),
        "created_opps": (["opportunity_id"], oid),
        "close_date": (["close_date"], F.col("close_date")),
        "bda_supported_opp": (supporter, X.id_when(supported, oid)),
        "won_opps_id": (["stage"], X.id_when(stage.ilike("%won%"), oid)),
        "lost_opps_id": (["stage"], X.id_when(stage.ilike("%lost%"), oid)),
        "open_opps_id": (["stage"], X.id_when(~stage.ilike("%closed%"), oid)),
        "launched_opp_ids": (["launch_date"], X.id_when(F.col("launch_date").isNotNull(), oid)),
        "captured_opp_ids": (["capture_date"], X.id_when(F.col("capture_date").isNotNull(), oid)),
        "est_gmv": (["est_gmv"], F.col("est_gmv")),
    }


def opportunity_stage_rows(crm, window: DateWindow, columns: list[str], relabel_segment: bool = False,
                           with_quarter: bool = False) -> DataFrame:
    """One row per sales opportunity created in the window, with the named columns of ``stage_ids``.

    The activity flag, which no report reads, is built by ``activity_created_opps``.
    """
    known = stage_ids()
    read = dict.fromkeys(["opportunity_id", "created_date", *[c for n in columns for c in known[n][0]]])
    v = sales_opps(crm, *read).where(ts_window(window, F.col("created_date")))
    out = [known[n][1].alias(n) for n in columns]
    if relabel_segment:
        out = [X.relabel(F.col("account_segment"), "Self-Service", "SMB").alias(n) if n == "opp_account_segment" else c
               for n, c in zip(columns, out)]
    if with_quarter:
        v = calendar_join(v, crm.calendar, F.to_date(F.col("created_date")))
        out += [F.col("created_date"), X.dash_label(F.col("fiscal_year"), F.col("fiscal_quarter")).alias("fq")]
    return v.select(*out)


def activity_created_opps(crm, window: DateWindow) -> DataFrame:
    """B6's activity flag: the opportunities of accounts one of whose contacts has a qualified activity.

    The reference joins account -> contact -> activity and repeats the opportunity for each activity; what
    is read is whether there is one, so accounts are tested for existence and nothing fans out.
    """
    opps = opportunity_stage_rows(crm, window, ["opp_account_id", "created_opps"])
    contacts = qualified_activities(crm, window, lookups=False).select(F.col("whoid").alias("who")).distinct()
    active = (crm.contact.select(F.col("id").alias("who"), F.col("accountid").alias("active_account"))
              .join(contacts, "who", "left_semi").select("active_account").distinct())
    known = crm.account.select(F.col("id").alias("active_account"))
    active = active.join(known, "active_account", "left_semi")
    j = opps.join(active, F.col("opp_account_id") == F.col("active_account"), "left")
    return j.select("opp_account_id", "created_opps",
                    X.id_when(F.col("active_account").isNotNull(), F.col("created_opps")).alias("activity_created_opps"))


def opps_created(crm, window: DateWindow) -> DataFrame:
    """Q10 (B14): distinct opportunities created per segment and fiscal quarter."""
    o = opportunity_stage_rows(crm, window, ["opp_account_segment", "created_opps"], relabel_segment=True, with_quarter=True)
    return (o.groupBy("opp_account_segment", "fq")
             .agg(F.count_distinct("created_opps").alias("created_opps_count"))
             .orderBy(F.col("fq").asc_nulls_last(), F.col("opp_account_segment").asc_nulls_last()))


BASELINE_COLUMNS = [
    "opportunity_id", "opportunity_name", "stage", "opportunity_amount", "close_date", "created_date",
    "launch_date", "capture_date", "opportunity_owner", "opportunity_owner_role", "opportunity_owner_segment",
    "opportunity_supporter_role", "self_service_flag", "est_gmv", "total_sales_cycle_days", "account_id",
    "account_segment", "account_tas", "vertical", "product_type", "average_order_value", "account_industry",
    "opportunity_lead_source",
]


def _baseline(crm, start: str, end: str, columns: list[str]) -> DataFrame:
    labels = ["fiscal_quarter_name_close_date", "fiscal_year_close_date", "fiscal_quarter_name_create_date", "fiscal_year_create_date"]
    v = sales_opps(crm, *dict.fromkeys([*columns, "created_date", *labels]))
    v = v.where(closed_window(F.col("created_date"), start, end))
    return v.select(
        *columns, X.dash_label(F.col(labels[0]), F.col(labels[1])).alias("fq_close"),
        X.dash_label(F.col(labels[2]), F.col(labels[3])).alias("fq_create"))


def territory_gmv(crm) -> DataFrame:
    """The territory mart with one row per opportunity: the largest yearly GMV."""
    first = first_per_key(crm.territory_mart.select("opportunity_id", "opportunity_est_gmv_fy23"), ["opportunity_id"],
                          [F.col("opportunity_est_gmv_fy23").desc_nulls_last()])
    return first.select(F.col("opportunity_id").alias("mart_opportunity_id"), "opportunity_est_gmv_fy23")


def opportunity_baseline(crm, start: str, end: str) -> DataFrame:
    """Sales opportunities created in [start, end] with their fiscal labels, the calendar's quarter of
    creation, the amount's segment band, and the yearly GMV of the deduplicated territory mart.

    The mart is reduced to one row per opportunity before the join (map-side first), so no opportunity repeats."""
    v = _baseline(crm, start, end, BASELINE_COLUMNS)
    v = calendar_join(v, crm.calendar, F.to_date(F.col("created_date")))
    mart = territory_gmv(crm)
    j = v.join(mart, F.col("opportunity_id") == F.col("mart_opportunity_id"), "left")
    return j.select(
        *BASELINE_COLUMNS, "fq_close", "fq_create", "opportunity_est_gmv_fy23",
        X.dash_label(F.col("fiscal_year"), F.col("fiscal_quarter")).alias("fq"),
        X.segment_by_amount(F.col("opportunity_amount")).alias("amount_segment"))


def win_rate(crm, start: str, end: str, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """Q11 (B10): stage counts, GMV sums, cycle averages and win rates per creation quarter and, if named,
    by further columns of the fact view (product type, order value, industry, lead source, ...).

    A quarter without closed deals has no win rate (NULL) instead of a division error.
    """
    columns = ["stage", "est_gmv", "total_sales_cycle_days", "self_service_flag"]
    o = _baseline(crm, start, end, [*columns, *[d for d in dimensions if d not in columns]])
    o = o.where(F.col("self_service_flag") == F.lit(False))
    stage, gmv = F.col("stage"), F.col("est_gmv")

    def count_in(stages):
        return F.sum(F.when(stage.isin(stages), 1).otherwise(0)).cast("bigint")

    def gmv_in(stages):
        return F.sum(F.when(stage.isin(stages), gmv).otherwise(F.lit(0)))  # keeps decimal money decimal

    def avg_cycle(stages):
        return F.avg(F.when(stage.isin(stages), F.col("total_sales_cycle_days")))

    g = o.groupBy("fq_create", *dimensions).agg(
        count_in(X.WON_STAGES).alias("won"),
        count_in(X.LOST_STAGES).alias("lost"),
        count_in(X.PRE_OPPORTUNITY_STAGES).alias("pre_opportunity"),
        count_in(X.OPEN_STAGES).alias("open"),
        avg_cycle(X.WON_STAGES).alias("avg_cycle_closed_won"),
        avg_cycle(X.LOST_STAGES).alias("avg_cycle_closed_lost"),
        gmv_in(X.WON_STAGES).alias("won_est_gmv"),
        gmv_in(X.LOST_STAGES).alias("lost_est_gmv"),
        gmv_in(X.PRE_OPPORTUNITY_STAGES).alias("pre_opportunity_est_gmv"),
        gmv_in(X.OPEN_STAGES).alias("open_est_gmv"),
    )
    won, lost = F.col("won"), F.col("lost")
    wg, lg = F.col("won_est_gmv"), F.col("lost_est_gmv")
    out = g.select(
        "fq_create", *dimensions, "won", "lost", "pre_opportunity", "open",
        F.round("avg_cycle_closed_won", 6).alias("avg_cycle_closed_won"),
        F.round("avg_cycle_closed_lost", 6).alias("avg_cycle_closed_lost"),
        F.round(wg, 2).alias("won_est_gmv"), F.round(lg, 2).alias("lost_est_gmv"),
        F.round("pre_opportunity_est_gmv", 2).alias("pre_opportunity_est_gmv"),
        F.round("open_est_gmv", 2).alias("open_est_gmv"),
        F.round(F.try_divide(won.cast("double"), (won + lost).cast("double")), 6).alias("win_rate"),
        F.round(F.try_divide(wg, wg + lg), 6).alias("win_rate_est_gmv"),
    )
    return out.orderBy(F.col("fq_create").asc_nulls_last())


def rep_count_by_quarter(crm, load_start: str, load_end: str, window: DateWindow,
                         min_tas: float = 5000000, owner_role: str = "Account Executive") -> DataFrame:
    """Q1 (B9 + B12): distinct account executives per owner segment and fiscal quarter.

    Two-stage date filter as in the reference: a wide closed load window, then
    the half-open reporting window.  The deduplicated territory-mart lookup of
    the reference contributes no column to the result and is keyed uniquely
    after deduplication, so it is not joined here (see ``opportunity_baseline``).
    """
    v = (sales_opps(crm, "created_date", "opportunity_amount", "opportunity_owner_role", "opportunity_owner_segment", "opportunity_owner")
         .where(closed_window(F.col("created_date"), load_start, load_end)
                & (F.col("opportunity_amount") >= min_tas)
                & (F.col("opportunity_owner_role") == owner_role)))
    v = calendar_join(v, crm.calendar, F.to_date(F.col("created_date")))
    v = v.where(ts_window(window, F.col("created_date"))
                & (F.col("opportunity_owner_segment") != "N/A"))
    return (v.select(X.relabel(F.col("opportunity_owner_segment"), "Mid-Market", "SMB").alias("r_segment"),
                     X.dash_label(F.col("fiscal_year"), F.col("fiscal_quarter")).alias("fq"),
                     "opportunity_owner")
             .groupBy("r_segment", "fq").agg(F.count_distinct("opportunity_owner").alias("ae_count"))
             .orderBy(F.col("fq").asc_nulls_last(), F.col("r_segment").asc_nulls_last()))
