"""The combined funnel (B7, B8): ids counted per label over the full outer chain, without its fan-out.

The reference joins a left-anchored chain

    OPPS o FULL JOIN DISCO_CALLS d ON o.opp = d.opp
           FULL JOIN LEADS l      ON o.opp = l.contact_path_opp
           FULL JOIN LEADS lao    ON o.opp = lao.account_path_opp
           FULL JOIN ACTIVITIES a ON o.account = a.account

labels each row by COALESCE over the five sides, keeps four segments and counts distinct ids per label.
Every opportunity row is multiplied by the calls, leads and activities that meet it, so the
literal chain is quadratic in a busy account.  Later joins only test ``o.`` keys, so a row is
anchored at one opportunity with any combination of its matches, or is an unmatched row of one side.  Which labels an
id can reach therefore only depends on the sets of values on each side of its opportunities (``value_sets``).

Steps, each one shuffle of rows and one of what they look up:

1. ``base_rows``: tasks, events and leads together find their owner, their contact and their account, and each becomes the activity,
   call, discovery or lead rows that it qualifies for.
2. ``summaries``: per account and per contact, the sets of its leads and activities.
3. ``met``: opportunities, contact roles and calls look these up and meet by opportunity; a window hands the sets around.
4. ``signals``: what the opportunities of an account or contact let through, as contexts.
5. Leads, activities and discoveries look the signals up; (label, metric, id) rows are counted distinct.

Steps 2 to 5 read the same rows more than once.  ``fixed`` lets every reader ask for the same columns, so the shuffles below are equal
and Spark runs each once; nothing is written or cached.  Rows without a key get one of their own, so NULL keys do
not meet in one task.  Opportunity ids must be unique; a repeated one is an error when the report runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.functions import exprs as X
from funnelkit.operators.relational import interval_join, pivot_distinct_counts
from funnelkit.operators.value_sets import SegmentSets, VerticalSets
from funnelkit.plans.activities import DateWindow, date_window, owners, ts_window
from funnelkit.plans.calls import LOOKAHEAD_MONTHS, lookahead_range
from funnelkit.plans.leads import ACCOUNT_PATH_MAX_GMV, counted_leads
from funnelkit.plans.opportunities import sales_opps, stage_ids

Sets = SegmentSets | VerticalSets

STAGE_METRICS = {
    "all_created_opps": "created_opps", "all_bda_support_op": "bda_supported_opp", "all_open_opps": "open_opps_id",
    "all_won_opps": "won_opps_id", "all_lost_opps": "lost_opps_id", "all_launched_opps": "launched_opp_ids",
    "all_captured_opps": "captured_opp_ids",
}
LEAD_METRICS = {"all_eligible_leads": "eligible", "all_mql_leads": "mql", "all_sal_leads": "sal", "all_sql_leads": "sql_ok"}
FUNNEL_METRICS = [
    "all_activities", "all_accounts_reached", "all_contacts_reached", "all_account_with_disco",
    "all_contacts_with_disco", *LEAD_METRICS, "all_leads_to_disco_call", "all_leads_to_opps_artificially_low",
    "all_leads_to_opps_artificially_high", "all_discos", "all_disco_to_opps", "all_created_opps", "all_bda_support_op", "all_open_opps",
    "all_won_opps", "all_lost_opps", "all_launched_opps", "all_captured_opps",
]


def fixed(df: DataFrame) -> DataFrame:
    """``df``, all of whose columns are read wherever any is: readers of different columns share the shuffles below."""
    return df.selectExpr(f"inline(array(struct({', '.join(df.columns)})))")


def _key(kind: str, value: str, row: str) -> str:
    """Key of an account (A) or contact (C); rows without one are spread."""
    return f"coalesce('{kind}' || {value}, '#' || {row})"


def base_rows(crm, window: DateWindow, sets: Sets) -> DataFrame:
    """kind (activity, call, disco or lead), id, contact (as recorded), known (contact that exists), account (that exists), contact_account,
    at (calls: time), the flags of leads, and ``own``: the set of the account."""
    subject, made = F.col("subject"), F.col("createddate")
    prospecting = (F.col("type").isin(X.OUTBOUND_TYPES) & (subject.isNull() | ~subject.ilike("%<<%") | ~subject.ilike("%>>%"))
                   & date_window(window, F.col("activitydate")))
    spoken = X.ilike_any(subject, X.DISCOVERY_SUBJECTS) & ts_window(window, made)
    shared = [F.expr(c) for c in ("id", "ownerid", "activitydate", "whoid AS contact")]
    tasks = crm.task.where(prospecting).select(*shared, F.expr("owner_role AS stored_role"), F.expr("'task' AS source"), F.expr("true AS prospecting"))
    events = crm.event.where(prospecting | spoken).select(
        *shared, "createddate", F.expr("accountid AS own_account"), F.expr("'event' AS source"), prospecting.alias("prospecting"), spoken.alias("spoken"))
    leads = counted_leads(crm, window).select(
        "id", "ownerid", F.expr("convertedcontactid AS contact"), F.expr("convertedaccountid AS own_account"), F.expr("'lead' AS source"),
        F.expr("eligibility_status = 'Eligible' AS eligible"), F.expr("passed_mql AS mql"), X.free_mail_ok(F.col("email"), "and").alias("company_mail"))
    rows = tasks.unionByName(events, allowMissingColumns=True).unionByName(leads, allowMissingColumns=True)

    own = owners(crm).drop("owner_name")
    j = rows.join(own, rows["ownerid"] == own["owner_id"], "left")
    now, before, until = F.col("owner_current_role"), F.col("owner_previous_role"), F.col("owner_previous_role_end_date")
    role = F.expr("if(source = 'task', stored_role, owner_current_role)")
    kinds = [
        ("activity", F.col("prospecting") & X.role_at_time(role, before, until, F.col("activitydate"), X.ACTIVITY_ROLES, inclusive=True)),
        ("call", F.col("spoken") & X.call_owner_qualifies(now, before, until, made)),
        ("disco", F.col("spoken") & X.role_in(now, X.DISCOVERY_OWNER_ROLES)),
        ("lead", F.expr("source = 'lead'"))]
    found = F.explode(F.array(*[F.when(test, F.lit(name)) for name, test in kinds]))
    j = j.select(found.alias("kind"), "id", "contact", "own_account", F.expr("createddate AS at"), "eligible", "mql",
                 F.expr("owner_current_role = 'BDA' AS sal"), "company_mail").where("kind IS NOT NULL")

    c = crm.pick("contact", "id", "accountid", "passed_sql").selectExpr("id AS known", "accountid AS contact_account", "passed_sql AS sql_ok")
    j = j.join(c, F.expr(f"{_key('', 'contact', 'id')} = known"), "left")
    wanted = "CASE WHEN kind = 'activity' THEN contact_account WHEN kind <> 'disco' THEN own_account END"
    a = crm.pick("account", "id", "self_service", *sets.reads).selectExpr("id AS account", "self_service", *sets.reads)
    j = j.join(a, F.expr(f"{_key('', wanted, 'id')} = account"), "left")
    j = j.where("(kind <> 'lead' OR self_service = false) AND (kind <> 'call' OR account IS NOT NULL)")
    return j.selectExpr("kind", "id", "contact", "known", "account", "contact_account", "at", "eligible", "mql", "sal", "sql_ok",
                        "sql_ok AND company_mail AS account_path_ok", f"{sets.own()} AS own")


def summaries(base: DataFrame, sets: Sets) -> DataFrame:
    """key (account or contact) and the sets of its leads (al; cq: those that count by account; cl: by contact) and
    activities (sa); ``touched``: the contact has an activity, ``placed``: one whose account is known."""
    none = "if(false, own, NULL)"
    by_account = f"""named_struct('key', 'A' || account, 'al', if(kind = 'lead', own, NULL), 'cq', if(kind = 'lead' AND account_path_ok, own, NULL),
        'sa', if(kind = 'activity', own, NULL), 'cl', {none}, 'touched', CAST(NULL AS boolean), 'placed', CAST(NULL AS boolean))"""
    by_contact = f"""named_struct('key', 'C' || if(kind = 'lead', contact, known), 'al', {none}, 'cq', {none}, 'sa', {none},
        'cl', if(kind = 'lead', own, NULL), 'touched', if(kind = 'activity', true, NULL), 'placed', if(kind = 'activity', account IS NOT NULL, NULL))"""
    rows = base.where("kind IN ('lead', 'activity')").selectExpr(f"inline(array({by_account}, {by_contact}))").where("key IS NOT NULL")
    gathered = [f"{sets.gather(c)} AS {c}" for c in ("al", "cq", "sa", "cl")]
    return rows.groupBy("key").agg(*[F.expr(g) for g in gathered], F.expr("bool_or(touched) AS touched"), F.expr("bool_or(placed) AS placed"))


def _looked_up(rows: DataFrame, table: DataFrame) -> DataFrame:
    table = table.withColumnRenamed("key", "_key")
    return rows.join(table, F.expr("key = _key"), "left").drop("_key")


def met(crm, window: DateWindow, base: DataFrame, known: DataFrame, sets: Sets) -> DataFrame:
    """Opportunities (all sales ones), contact roles of leads' contacts, and calls, each with its opportunity's own set ``so`` (null
    unless created in the window), ``slao``, ``sa``, and the sets of its calls ``sd`` and contact-path leads ``sl``."""
    calls = base.where("kind = 'call'").selectExpr("id AS call", "account AS firm", "at", "own AS dc", "known", "contact_account", f"{_key('C', 'known', 'id')} AS key")
    calls = _looked_up(calls, known.select("key", "touched", "placed")).selectExpr(
        "call", "firm", "at", "dc", "if(touched, known, NULL) AS call_contact", "if(touched AND placed, contact_account, NULL) AS call_account")
    reach = (sales_opps(crm, "opportunity_id", "account_id", "created_date").where(lookahead_range(window, F.col("created_date")))
             .selectExpr("opportunity_id AS opp", "account_id AS opp_account", "created_date"))
    calls = interval_join(calls, reach, left_key="firm", right_key="opp_account", left_ts="at", right_ts="created_date",
                          months=LOOKAHEAD_MONTHS, left_id="call")
    calls = calls.selectExpr("'call' AS kind", "opp", "call", "dc", "call_contact", "call_account")

    stages = stage_ids()
    names = list(STAGE_METRICS.values())
    renamed = {"segment": "account_segment", "vertical": "vertical"}
    columns = dict.fromkeys(["created_date", "account_id", "est_gmv", *[renamed[c] for c in sets.reads], *[c for n in names for c in stages[n][0]]])
    deals = sales_opps(crm, *columns).select("*", ts_window(window, F.col("created_date")).alias("inside"))
    deals = deals.select(
        F.expr("'deal' AS kind"), F.expr(f"{_key('A', 'account_id', 'opportunity_id')} AS key"), F.expr("opportunity_id AS opp"), F.expr("account_id AS firm"),
        F.expr(f"coalesce(est_gmv < {ACCOUNT_PATH_MAX_GMV}, false) AS capped"), F.expr(f"if(inside, {sets.own('account_segment')}, NULL) AS own"),
        *[F.when(F.col("inside"), stages[n][1]).alias(n) for n in names])
    roles = crm.opportunity_contact_role.where("contactid IS NOT NULL").selectExpr(
        "'role' AS kind", "'C' || contactid AS key", "opportunityid AS opp", "contactid AS role_contact")
    sides = _looked_up(deals.unionByName(roles, allowMissingColumns=True), known.select("key", "al", "cq", "sa", "cl"))
    sides = sides.where(f"kind = 'deal' OR {sets.some('cl')}").selectExpr(
        "kind", "opp", "firm", "role_contact", "if(kind = 'role', cl, NULL) AS cl", "if(kind = 'deal', cq, NULL) AS cq",
        f"kind = 'deal' AND capped AND {sets.some('al')} AS account_path", "own AS own_so", *names,
        f"if(own IS NULL, NULL, if(capped, {sets.side('al')}, {sets.none})) AS own_slao", f"if(own IS NULL, NULL, {sets.side('sa')}) AS own_sa")

    rows = sides.unionByName(calls, allowMissingColumns=True).selectExpr("*", f"{_key('', 'opp', 'call')} AS meet")
    over = " OVER (PARTITION BY meet)"
    rows = rows.selectExpr(
        "*", f"count_if(kind = 'deal'){over} AS times", *[f"max(own_{c}){over} AS {c}" for c in ("so", "slao", "sa")],
        f"{sets.gather('dc', over)} AS gathered_dc", f"{sets.gather('cl', over)} AS gathered_cl")
    return rows.selectExpr(
        "kind", "if(times > 1, raise_error('opportunity id is not unique: ' || opp), opp) AS opp", "firm", "role_contact", "cl", "cq", "dc", "account_path",
        "call", "call_contact", "call_account", *names, "so", "slao", "sa", "times = 1 AS is_sales",
        f"{sets.side('gathered_dc')} AS sd", f"{sets.side('gathered_cl')} AS sl")


def signals(together: DataFrame, known: DataFrame, sets: Sets) -> DataFrame:
    """key (account or contact), ``context``: what its opportunities let through to its activities or leads, ``alone``: whether an opportunity that
    a lead meets by this key was not created in the window (null: there is none), and the contact's leads ``heard``."""
    by_account = sets.context(sets.then("so", "sd", "sl", "slao"), sets.none)
    by_contact = sets.context(sets.then("so", "sd"), sets.then("slao", "sa"))
    rows = together.where("kind <> 'call'").selectExpr(
        "if(kind = 'deal', 'A' || firm, 'C' || role_contact) AS key",
        f"if(so IS NULL, NULL, if(kind = 'deal', {by_account}, {by_contact})) AS context",
        "if(kind = 'role' OR account_path, so IS NULL, NULL) AS alone").where("key IS NOT NULL AND (context IS NOT NULL OR alone IS NOT NULL)")
    heard = known.where(sets.some("cl")).select("key", "cl")
    return rows.unionByName(heard, allowMissingColumns=True).groupBy("key").agg(
        F.expr(f"{sets.gather('context')} AS context"), F.expr("bool_or(alone) AS alone"), F.expr(f"{sets.gather('cl')} AS heard"))


def _emit(df: DataFrame, sets: Sets, groups: dict[str, list[tuple[str, dict[str, str]]]]) -> DataFrame:
    """(label, metric, value) rows: for rows of each kind, groups of metrics for every label of a set.  A row of no metric keeps labels
    without ids."""
    def listed(metrics: dict[str, str]) -> str:
        ids = {"_present": "CAST(NULL AS STRING)", **metrics}
        return "array(" + ", ".join(f"named_struct('metric', '{n}', 'value', {c})" for n, c in ids.items()) + ")"

    def made(kind: str) -> str:
        return "array(" + ", ".join(f"named_struct('labels', {sets.labels(found)}, 'mv', {listed(metrics)})" for found, metrics in groups[kind]) + ")"

    rows = df.selectExpr("inline(CASE kind " + " ".join(f"WHEN '{kind}' THEN {made(kind)}" for kind in groups) + " END)").where("size(labels) > 0")
    return rows.selectExpr("explode(labels) AS label", "mv").selectExpr("label", "inline(mv)")


def counted_ids(crm, window: DateWindow, sets: Sets) -> DataFrame:
    """(label, metric, value) rows of every id of the funnel under every label that it reaches."""
    base = fixed(base_rows(crm, window, sets))
    known = fixed(summaries(base, sets))
    together = fixed(met(crm, window, base, known, sets))

    def chain(alone: str, *sides: str) -> str:
        return f"if(so IS NULL, {alone}, {sets.then('so', *sides)})"

    by_account = f"if(account_path AND {sets.some('cq')}, {chain('cq', 'sd', 'sl', 'cq', 'sa')}, {sets.empty})"
    direct = _emit(together, sets, {
        "deal": [(chain(sets.empty, "sd", "sl", "slao", "sa"), STAGE_METRICS), (by_account, {"all_leads_to_opps_artificially_high": "opp"})],
        "call": [(chain("dc", "dc", "sl", "slao", "sa"), {
            "all_discos": "call", "all_disco_to_opps": "opp", "all_account_with_disco": "call_account", "all_contacts_with_disco": "call_contact"})],
        # a role on another kind of opportunity stands alone, without an id to count
        "role": [(chain("cl", "sd", "cl", "slao", "sa"), {"all_leads_to_opps_artificially_low": "if(is_sales, opp, NULL)"})],
    })

    kept = ", ".join(f"'{c}', {c}" for c in ["id", "own", "account", "known", *LEAD_METRICS.values()])
    by_account = f"named_struct('key', {_key('A', 'account', 'id')}, 'kind', if(kind = 'lead', 'presence', kind), {kept})"
    by_contact = f"named_struct('key', {_key('C', 'if(kind = \'lead\', contact, known)', 'id')}, 'kind', kind, {kept})"
    rows = base.where("kind IN ('lead', 'activity') OR (kind = 'disco' AND known IS NOT NULL)").selectExpr(
        f"inline(CASE kind WHEN 'lead' THEN array({by_account}, {by_contact}) WHEN 'activity' THEN array({by_account}) ELSE array({by_contact}) END)")
    rows = _looked_up(rows, signals(together, known, sets))
    through, alone = sets.some("context"), "coalesce(alone, true)"

    def among(values: str) -> str:
        return sets.union(f"if({through}, {sets.within('context', values)}, NULL)", f"if({alone}, {values}, NULL)")

    looked = _emit(rows, sets, {
        "lead": [(among("own"), {name: f"if({flag}, id, NULL)" for name, flag in LEAD_METRICS.items()})],
        "presence": [(f"if({alone}, own, {sets.empty})", {})],
        # a discovery has the labels of the leads of its contact
        "disco": [(f"if({sets.some('heard')}, {among('heard')}, {sets.empty})", {"all_leads_to_disco_call": "id"})],
        "activity": [(f"if({through}, {sets.within('context', 'own')}, own)", {
            "all_activities": "id", "all_accounts_reached": "account", "all_contacts_reached": "known"})],
    })
    return direct.unionByName(looked)


def funnel_counts(crm, window: DateWindow, sets: Sets, label: str) -> DataFrame:
    """Distinct ids of each metric per label."""
    return pivot_distinct_counts(counted_ids(crm, window, sets).withColumnRenamed("label", label), label, FUNNEL_METRICS)


def full_funnel(crm, window: DateWindow) -> DataFrame:
    """Q6 (B7 + B8): distinct counts per account-based segment."""
    wide = funnel_counts(crm, window, SegmentSets(), "account_based_segment")
    return wide.selectExpr("*", "all_discos - all_leads_to_disco_call AS outbound_discos")


def vertical_funnel(crm, window: DateWindow) -> DataFrame:
    """Distinct counts per account-based vertical (P15): the first known vertical of opportunity, call, contact-path lead,
    account-path lead and activity, over the rows whose segment is kept."""
    return funnel_counts(crm, window, VerticalSets(), "account_based_vertical")
