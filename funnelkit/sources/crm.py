"""CRM-shaped views over the driver's TESTDATA tables.

The funnel reports read twelve CRM objects (task, event, user, userrole, lead,
contact, opportunity-contact role, account, the opportunity fact view, a
lead-source mapping, a territory deal mart and a calendar).  The test data is a
TPC-H-like star schema, so every CRM object is a deterministic projection of a
driver table.  Each projection is written once, as SQL expression text that both
Spark (``selectExpr`` / ``F.expr``) and DuckDB accept; the only dialect
difference is the timestamp type name (``{TS}``) and the calendar generator.
``load`` builds Spark DataFrames from it, ``oracle_ctes`` renders the same
projections as DuckDB CTE text for the oracle queries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pad(x: str) -> str:
    return f"lpad(cast({x} as string), 12, '0')"


def fiscal_year(d: str) -> str:
    # fiscal year starts on 1 July and is named after the calendar year it ends in
    return f"cast(year({d}) + CASE WHEN month({d}) >= 7 THEN 1 ELSE 0 END as int)"


def fiscal_quarter(d: str) -> str:
    return f"cast(floor(((month({d}) + 5) % 12) / 3) + 1 as int)"


def _case(key: str, values: list, otherwise: str = "NULL") -> str:
    branches = " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)
    )
    return f"CASE {key} {branches} ELSE {otherwise} END"


# --- fixed values --------------------------------------------------------------
# Role names the reports test for, plus one role no filter accepts.
ROLE_NAMES = ["BDA", "Account Executive", "Sales Manager, East", "Head of Sales", "Support"]
# Previous-role values a user may carry (by s_suppkey % 6; 4 and 5 mean none).
PREVIOUS_ROLES = ["BDA", "Account Executive", "Sales Manager", "Head of Sales"]
# Role stored on a task at the time it was logged.
TASK_ROLES = ["BDA", "Account Executive", "Regional Sales Manager", "Head of Sales", "Support", None]
# Customer market segment -> account segment.
ACCOUNT_SEGMENTS = {
    "BUILDING": "SMB",
    "AUTOMOBILE": "Key",
    "MACHINERY": "Enterprise",
    "HOUSEHOLD": "Self-Service",
}
# Revenue bands recorded on a lead (9 known, then NULL, then one the decoder does not know).
SALES_BANDS = [
    "$5M-20M", ">$75M", "$20M-75M", ">$100M", "$2M-5M", "$1M-2M",
    "$10M-25M", "$5M-10M", "$25M-100M", None, "Unknown",
]
# Lead sources carried by leads and contacts; the last entries are NULL.
LEAD_SOURCES = [
    "Paid Search", "Organic Search", "Display", "Email", "Field Event", "Paid Social",
    "Partner", "LinkedIn", "Webinar", "osa_outreach", "ZoomInfo", "Shopify",
    "Partnerco Referral", "Trade Show", "skift_b2b", "Google Natural Search", None, None,
]
LEAD_SOURCE_MAP = [
    ("Paid Search", "Paid"), ("Organic Search", "Organic"), ("Display", "Paid"),
    ("Email", "Marketing"), ("Field Event", "Events"), ("Paid Social", "Paid"),
    ("Partner", "Partner"), ("LinkedIn", "Social"), ("Webinar", "Events"),
    ("osa_outreach", "Outbound"), ("ZoomInfo", "Outbound"), ("Shopify", "Partner"),
]
EMAILS = ["gmail.com", "yahoo.com", "aol.com", "corp.example", "gmail.yahoo.aol.example", None, "internal.example"]
SUBJECTS = ["Discovery Call - intro", "In-Person Meeting", "<<auto>> sync", None, "Conference Meeting >> notes"]
ACTIVITY_TYPES = ["Outbound Call", "Outbound Email", "Linkedin", "Inbound"]
# -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Join:
    table: str
    alias: str
    on: str


@dataclass(frozen=True)
class View:
    base: str
    alias: str
    columns: list[tuple[str, str]]
    joins: list[Join] = field(default_factory=list)
    where: str | None = None
    copies: tuple[int, ...] | None = None  # UNION ALL of the projection with {K} = each copy


def _seg(c: str) -> str:
    branches = " ".join(f"WHEN {c}.c_mktsegment = '{k}' THEN '{v}'" for k, v in ACCOUNT_SEGMENTS.items())
    return f"CASE WHEN {c}.c_custkey % 23 = 0 THEN NULL {branches} ELSE 'N/A' END"


def _self_service(c: str) -> str:
    return f"CASE WHEN {c}.c_custkey % 11 = 0 THEN NULL ELSE {c}.c_custkey % 4 = 0 END"


def _source(key: str) -> str:
    return _case(f"({key}) % {len(LEAD_SOURCES)}", LEAD_SOURCES)


VIEWS: dict[str, View] = {
    "userrole": View("region", "r", [
        ("id", f"'00E' || {pad('r.r_regionkey')}"),
        ("name", _case("r.r_regionkey", ROLE_NAMES)),
    ]),
    "user": View("supplier", "s", [
        ("id", f"'005' || {pad('s.s_suppkey')}"),
        ("name", "s.s_name"),
        ("userroleid", f"CASE WHEN s.s_suppkey % 8 = 7 THEN NULL ELSE '00E' || {pad('s.s_suppkey % 5')} END"),
        ("previous_role", _case("s.s_suppkey % 6", PREVIOUS_ROLES)),
        ("previous_role_end_date",
         "CASE WHEN s.s_suppkey % 6 < 4 THEN DATE '1997-01-01' + cast((s.s_suppkey * 13) % 700 as int) END"),
    ]),
    "account": View("customer", "c", [
        ("id", f"'001' || {pad('c.c_custkey')}"),
        ("name", "c.c_name"),
        ("segment", _seg("c")),
        ("vertical", "n.n_name"),
        ("amount", "c.c_acctbal * 20000"),
        ("self_service", _self_service("c")),
    ], joins=[Join("nation", "n", "n.n_nationkey = c.c_nationkey")]),
    "contact": View("customer", "c", [
        ("id", f"'003' || {pad('2 * c.c_custkey + {K}')}"),
        ("accountid", f"CASE WHEN (2 * c.c_custkey + {{K}}) % 17 = 0 THEN NULL ELSE '001' || {pad('c.c_custkey')} END"),
        ("createddate",
         "cast(DATE '1995-01-01' + cast(c.c_custkey % 365 as int) as {TS}) + INTERVAL '1' SECOND * cast((c.c_custkey * 31 + {K}) % 86400 as int)"),
        ("passed_sql", "(c.c_custkey + {K}) % 3 = 0"),
        ("leadsource", _source("c.c_custkey * 5 + {K}")),
    ], copies=(0, 1)),
    # both contacts of the ordering customer hold a role on each opportunity
    "opportunity_contact_role": View("orders", "o", [
        ("contactid", f"'003' || {pad('2 * o.o_custkey + (o.o_orderkey + {K}) % 2')}"),
        ("opportunityid", f"'006' || {pad('o.o_orderkey')}"),
    ], copies=(0, 1)),
    "opportunity_fact": View("orders", "o", [
        ("opportunity_id", f"'006' || {pad('o.o_orderkey')}"),
        ("opportunity_name", "'Opportunity ' || cast(o.o_orderkey as string)"),
        ("account_id", f"'001' || {pad('o.o_custkey')}"),
        ("account_segment", f"CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE {_seg('c')} END"),
        ("account_tas", "CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE c.c_acctbal * 20000 END"),
        ("vertical", "n.n_name"),
        ("opportunity_amount", "o.o_totalprice * 5000"),
        ("est_gmv", "o.o_totalprice * 300"),
        ("stage", "CASE WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT' THEN 'Closed Won (Signed)' "
                  "WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '2-HIGH' THEN 'Closed Won' "
                  "WHEN o.o_orderstatus = 'F' THEN 'Closed Lost' "
                  "WHEN o.o_orderstatus = 'P' THEN 'Pre Opportunity' "
                  "WHEN o.o_orderkey % 3 = 0 THEN 'Negotiation' "
                  "WHEN o.o_orderkey % 3 = 1 THEN 'Discovery' ELSE 'Proposal' END"),
        ("created_date", "o.o_orderdate"),
        ("close_date", "o.o_orderdate + INTERVAL '1' DAY * cast(o.o_orderkey % 180 as int)"),
        ("launch_date", "CASE WHEN o.o_orderkey % 4 = 0 THEN cast(o.o_orderdate as date) + cast(o.o_orderkey % 180 as int) END"),
        ("capture_date", "CASE WHEN o.o_orderkey % 8 = 0 THEN cast(o.o_orderdate as date) + cast(o.o_orderkey % 200 as int) END"),
        ("opportunity_sales_flag", "o.o_orderkey % 10 <> 0"),
        ("self_service_flag", _self_service("c")),
        ("opportunity_owner", "'Rep ' || lpad(cast(o.o_custkey % 97 as string), 3, '0')"),
        ("opportunity_owner_role", "CASE WHEN (o.o_custkey % 97) % 5 = 0 THEN 'BDA' ELSE 'Account Executive' END"),
        ("opportunity_owner_segment", _case("(o.o_custkey % 97) % 4", ["Mid-Market", "Enterprise", "SMB"], "'N/A'")),
        ("opportunity_supporter_role", _case("o.o_orderkey % 5", ["BDA", "Account Executive"])),
        ("opportunity_supporter_previous_role", "CASE WHEN o.o_orderkey % 7 = 0 THEN 'BDA' END"),
        ("opportunity_supporter_previous_role_end_date",
         "CASE WHEN o.o_orderkey % 7 = 0 THEN DATE '1997-01-01' + cast((o.o_orderkey * 11) % 700 as int) END"),
        ("total_sales_cycle_days", "cast(o.o_orderkey % 180 as int)"),
        ("product_type", _case("o.o_orderkey % 6", ["Core", "Plus", "Core", "Launch"])),
        ("average_order_value", "cast(floor(o.o_totalprice / 100) as bigint)"),
        ("account_industry", "c.c_mktsegment"),
        ("opportunity_lead_source", _source("o.o_orderkey")),
        ("fiscal_quarter_name_create_date", "'Q' || cast(" + fiscal_quarter("o.o_orderdate") + " as string)"),
        ("fiscal_year_create_date", fiscal_year("o.o_orderdate")),
        ("fiscal_quarter_name_close_date",
         "'Q' || cast(" + fiscal_quarter("o.o_orderdate + INTERVAL '1' DAY * cast(o.o_orderkey % 180 as int)") + " as string)"),
        ("fiscal_year_close_date", fiscal_year("o.o_orderdate + INTERVAL '1' DAY * cast(o.o_orderkey % 180 as int)")),
    ], joins=[Join("customer", "c", "c.c_custkey = o.o_custkey"),
              Join("nation", "n", "n.n_nationkey = c.c_nationkey")]),
    "lead": View("part", "p", [
        ("id", f"'00Q' || {pad('p.p_partkey')}"),
        ("name", "p.p_name"),
        ("email", "CASE WHEN p.p_partkey % 7 = 5 THEN NULL ELSE 'lead' || cast(p.p_partkey as string) || '@' || "
                  + _case("p.p_partkey % 7", EMAILS) + " END"),
        ("createddate",
         "cast(DATE '1995-01-01' + cast((p.p_partkey * 37) % 2400 as int) as {TS}) + INTERVAL '1' SECOND * cast((p.p_partkey * 7919) % 86400 as int)"),
        ("marketing_qualified_date",
         "CASE WHEN p.p_partkey % 3 <> 0 THEN DATE '1995-01-01' + cast((p.p_partkey * 37) % 2400 + 10 as int) END"),
        ("annual_sales_band", _case("p.p_size % 11", SALES_BANDS)),
        ("eligibility_status", "CASE WHEN p.p_partkey % 7 <> 0 THEN 'Eligible' ELSE 'Ineligible' END"),
        ("passed_mql", "p.p_partkey % 3 <> 0"),
        ("leadsource", _source("cast(substr(p.p_brand, 7) as int) + p.p_partkey")),
        ("business_unit", "CASE WHEN p.p_partkey % 10 = 9 THEN 'CA' ELSE 'US' END"),
        ("purchase_path", "CASE WHEN p.p_partkey % 8 = 7 THEN 'Self Serve' WHEN p.p_partkey % 2 = 0 THEN 'Sales' ELSE 'sales' END"),
        ("ownerid", f"'005' || {pad('(p.p_partkey * 7) % 10')}"),
        ("convertedcontactid",
         f"CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE '003' || {pad('2 * cast(floor(p.p_partkey * 3 / 4) as bigint) + p.p_partkey % 2')} END"),
        ("convertedaccountid",
         f"CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE '001' || {pad('cast(floor(p.p_partkey * 3 / 4) as bigint)')} END"),
    ]),
    "territory_mart": View("lineitem", "l", [
        ("opportunity_id", f"'006' || {pad('l.l_orderkey')}"),
        ("opportunity_est_gmv_fy23", "l.l_extendedprice * 100"),
    ]),
}

# Tasks and events are both drawn from `events`: signups and purchases are
# calendar events, every other kind is a task.
_ACTIVITY_COMMON = [
    ("ownerid", f"CASE WHEN x.event_id % 29 = 0 THEN '005999999999999' ELSE '005' || {pad('(cast(floor(x.event_id / 5) as bigint) + x.user_id) % 10')} END"),
    ("activitydate", "DATE '1995-01-01' + cast((x.event_id * 37) % 2400 as int)"),
    ("subject", _case("x.event_id % 5", SUBJECTS)),
    ("type", _case("cast(floor(x.event_id / 3) as bigint) % 4", ACTIVITY_TYPES)),
    ("whoid", f"CASE WHEN x.event_id % 9 = 0 THEN '00Q' || {pad('x.event_id')} "
              f"WHEN x.event_id % 13 = 0 THEN NULL ELSE '003' || {pad('2 * x.user_id + x.event_id % 2')} END"),
    ("whatid", f"CASE x.event_id % 4 WHEN 0 THEN '006' || {pad('x.event_id')} "
               f"WHEN 1 THEN '001' || {pad('x.user_id')} WHEN 2 THEN NULL ELSE '701' || {pad('x.event_id')} END"),
]
VIEWS["task"] = View("events", "x", [
    ("id", f"'00T' || {pad('x.event_id')}"),
    ("ownerid", _ACTIVITY_COMMON[0][1]),
    ("owner_role", _case("cast(floor(x.event_id / 7) as bigint) % 6", TASK_ROLES)),
    *_ACTIVITY_COMMON[1:],
], where="x.event_type NOT IN ('signup', 'purchase')")
VIEWS["event"] = View("events", "x", [
    ("id", f"'00U' || {pad('x.event_id')}"),
    *_ACTIVITY_COMMON,
    ("createddate",
     "cast(DATE '1995-01-01' + cast((x.event_id * 37) % 2400 as int) as {TS}) + INTERVAL '1' SECOND * cast((x.event_id * 7919) % 86400 as int)"),
    ("accountid", f"'001' || {pad('x.user_id')}"),
], where="x.event_type IN ('signup', 'purchase')")

# One row a day over a stated reach; a date outside it is an error where it is looked up (``calendar_join``).
CALENDAR_FIRST, CALENDAR_LAST = "1900-01-01", "2199-12-31"
CALENDAR_COLUMNS = [
    ("date_key", "date_key"),
    ("fiscal_year", fiscal_year("date_key")),
    ("fiscal_quarter", fiscal_quarter("date_key")),
]

ALL_VIEWS = list(VIEWS) + ["calendar", "lead_source_map"]


def _render(expr: str, dialect: str, k: int | str | None = None) -> str:
    out = expr.replace("{TS}", "timestamp_ntz" if dialect == "spark" else "timestamp")
    if k is not None:
        out = out.replace("{K}", str(k))
    return out


# ---------------------------------------------------------------- Spark side


def _reads(text: str, alias: str) -> bool:
    return re.search(rf"\b{alias}\.", text) is not None


def needed_joins(v: View, columns: list[str]) -> list[Join]:
    """The lookups that the named columns (or lookups they need) read.

    A lookup is a left join on a primary key, so leaving out one that no column reads changes no row; Catalyst
    cannot drop it by itself because it does not know the key to be unique."""
    texts = [e for n, e in v.columns if n in columns] + ([v.where] if v.where else [])
    kept: list[Join] = []
    for j in reversed(v.joins):
        if any(_reads(t, j.alias) for t in texts):
            kept.insert(0, j)
            texts.append(j.on)
    return kept


def _spark_view(v: View, read, columns: list[str]) -> DataFrame:
    df = read(v.base).alias(v.alias)
    for j in needed_joins(v, columns):
        df = df.join(read(j.table).alias(j.alias), F.expr(j.on), "left")
    if v.where:
        df = df.where(F.expr(v.where))
    if v.copies:  # one scan, each row repeated per copy
        df = df.select("*", F.explode(F.array(*[F.lit(k) for k in v.copies])).alias("_copy"))
    return df.selectExpr(*[f"{_render(e, 'spark', '_copy')} AS {n}" for n, e in v.columns if n in columns])


def calendar(spark: SparkSession) -> DataFrame:
    """Day-grain calendar over the stated reach: a literal range, whose size the planner knows, and no scan of facts."""
    days = (date.fromisoformat(CALENDAR_LAST) - date.fromisoformat(CALENDAR_FIRST)).days + 1
    key = spark.range(days).selectExpr(f"DATE '{CALENDAR_FIRST}' + cast(id as int) AS date_key")
    return key.selectExpr(*[f"{e} AS {n}" for n, e in CALENDAR_COLUMNS])


def lead_source_map(spark: SparkSession) -> DataFrame:
    """The map as a literal relation: Spark knows its size and plans the lookup accordingly."""
    rows = ", ".join(f"('{a}', '{b}')" for a, b in LEAD_SOURCE_MAP)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS m(leadsource, lead_source_mapped)")


REQUIRED_COLUMNS = {name: [c for c, _ in v.columns] for name, v in VIEWS.items()}
REQUIRED_COLUMNS["calendar"] = [c for c, _ in CALENDAR_COLUMNS]
REQUIRED_COLUMNS["lead_source_map"] = ["leadsource", "lead_source_mapped"]


def from_tables(tables: dict[str, DataFrame]) -> SimpleNamespace:
    """CRM views from existing DataFrames (e.g. ``spark.table("crm.task")`` with renamed columns).

    Every view listed in ``REQUIRED_COLUMNS`` must be present with at least
    those columns; further columns (dimensions of the win-rate report, say) can be
    named in the reports and are pruned by Catalyst where they are not.
    """
    missing = {n: [c for c in cols if c not in tables[n].columns] if n in tables else ["<table>"]
               for n, cols in REQUIRED_COLUMNS.items()}
    missing = {n: m for n, m in missing.items() if m}
    if missing:
        raise ValueError(f"CRM tables missing columns: {missing}")
    wrong = [f"{n}.{c} is {dict(tables[n].dtypes)[c]}, not {' or '.join(TEMPORAL[c])}"
             for n, cols in REQUIRED_COLUMNS.items() for c in cols if c in TEMPORAL and dict(tables[n].dtypes)[c] not in TEMPORAL[c]]
    if wrong:
        raise ValueError(f"CRM columns of the wrong type: {wrong}")
    return GivenViews(tables)


# Types that the date predicates compare with; a string or number there would be cast without a word.
_TIMES = ("timestamp", "timestamp_ntz")
TEMPORAL = {"createddate": _TIMES, "created_date": _TIMES, "close_date": _TIMES, "activitydate": ("date",), "date_key": ("date",)}


class GivenViews:
    """CRM views over given DataFrames, with all their columns."""

    def __init__(self, tables: dict[str, DataFrame]):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return self._tables[name]

    def pick(self, name: str, *columns: str) -> DataFrame:
        return self._tables[name].select(*columns)


class CrmViews:
    """CRM views built on first access (a report touching two views reads two tables)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._views:
            if name == "calendar":
                self._views[name] = calendar(self._spark)
            elif name == "lead_source_map":
                self._views[name] = lead_source_map(self._spark)
            elif name in VIEWS:
                self._views[name] = self.pick(name, *REQUIRED_COLUMNS[name])
            else:
                raise AttributeError(name)
        return self._views[name]

    def pick(self, name: str, *columns: str) -> DataFrame:
        """Named columns of a view, with only the lookups that they read."""
        unknown = set(columns) - set(REQUIRED_COLUMNS[name])
        if unknown:
            raise ValueError(f"{name} has no {sorted(unknown)}")
        return _spark_view(VIEWS[name], self._read, list(columns)).select(*columns)


def load(spark: SparkSession, sf_dir: str) -> CrmViews:
    """All CRM views over the driver tables in ``sf_dir``, as lazily built DataFrames."""
    return CrmViews(spark, sf_dir)


# ---------------------------------------------------------------- DuckDB side


def _duck_view(v: View) -> str:
    selects = []
    for k in v.copies or (None,):
        cols = ", ".join(f"{_render(e, 'duckdb', k)} AS {n}" for n, e in v.columns)
        sql = f"SELECT {cols} FROM {v.base} {v.alias}"
        for j in v.joins:
            sql += f" LEFT JOIN {j.table} {j.alias} ON {j.on}"
        if v.where:
            sql += f" WHERE {v.where}"
        selects.append(sql)
    return " UNION ALL ".join(selects)


def _duck_sql(name: str) -> str:
    if name == "calendar":
        cols = ", ".join(f"{e} AS {n}" for n, e in CALENDAR_COLUMNS)
        return (f"SELECT {cols} FROM (SELECT cast(unnest(range(TIMESTAMP '{CALENDAR_FIRST}', TIMESTAMP '{CALENDAR_LAST}' + INTERVAL 1 DAY, "
                f"INTERVAL 1 DAY)) AS date) AS date_key)")
    if name == "lead_source_map":
        rows = ", ".join(f"('{a}', '{b}')" for a, b in LEAD_SOURCE_MAP)
        return f"SELECT * FROM (VALUES {rows}) AS m(leadsource, lead_source_mapped)"
    return _duck_view(VIEWS[name])


def oracle_ctes(names: list[str]) -> str:
    """`WITH`-list text (without the keyword) defining the named CRM views for DuckDB.

    CRM names are prefixed ``crm_`` so they never clash with the driver's views.
    """
    return ",\n".join(f"crm_{n} AS ({_duck_sql(n)})" for n in names)
