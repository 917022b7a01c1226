"""Column builders for the funnel's row-level logic.

Everything here returns a ``pyspark.sql.Column`` built from built-in functions,
so it stays inside whole-stage codegen; there is no Python UDF anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------
# CRM id prefixes (first three characters of an id) and their labels.
ACCOUNT_PREFIX = "001"
CONTACT_PREFIX = "003"
OPPORTUNITY_PREFIX = "006"
LEAD_PREFIX = "00Q"
WHAT_ID_LABELS = [("001", "ACCOUNT_ID"), ("006", "OPPORTUNITY_ID")]
WHO_ID_LABELS = [("003", "CONTACT_ID"), ("00Q", "LEAD_ID")]

# Website revenue band on a lead -> estimated annual sales (checked in this order;
# NULL stays NULL, any other value becomes 0).
REVENUE_BANDS = [
    ("$5M-20M", 10000000),
    (">$75M", 100000000),
    ("$20M-75M", 50000000),
    (None, None),
    (">$100M", 105000000),
    ("$2M-5M", 3000000),
    ("$1M-2M", 2000000),
    ("$10M-25M", 15000000),
    ("$5M-10M", 7500000),
    ("$25M-100M", 75000000),
]

# Lead source -> condensed marketing channel (first match wins, else 'Other').
# The reference lists the company's own e-mail campaign source by its brand
# name; it is neutralised to 'house_email' here.
SOURCE_CONDENSED = [
    (["Paid Search", "Paid Blended"], "Paid Search"),
    (["Direct traffic", "Organic Search", "Google Natural Search"], "Organic"),
    (["Display", "skift_b2b", "sharma_b2b"], "Display"),
    (["Email", "house_email"], "Email"),
    (["Field Event"], "Field Event"),
    (["Paid Social", "linkedin_b2b"], "Paid Social"),
    (["Partner"], "Partner"),
    (["LinkedIn", "Facebook"], "Organic Social"),
    (["Webinar"], "Webinar"),
    (["osa_outreach"], "Manually sourced"),
    (["ZoomInfo"], "ZoomInfo"),
    (["Shopify"], "Shopify"),
]

# Calendar-event subjects that mark a discovery call.
DISCOVERY_SUBJECTS = ["%Discovery call%", "%Conference Meeting%", "%In-Person Meeting%"]
# Activity types counted as outbound prospecting.
OUTBOUND_TYPES = ["Linkedin", "Outbound Call", "Outbound Email"]
# Free-mail domains whose leads are not credited with account-path conversions.
FREE_MAIL_PATTERNS = ["%yahoo%", "%aol%", "%gmail%"]
FREE_MAIL_EXACT = ["yahoo", "aol", "gmail"]
# Opportunity stages for the win-rate report.
WON_STAGES = ["Closed Won (Signed)", "Closed Won"]
LOST_STAGES = ["Closed Lost"]
PRE_OPPORTUNITY_STAGES = ["Pre Opportunity"]
OPEN_STAGES = ["Product Decision", "Pre Opportunity", "Discovery", "Negotiation", "Proposal", "Verbal Commit"]
# Segments kept by the funnel.
FUNNEL_SEGMENTS = ["SMB", "Key", "Self-Service", "Enterprise"]
# -------------------------------------------------------------------------------

# Role matchers: ("eq", value) is equality, ("like", pattern) case-sensitive LIKE,
# ("ilike", pattern) case-insensitive LIKE.
ACTIVITY_ROLES = [("eq", "BDA"), ("eq", "Account Executive"), ("like", "%Sales Manager%"),
                  ("eq", "Head of Sales"), ("eq", "BDA Manager")]
DISCOVERY_OWNER_ROLES = [("eq", "BDA"), ("ilike", "%account executive%"), ("like", "%Sales Manager%"),
                         ("eq", "Head of Sales"), ("eq", "BDA Manager")]
DISCOVERY_OWNER_ROLES_NARROW = [("eq", "BDA"), ("ilike", "%account executive%")]
# Current-role and previous-role matchers for the discovery-call dataset.
CALL_CURRENT_ROLES = [("eq", "BDA"), ("ilike", "%account executive%"), ("like", "%Sales Manager%"),
                      ("eq", "Account Executive"), ("eq", "Sales Manager"), ("eq", "Head of Sales"),
                      ("eq", "BDA Manager")]
CALL_PREVIOUS_ROLES = [("eq", "Account Executive"), ("like", "%Sales Manager"), ("eq", "Sales Manager"),
                       ("eq", "Head of Sales"), ("eq", "BDA Manager")]


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def role_matches(col: Column, matcher: tuple[str, str]) -> Column:
    kind, value = matcher
    if kind == "eq":
        return col == F.lit(value)
    if kind == "like":
        return col.like(value)
    return col.ilike(value)


def role_in(col: Column, matchers: list[tuple[str, str]]) -> Column:
    """F16: role list filter without history (SQL three-valued OR)."""
    return any_of([role_matches(col, m) for m in matchers])


def role_at_time(role: Column, prev_role: Column, prev_end: Column, at: Column,
                 matchers: list[tuple[str, str]], inclusive: bool = True) -> Column:
    """the owner holds a role now, or held it before and `at` precedes the end date."""
    before = (at <= prev_end) if inclusive else (at < prev_end)
    return any_of([role_matches(role, m) | (role_matches(prev_role, m) & before) for m in matchers])


def call_owner_qualifies(role: Column, prev_role: Column, prev_end: Column, at: Column) -> Column:
    """F15 as used by the discovery-call dataset: current roles, or previous roles before the end date."""
    return role_in(role, CALL_CURRENT_ROLES) | any_of(
        [role_matches(prev_role, m) & (at < prev_end) for m in CALL_PREVIOUS_ROLES])


def ilike_any(col: Column, patterns: list[str]) -> Column:
    """case-insensitive contains, OR-ed."""
    return any_of([col.ilike(p) for p in patterns])


def free_mail_ok(email: Column, mode: str) -> Column:
    """P10 e-mail exclusion, three variants kept on purpose.

    * ``or``: ``NOT ILIKE a OR NOT ILIKE b OR NOT ILIKE c`` (drops only addresses matching all three)
    * ``and``: ``NOT ILIKE a AND ...`` (drops an address matching any)
    * ``exact``: the ``or`` form without wildcards (whole-string comparison)
    """
    if mode == "or":
        return any_of([~email.ilike(p) for p in FREE_MAIL_PATTERNS])
    if mode == "and":
        return all_of([~email.ilike(p) for p in FREE_MAIL_PATTERNS])
    return any_of([~email.ilike(p) for p in FREE_MAIL_EXACT])


def id_prefix(col: Column) -> Column:
    return F.left(col, F.lit(3))


def id_type(col: Column, labels: list[tuple[str, str]]) -> Column:
    """Classify an id by prefix, falling through to the raw id."""
    out = None
    for prefix, label in labels:
        cond = id_prefix(col) == F.lit(prefix)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(col)


def id_if_prefix(col: Column, prefix: str) -> Column:
    """Keep the id only when it carries the given prefix."""
    return F.when(id_prefix(col) == F.lit(prefix), col)


def revenue_band_value(band: Column) -> Column:
    """Decode a revenue band; NULL -> NULL, unknown -> 0 (bigint)."""
    out = None
    for label, value in REVENUE_BANDS:
        cond = band.isNull() if label is None else band == F.lit(label)
        val = F.lit(value).cast("bigint")
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(F.lit(0).cast("bigint"))


def segment_by_amount(amount: Column) -> Column:
    """Descending >= bands; below 5M gives NULL."""
    return (F.when(amount >= 1000000000, "Key")
            .when(amount >= 100000000, "Enterprise")
            .when(amount >= 5000000, "SMB"))


def segment_by_tas(tas: Column) -> Column:
    """Ascending bands with a gap: exactly 100M and NULL give OTHER."""
    return (F.when(tas < 5000000, "MSS")
            .when(tas < 100000000, "SMB")
            .when(tas > 100000000, "ENT")
            .otherwise("OTHER"))


def relabel(col: Column, source: str, target: str) -> Column:
    """One-label normalisation (e.g. Self-Service -> SMB)."""
    return F.when(col == F.lit(source), F.lit(target)).otherwise(col)


def source_condensed(source: Column) -> Column:
    """Condense a lead source to a channel."""
    out = None
    for values, label in SOURCE_CONDENSED:
        cond = source.isin(values)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit("Other"))


def dash_label(a: Column, b: Column) -> Column:
    """``a || '-' || b`` with NULL in -> NULL out."""
    return F.concat(a.cast("string"), F.lit("-"), b.cast("string"))


def id_when(cond: Column, id_col: Column) -> Column:
    """Stage-flag id projection."""
    return F.when(cond, id_col)
