"""Secret scan with corpus-wide ownership frequency.

Base spans: assignments to credential names, access keys and long hexadecimal runs.  Besides them any
long mixed token is a candidate.  Every candidate value is hashed and counted over the corpus by distinct
repositories (documents) and distinct owners (``source``): every row and every owner counts, those of copied
texts too.  A value that several owners hold, or that
stands in many repositories, is a widely copied example; one that a single owner holds in few
repositories looks live.  Candidates that look live are added as spans of kind ``token``; base spans
always stay.  ``n_live`` and ``n_copied`` count a document's base and added spans by that verdict.

All of it is DataFrame expressions.  Values travel as two 64-bit hashes.  Counting goes by (value, owner)
first and value second, each with partial aggregation, so a value that a third of all rows hold is no hot
group.

Null texts are empty.  Null and empty owners are one owner of their own.  Rows with equal doc_id and equal text get the
same result; each is a repository.  Texts without a candidate have no
spans.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.shared import text_key
from funnelkit.llm.spans import KEY, collected, joined, matches

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = [
    ("assign", ASSIGN),
    ("access", "AKIA[A-Z0-9]{16,}"),
    ("hex", "[0-9a-f]{24,}"),
    ("token", r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{20,}+"),
]
KINDS = [k for k, _ in PATTERNS]
MAX_OWNERS = 1
MAX_REPOSITORIES = 5
MIN_DISTINCT = 10


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, owner, kind, start, end, h1, h2: base spans and further candidates."""
    texts = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    found = matches(texts, PATTERNS)
    value = F.when(F.col("kind") == "assign", F.regexp_extract("value", ASSIGN, 1)).otherwise(F.col("value"))
    found = found.withColumn("value", value).filter("kind <> 'assign' or char_length(value) >= 6")
    mixed = (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
             & (F.size(F.array_distinct(F.split("value", ""))) >= MIN_DISTINCT))
    found = found.filter((F.col("kind") != "token") | mixed)
    return found.select(*KEY, "kind", "start", "end", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(7), "value").alias("h2"))


def ownership(found: DataFrame, owners: DataFrame) -> DataFrame:
    """h1, h2, n_owners, n_repositories of every value; ``owners``: doc_id, text_key, owner and its number n of rows."""
    held = found.select(*KEY, "h1", "h2").distinct().alias("f").join(
        owners.alias("o"), F.col("f.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("f.text_key") == F.col("o.text_key")))
    by_owner = held.select("h1", "h2", "owner", "n").groupBy("h1", "h2", "owner").agg(F.sum("n").alias("n"))
    return by_owner.groupBy("h1", "h2").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied for each row of ``docs``."""
    found = candidates(docs)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.coalesce("source", F.lit("")).alias("owner"))
    counts = ownership(found, rows.groupBy(*KEY, "owner").agg(F.count("*").alias("n")))
    live = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repositories") <= MAX_REPOSITORIES)
    judged = found.join(counts, ["h1", "h2"]).withColumn("live", live).filter("kind <> 'token' or live")
    each = collected(judged, KINDS, *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in KINDS[:3]],
                     F.collect_set(F.when(F.col("kind") != "token", F.struct("start", "end"))).alias("base"),
                     F.collect_set(F.when(F.col("live"), F.struct("start", "end", "kind"))).alias("alive"))
    # an added span never overlaps a base span
    each = each.withColumn("list", F.expr(
        "filter(list, s -> s.kind <> 'token' or not exists(base, b -> b.start < s.end and s.start < b.end))"))
    each = each.select(*KEY, *[f"n_{k}" for k in KINDS[:3]], F.filter("list", lambda s: s["kind"] != "token").alias("own"), "list",
                       F.expr("size(filter(list, s -> array_contains(alive, struct(s.start, s.end, s.kind))))").cast("long").alias("n_live"))
    each = each.select(*KEY, *[f"n_{k}" for k in KINDS[:3]], joined(F.col("own")).alias("own"), joined(F.col("list")).alias("spans"),
                       "n_live", (F.size("list") - F.col("n_live")).cast("long").alias("n_copied"))
    out = rows.alias("r").join(each.alias("e"), F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("r.text_key") == F.col("e.text_key")), "left")
    none = F.lit(0).cast("long")
    return out.select(
        "r.doc_id", *[F.coalesce(f"e.n_{k}", none).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.coalesce("e.own", F.lit("")), 256).alias("base_sha256"), F.coalesce("e.spans", F.lit("")).alias("spans"),
        F.coalesce("e.n_live", none).alias("n_live"), F.coalesce("e.n_copied", none).alias("n_copied"))
