"""Spans of patterns in texts, by DataFrame functions alone.

Spark gives a pattern's matches and the parts between them, but no positions.  A match starts where the
lengths of all earlier parts and matches end, so positions are running sums over (part, match) rows.  Only
texts with a match make rows, and a text's rows meet in one window per kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "text_key"]


def matches(texts: DataFrame, kinds: list[tuple[str, str]]) -> DataFrame:
    """doc_id, text_key, kind, start, end (code points, end exclusive) and value of every leftmost
    non-overlapping match of each (kind, pattern) in ``texts`` (doc_id, text_key, text).

    Rows with equal doc_id and text_key hold one text and count once."""
    found = texts.select(*KEY, F.explode(F.array(*[
        F.when(F.col("text").rlike(pattern), F.struct(
            F.lit(kind).alias("kind"),
            F.transform(F.split("text", pattern, -1), lambda part: F.char_length(part)).alias("gaps"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("values")))
        for kind, pattern in kinds])).alias("m")).filter("m is not null")
    rows = found.select(*KEY, "m.kind", F.posexplode(F.arrays_zip("m.gaps", "m.values")).alias("at", "p"))
    rows = rows.select(*KEY, "kind", "at", F.col("p.gaps").alias("gap"), F.col("p.values").alias("value")).filter("value is not null")
    rows = rows.dropDuplicates([*KEY, "kind", "at"])
    before = Window.partitionBy(*KEY, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.char_length("value")).cast("long")).over(before)
    return rows.select(*KEY, "kind", "value", end.alias("end")).select(
        *KEY, "kind", (F.col("end") - F.char_length("value")).alias("start"), "end", "value")


def rank(kind: Column, order: list[str]) -> Column:
    """A kind's place among the listed kinds."""
    return F.array_position(F.array(*[F.lit(k) for k in order]), kind).cast("int")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted structs (start, rank, end, kind), comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def collected(spans: DataFrame, order: list[str], *more: Column) -> DataFrame:
    """One row a document: ``list`` (its spans sorted by start, then kind as listed) and further aggregates."""
    one = F.struct("start", rank(F.col("kind"), order).alias("rank"), "end", "kind")
    return spans.groupBy(*KEY).agg(F.sort_array(F.collect_set(one)).alias("list"), *more)
