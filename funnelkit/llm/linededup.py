"""Line deduplication over overlapping three-line windows.

A text's lines are its ``\\n``-parts; lines compare without the blanks around them, and lines of
blanks only take no part in windows.  Each three consecutive lines form a window, known by two
64-bit hashes.  Windows are ordered by (doc_id with nulls last, text hash, position).  All
occurrences of a window but its first cover their lines; a document loses its covered lines, each
once, however many windows cover it.  Blank lines go with the line before them.  A line is thus
removed only if the same line, among the same neighbours, stands earlier.

Rows with equal doc_id and equal text are one document: they share one decision and each row
stays.  Null texts stay null, texts of fewer than three lines stay as they are.

Scale: one partial aggregation finds each repeated window's first place, one join against it
finds the later ones (both sides sort-merge, so a hot window is split by AQE), and what travels a
second time is covered positions only.  The texts themselves move once, in the last join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelkit.llm.shared import BLANKS, text_key

WINDOW = 3


def _rolled(hashes: Column, size: int) -> Column:
    """Hash of each ``size`` consecutive elements of an array that has ``size`` at least."""
    out = hashes
    for k in range(1, size):
        out = F.zip_with(F.slice(out, 1, F.size(hashes) - k), F.slice(hashes, k + 1, F.size(hashes) - k),
                         lambda a, b: F.xxhash64(a, b))
    return out


def _solid(text: Column) -> Column:
    """The lines with a visible character, without the blanks around them."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, f"^{BLANKS}+|{BLANKS}+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, at (index among the solid lines), h1, h2: a row per window."""
    lines = docs.filter(F.col("text").contains("\n")).select(
        "doc_id", text_key(F.col("text")).alias("text_key"), _solid(F.col("text")).alias("lines"))
    lines = lines.filter(F.size("lines") >= window)
    hashed = lines.select(
        "doc_id", "text_key",
        _rolled(F.transform("lines", lambda x: F.xxhash64(x)), window).alias("h1"),
        _rolled(F.transform("lines", lambda x: F.xxhash64(F.lit(7), x)), window).alias("h2"))
    return hashed.select("doc_id", "text_key", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h")).select(
        "doc_id", "text_key", "at", "h.h1", "h.h2")


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, starts: the windows of each document that stand earlier elsewhere."""
    found = windows(docs, window)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "at")
    firsts = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.filter(F.col("first") != F.col("last")).select("h1", "h2", "first")
    later = found.join(firsts, ["h1", "h2"]).filter(place != F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def _gone(starts: Column, window: int) -> Column:
    """The covered line indexes, each once and ascending, of windows that begin at sorted ``starts``."""
    after = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.element_at(starts, -1) + window))
    return F.flatten(F.zip_with(starts, after, lambda a, b: F.sequence(a, a + F.least(F.lit(window), b - a) - 1)))


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without the solid lines at the given indexes, and without blank lines that follow one."""
    out = []
    for text, numbers in zip(texts.to_pylist(), gone.to_pylist()):
        if text is None or numbers is None:
            out.append(text)
            continue
        drop, at, kept, keeping = set(numbers), -1, [], True
        for line in text.split("\n"):
            if line.strip(" \t\n\x0b\x0c\r"):
                at += 1
                keeping = at not in drop
            if keeping:
                kept.append(line)
        out.append("\n".join(kept))
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` as struct ``row``, with ``text`` (what stays), ``n_lines`` and ``n_removed``
    (lines with a visible character, before and gone)."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("old"),
                       text_key(F.col("text")).alias("key"))
    gone = covered(docs.select("doc_id", "text"), window).select(
        F.col("doc_id").alias("cid"), F.col("text_key").alias("ckey"), _gone(F.col("starts"), window).alias("gone"))
    joined = rows.join(gone, F.col("id").eqNullSafe(F.col("cid")) & (F.col("key") == F.col("ckey")), "left")
    # only texts that lose lines are handed to Python
    cut = joined.withColumn("cut", _cut(F.when(F.col("gone").isNotNull(), F.col("old")), F.col("gone")))
    return cut.select(
        "row", F.when(F.col("gone").isNull(), F.col("old")).otherwise(F.col("cut")).alias("text"),
        F.when(F.col("old").isNull(), 0).otherwise(F.size(_solid(F.col("old")))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
