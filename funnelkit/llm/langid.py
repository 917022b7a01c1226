"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter over the n-grams typical of it.  The filters are stored bit-sliced:
slot p of one table holds, as a bitmask, which languages have bit p set.  An n-gram's slots are ANDed,
which returns at once all languages whose filters contain it.  A text's n-grams are counted per
language, the counts are corrected for each filter's false positive rate, and the largest decides.

N-grams: 3 and 4 characters of the text with letters lower-cased and every other character as a gap.
Training reads a sample of at most ``SAMPLE`` documents a language in expectation (a document is in it if
its hash falls below the language's rate, so the sample does not depend on partitions or order) and keeps
for a language the n-grams that make up at least ``MIN_SHARE`` of its sample and at least ``MIN_RATIO`` of
the share in any other language.  At most 1 / MIN_SHARE n-grams of each size pass for a language, and the
table that reaches the driver has ``SLOTS`` rows at most, whatever the input.

Null texts and texts without a letter are ``und`` with score 0.  Rows with null lang or null text are not
learned from.  If no n-gram of a text is known, the most frequent learned language is given with score 0;
ties go to the first language by name.  If nothing can be learned every text is ``und``.  Repeated rows are
predicted alike; a null doc_id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 3000
SLOTS = 1 << 20
PROBES = 2
SIZES = (3, 4)
MIN_SHARE = 4e-6
MIN_RATIO = 0.25
UNKNOWN = "und"

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


class Filters(NamedTuple):
    """Languages, most frequent first, the bit-sliced table and each filter's false positive rate."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """Code point to lower-case letter, 0 for what is not a letter."""
    global _fold
    if _fold is None:
        _fold = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                _fold[c] = ord(low) if len(low) == 1 else c
    return _fold


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size, the n-grams of all texts as 64-bit hashes, and the text of each.

    Gaps are one wide, a gap stands on both sides of a text, and no n-gram spans two texts."""
    lengths = np.array([len(t) + 2 for t in texts])
    joined = "".join([f" {t} " for t in texts]).encode("utf-32-le", "surrogatepass")
    letters = _folding()[np.frombuffer(joined, "<u4")]
    owner = np.repeat(np.arange(len(texts)), lengths)
    keep = (letters > 0) | (np.diff(letters, prepend=1) != 0) | (np.diff(owner, prepend=-1) != 0)
    letters, owner = letters[keep].astype(np.uint64), owner[keep]
    value = letters
    for size in range(2, max(SIZES) + 1):
        value = value[:-1] * np.uint64(0x100000001B3) + letters[size - 1:]
        if size in SIZES:
            whole = owner[: len(value)] == owner[size - 1:]
            mixed = (value[whole] + np.uint64(size)) * np.uint64(0xD6E8FEB86659FD93)
            yield mixed ^ (mixed >> np.uint64(32)), owner[: len(value)][whole]


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    return [(hashes * m) >> shift for m in _MIX[:PROBES]]


def learn(docs: DataFrame) -> Filters:
    """Filters from the labelled rows of ``docs`` (doc_id, text, lang) that are not held out."""
    rows = docs.filter("text is not null and lang is not null").filter(~held_out(F.col("doc_id"))).select(
        "text", "lang", F.xxhash64("text").alias("key"))
    found = sorted(rows.select("lang", "key").distinct().groupBy("lang").count().collect(), key=lambda r: (-r["count"], r.lang))  # one row a language
    languages = [r.lang for r in found]
    if not found:
        return Filters([], np.zeros(SLOTS, np.uint8), np.zeros(0))
    place = {name: k for k, name in enumerate(languages)}
    rate = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(1.0, SAMPLE / r["count"]))]), F.col("lang"))
    sample = rows.filter(F.pmod("key", F.lit(1 << 20)) < rate * (1 << 20)).dropDuplicates(["lang", "key"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 256):
                for size, (hashes, owner) in zip(SIZES, grams(texts[a: a + 256])):
                    of = langs[a: a + 256][owner]
                    for k in np.unique(of):
                        value, n = np.unique(hashes[of == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(value), size, np.int32)), pa.array(np.full(len(value), k, np.int32)),
                            pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["size", "lang", "gram", "n"])

    counts = sample.select("text", "lang").mapInArrow(count, "size int, lang int, gram long, n long")
    counts = counts.groupBy("size", "lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("size", "lang").agg(F.sum("n").alias("total"))  # two rows a language
    shares = counts.join(totals, ["size", "lang"]).select("size", "gram", "lang", (F.col("n") / F.col("total")).alias("share"))
    top = shares.groupBy("size", "gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("each"))
    typical = top.select("gram", F.explode("each").alias("e"), "top").filter(
        (F.col("e.share") >= MIN_SHARE) & (F.col("e.share") >= F.col("top") * MIN_RATIO))

    words = -(-len(languages) // 63)

    def place_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                yield pa.RecordBatch.from_arrays([
                    pa.array(at.astype(np.int64)), pa.array((lang // 63).astype(np.int32)), pa.array(np.int64(1) << (lang % 63))],
                    ["slot", "word", "mask"])

    bits = typical.select("gram", "e.lang").mapInArrow(place_bits, "slot long, word int, mask long")
    filled = bits.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()  # SLOTS rows a 63 languages at most
    small = np.uint8 if len(languages) <= 8 else np.uint64
    table = np.zeros((SLOTS, words), small)
    table[filled["slot"].to_numpy(), filled["word"].to_numpy()] = filled["mask"].to_numpy().astype(small)
    fill = np.array([np.count_nonzero((table[:, k // 63] >> small(k % 63)) & small(1)) / SLOTS for k in range(len(languages))])
    return Filters(languages, table, fill ** PROBES)


def classify(filters: Filters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    n = len(filters.languages)
    if not n or not lettered.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    total, hits = np.zeros(len(texts)), np.zeros((len(texts), n))
    for hashes, owner in grams([t or "" for t in texts]):
        total += np.bincount(owner, minlength=len(texts))
        masks = filters.table[slots(hashes)[0]]
        for at in slots(hashes)[1:]:
            masks &= filters.table[at]
        for k in range(n):  # popcount of each language's bit
            has = (masks[:, k // 63] >> masks.dtype.type(k % 63)) & masks.dtype.type(1)
            hits[:, k] += np.bincount(owner, weights=has, minlength=len(texts))
    rate = filters.false_rate
    corrected = np.maximum((hits - total[:, None] * rate) / np.maximum(1 - rate, 1e-9), 0)
    names = sorted(range(n), key=filters.languages.__getitem__)
    best = np.array(names)[corrected[:, names].argmax(axis=1)]
    best = np.where(corrected.max(axis=1) > 0, best, 0)
    score = corrected.max(axis=1) / np.maximum(corrected.sum(axis=1), 1e-9)
    return ([filters.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only the text decides."""
    model = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = [], []
            for part in _parts(texts.to_pylist()):
                more, score = classify(model.value, part)
                names += more
                scores.append(score)
            flat = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(flat, pa.float64())], ["lang_pred", "score"])

    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), guess(F.col("text")).alias("g"))
    return found.select("doc_id", "held_out", "g.lang_pred", "g.score")


def _parts(texts: list[str | None], room: int = 1 << 18) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``room`` characters together, which bounds the arrays over them."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= room:
            yield part
            part, held = [], 0
    if part:
        yield part
