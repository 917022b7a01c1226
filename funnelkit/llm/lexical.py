"""Ranked lexical search by presence masks.

The items are the stated query set.  One pass over the texts keeps, for each document, its number of
terms and how often it holds each term of the items; counts over all documents give the weights.  The
kept rows are then ranked block by block, one block an Arrow batch.  For an item, the bit rows of its terms
are laid side by side and the documents of the block grouped by their mask of matched terms.  A mask
has a highest possible score: for each of its terms, the largest share any document of the block gets from it.
Masks are evaluated by descending highest score, all their documents exactly, until the next
mask cannot reach the item's last kept place.  A task keeps its best places from block to block, so later blocks
stop sooner.  The best of the tasks meet in two steps, a salt first, so no item gathers all tasks at once.

Ties go by ascending doc_id, a null doc_id last.  Null texts and texts without a term are no documents (they count nowhere)
and null items, or items without a term, have no rows.  Repeated rows are ranked each; equal rows of items count
once, and different texts of one item id are items of their own.  Empty tables give no rows.

The items go to the tasks in parts of ``PART_BYTES`` at most, one part after another: a larger set
of items costs more passes, not more memory.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelkit.llm.decontam import words
from funnelkit.llm.shared import written

TOP = 20
PART_BYTES = 4 << 20
#: Documents that are scored together, at least, where more masks are left.
CHUNK = 256
SALTS = 64
LAST = (1 << 63) - 1

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"
Item = list[tuple[int, int]]


def item_terms(text: str | None) -> Counter[bytes]:
    return Counter(words((text or "").encode()))


def _postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats) and the counts of the numbered terms, of documents with a term."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)  # PART_BYTES bounds it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            sizes, terms, counts, keep = [], [], [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                found = words(text or b"")
                if not found:
                    continue
                tf = Counter(map(number, found))
                tf.pop(None, None)
                keep.append(k)
                sizes.append(len(found))
                terms.append(list(tf))
                counts.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keep, pa.int32())), pa.array(sizes, pa.int64()),
                pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, POSTINGS)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Block:
    """Postings of some documents, by document and by term."""

    def __init__(self, doc_ids: pa.Array, n: np.ndarray, lists: pa.ListArray, counts: pa.ListArray, documents: int, length: int):
        self.missing = doc_ids.is_null().to_numpy(zero_copy_only=False)
        self.doc_ids = doc_ids.fill_null(LAST).to_numpy()
        self.starts = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        self.terms = lists.flatten().to_numpy()
        tf = counts.flatten().to_numpy().astype(np.int64)
        self.size = len(self.doc_ids)
        owner = np.repeat(np.arange(self.size), np.diff(self.starts))
        m = 100 - 25 + (25 * n * documents) // length
        self.shares = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
        by_term = np.argsort(self.terms, kind="stable")
        self.rows = owner[by_term]
        self.by_term_shares = self.shares[by_term]
        self.places = np.searchsorted(self.terms[by_term], np.arange((self.terms.max() if len(self.terms) else 0) + 2))

    def of(self, term: int) -> slice:
        """Places of a term's postings in ``rows``."""
        if term + 1 >= len(self.places):
            return slice(0, 0)
        return slice(self.places[term], self.places[term + 1])

    def masks(self, item: Item) -> tuple[np.ndarray, np.ndarray]:
        """Per document the presence bits of the item's terms, and the largest share of each term."""
        bits = np.zeros((self.size, -(-len(item) // 64)), np.uint64)
        largest = np.zeros(len(item), np.int64)
        for k, (term, _) in enumerate(item):
            at = self.of(term)
            if at.start < at.stop:
                bits[self.rows[at], k >> 6] |= np.uint64(1 << (k & 63))
                largest[k] = self.by_term_shares[at].max()
        return bits, largest

    def scores(self, docs: np.ndarray, gains: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``gains`` is the weight of each term in the item, 0 for others."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        total = np.concatenate([[0], np.cumsum(gains[self.terms[at]] * self.shares[at])])
        return total[ends] - total[ends - sizes]


class Best:
    """The best documents of an item so far: highest score, then smallest doc_id."""

    def __init__(self, top: int):
        self.top, self.score, self.doc, self.missing = top, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def limit(self) -> int:
        """A score that no kept place is below; less than it cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        hit = score >= self.limit()
        score, doc, missing = (np.concatenate(x) for x in ((self.score, score[hit]), (self.doc, doc[hit]), (self.missing, missing[hit])))
        order = np.lexsort((missing, doc, -score))[: self.top]
        self.score, self.doc, self.missing = score[order], doc[order], missing[order]


def search(block: Block, item: Item, weights: np.ndarray, gains: np.ndarray, best: Best, chunk: int = CHUNK) -> int:
    """Take the block's documents into ``best``; the number of documents scored.  ``gains`` is all zero, and is again afterwards."""
    bits, largest = block.masks(item)
    matched = np.flatnonzero(bits.any(axis=1))
    if not len(matched):
        return 0
    rows = bits[matched]
    keys = rows[:, 0] if rows.shape[1] == 1 else np.ascontiguousarray(rows).view(f"V{8 * rows.shape[1]}")[:, 0]
    order = np.argsort(keys, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (sorted_rows[1:] != sorted_rows[:-1]).any(axis=1)]))
    sizes = np.diff(np.append(first, len(order)))
    terms = np.array([t for t, _ in item])
    gain = np.array([q for _, q in item], np.int64) * weights[terms]
    present = np.unpackbits(sorted_rows[first].astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, : len(item)]
    highest = present.astype(np.int64) @ (gain * largest)
    descending = np.argsort(-highest, kind="stable")
    gains[terms] = gain
    at, scored = 0, 0
    while at < len(descending) and highest[descending[at]] >= best.limit():
        # masks that may still enter, until there are enough documents for one step
        enough = at + 1 + int(np.searchsorted(np.cumsum(sizes[descending[at:]]), chunk))
        able = at + int(np.searchsorted(-highest[descending[at:]], -best.limit(), side="right"))
        group = descending[at: min(enough, able)]
        docs = matched[order[np.concatenate([np.arange(first[g], first[g] + sizes[g]) for g in group])]]
        best.add(block.scores(docs, gains), block.doc_ids[docs], block.missing[docs])
        at, scored = at + len(group), scored + len(docs)
    gains[terms] = 0
    return scored


def _ranked(postings: DataFrame, items: list[Item], top: int) -> DataFrame:
    """item, doc_id, score: each task's best documents of each item."""
    spark = postings.sparkSession
    documents, length = postings.agg(F.count("*"), F.sum("n")).first()
    holding = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most one row a term of the items
    weights = np.zeros(1 + max((t for item in items for t, _ in item), default=0), np.int64)
    for row in holding:
        weights[row.term] = weight(documents, row["count"])
    known = spark.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, gain = known.value
        gains, best = np.zeros(len(gain), np.int64), [Best(top) for _ in asked]
        for batch in batches:
            if batch.num_rows:
                block = Block(batch.column(0), batch.column(1).to_numpy(), batch.column(2), batch.column(3), documents, length)
                for item, kept in zip(asked, best):
                    search(block, item, gain, gains, kept)
        sizes = [len(b.score) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()),
                pa.array(np.concatenate([b.doc for b in best]), pa.int64(), mask=np.concatenate([b.missing for b in best])),
                pa.array(np.concatenate([b.score for b in best]), pa.int64())], ["item", "doc_id", "score"])

    return postings.mapInArrow(run, FOUND)


def _first(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _part(docs: DataFrame, items: list[tuple[int, str]], top: int) -> DataFrame:
    spark = docs.sparkSession
    counted = [(name, terms) for name, text in items if (terms := item_terms(text))]
    numbers = {t: k for k, t in enumerate(sorted(set().union(*(terms for _, terms in counted))))}
    asked = [[(numbers[t], q) for t, q in terms.items()] for _, terms in counted]
    found = _ranked(written(_postings(docs, numbers), "postings", compression="zstd"), asked, top)
    salted = _first(found.withColumn("salt", F.spark_partition_id() % SALTS), ["item", "salt"], top).drop("rank")
    names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(counted)], "item int, item_id long")
    return _first(salted, ["item"], top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search_all(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (int, from 1), doc_id and score (long): the ``top`` best documents of each item, scores above 0."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // (PART_BYTES // 2)) or 1
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    parts = []
    for k in range(count):
        rows = dealt.filter(F.col("part") == k).orderBy(F.col("item_id").asc_nulls_last(), "text").collect()  # about PART_BYTES / 2
        found = _part(docs, [(r.item_id, r.text) for r in rows], top)
        parts.append(found if count == 1 else written(found, "ranked"))  # a part is done before the next one's terms are sent
    return reduce(DataFrame.unionByName, parts)
