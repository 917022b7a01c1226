"""SimHash near-duplicates by bit-sliced comparison.

A text's 64-bit fingerprint takes the majority, bit by bit, of the XXH64 values (seed 42) of its
word shingles.  Fingerprints within ``radius`` differing bits are linked; a component is what
links reach.

* Equal fingerprints are collapsed first, so copies cost one row, however many there are.
* Candidates: the 64 bits are cut into ``radius + 2`` blocks.  Two fingerprints within the radius
  agree on two blocks at least, so each pair of blocks is a key and no link is missed.
* Keys with more than ``GROUP`` fingerprints are dealt into sub-blocks, and each pair of
  sub-blocks is a task of its own, so no task holds an unbounded group and no pair is left out.
* Comparison: fingerprints stand as 64 bit planes (one word holds one bit of 64 fingerprints);
  carry-save counters add the differing bits of a plane to 64 distances at once.  A tile is cut into blocks of
  ``BLOCK``; each pair of blocks is compared once, a fingerprint's own lane and pairs already compared are
  masked, and the pair is abandoned as soon as every distance left in it exceeds the radius.
* A task returns the components of its tile as stars, never pairs, and alternating large and small
  stars join them over the cluster.  Nothing is collected.

Nulls and empty texts have no words: fingerprint zero, linked like any other.  A null doc_id never
names a component unless all its members' ids are null (then component_id is null).  Repeated rows
give one result row each.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.shared import partitions, text_key, written

SHINGLE = 4
RADIUS = 4
GROUP = 2048
TILE = 1024
BLOCK = 256
#: The members of a component are dealt into so many parts where they meet its least doc_id.
PARTS = 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends[: len(words) - shingle + 1] - [len(w) + 1 for w in words[: len(words) - shingle + 1]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    counts, values = np.zeros(64, np.int64), np.array(hashes, dtype="<u8")
    for k in range(0, len(values), 1 << 15):
        bits = np.unpackbits(values[k: k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed 64-bit number."""

    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            values = [fingerprint(t, shingle) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return fingerprints(text)


def planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of unsigned fingerprints, one bit a fingerprint, padded to whole words."""
    padded = np.zeros(-(-len(values) // 64) * 64, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(queries: np.ndarray, block: np.ndarray, n: int, radius: int = RADIUS, done: np.ndarray | None = None) -> np.ndarray | None:
    """Which of the ``n`` fingerprints in ``block`` (planes) are within the radius of each query.

    A saturating carry-save counter: ``counters[i]`` holds bit i of every distance; ``over`` has the
    lanes that passed the radius, from the start those of ``done`` (a row of lane words a query), which need no
    comparison.  None once every lane is over."""
    width = max(1, radius.bit_length())
    counters = [np.zeros((len(queries), block.shape[1]), dtype=np.uint64) for _ in range(width)]
    over = np.zeros_like(counters[0])
    tail = n % 64
    if tail:
        over[:, -1] = ~np.uint64((1 << tail) - 1)
    if done is not None:
        over |= done
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)
    bits = ((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)) * everything
    limit = [(radius >> i) & 1 for i in range(width)]
    for k in range(64):
        carry = block[k][None, :] ^ bits[:, k][:, None]
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if k >= radius and (k % 4 == 3 or k == 63):
            above, equal = np.zeros_like(over), np.full_like(over, everything)
            for i in reversed(range(width)):
                if limit[i]:
                    equal &= counters[i]
                else:
                    above |= equal & counters[i]
                    equal &= ~counters[i]
            over |= above
            if (over == everything).all():
                return None
    return np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def _own(n: int) -> np.ndarray:
    """Lane words of a block against itself: of each query, its own lane and the earlier ones."""
    lanes = np.zeros((n, -(-n // 64) * 64), np.uint8)
    lanes[:, :n] = np.tril(np.ones((n, n), np.uint8))
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def stars(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for every component of two fingerprints or more among ``values``."""
    values = np.unique(values)
    n = len(values)
    label = np.arange(n)
    blocks = [values[a: a + BLOCK] for a in range(0, n, BLOCK)]
    sliced = [planes(block) for block in blocks]
    left, right = [], []
    for x, queries in enumerate(blocks):
        for y in range(x, len(blocks)):
            hit = near(queries, sliced[y], len(blocks[y]), radius, _own(len(queries)) if x == y else None)
            if hit is not None:
                i, j = np.nonzero(hit)
                left.append(i + x * BLOCK)
                right.append(j + y * BLOCK)
    if not left:
        return values[:0], values[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    member = label != np.arange(n)
    return values[member], values[label[member]]


def _masks(blocks: int) -> list[int]:
    """One mask for each pair of blocks of the 64 bits, as signed numbers."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    each = [sum(1 << b for b in range(cuts[k], cuts[k + 1])) for k in range(blocks)]
    pairs = [each[a] | each[b] for a in range(blocks) for b in range(a + 1, blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in pairs]


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Stars (``a`` linked to ``b``) over the distinct values of column ``fp``."""
    masks = _masks(radius + 2)
    keyed = fingerprints.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "part"))
    groups = keyed.groupBy("band", "part").agg(F.count("*").alias("size")).filter("size > 1")
    shared = keyed.join(groups, ["band", "part"]).withColumn("cuts", F.ceil(F.col("size") / GROUP))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts"))
    dealt = shared.select("band", "part", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    dealt = dealt.select("band", "part", "fp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    key = ["band", "part", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _tiles(batches, len(key)):
            a, b = stars(values, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    ordered = dealt.repartition(partitions(fingerprints.sparkSession), *key).sortWithinPartitions(*key)
    return ordered.select(*key, "fp").mapInArrow(compare, "a long, b long").distinct()


def _tiles(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Fingerprints of whole groups in tiles of about TILE rows; rows come sorted by group."""
    held, fps = np.empty((0, keys), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        more = np.stack([batch.column(k).cast(pa.int64()).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        held = np.concatenate([held, more])
        fps = np.concatenate([fps, batch.column(keys).to_numpy(zero_copy_only=False).view(np.uint64)])
        ends = np.flatnonzero((held[1:] != held[:-1]).any(axis=1)) + 1
        at = 0
        while len(ends) and ends[-1] - at >= TILE:
            end = int(ends[np.searchsorted(ends, at + TILE)])
            yield fps[at:end]
            at = end
        held, fps = held[at:], fps[at:]
    if len(fps):
        yield fps


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots, each root the least of its
    component, by alternating large and small stars, each round written to the shared folder."""
    edges, before = written(edges.select("a", "b"), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(down, "a").select("b", "root", "a")
        small = small.select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(small.select("a", F.col("root").alias("b")))
        edges = written(small.filter("a <> b").distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key, fp, root, component_id: one row per row of ``docs``.

    ``root`` is the least fingerprint of the component; ``component_id`` its least doc_id."""
    rows = written(docs.select("doc_id", text_key(F.col("text")).alias("text_key"),
                               fingerprint_column(F.col("text"), shingle).alias("fp")), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(firsts.select("fp"), radius))
    nodes = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # a component may hold most fingerprints: its members meet the least doc_id in parts
    nodes = nodes.withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)))
    least = nodes.groupBy("root", "part").agg(F.min("first").alias("first"))
    least = least.groupBy("root").agg(F.min("first").alias("component_id"), F.collect_set("part").alias("parts"))
    least = least.select("root", "component_id", F.explode("parts").alias("part"))
    labels = written(nodes.join(least, ["root", "part"]).select("fp", "root", "component_id"), "components")
    return rows.join(labels, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` (all columns) that stay: one document of each component, the one with the
    least doc_id (nulls last), then the least text hash; of repeated rows, one."""
    found = near_duplicates(docs, shingle, radius)
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("keep"))
    keep = written(keep.select(*_who(F.col("keep.doc_id"), F.col("keep.text_key"))).distinct(), "kept")
    rows = docs.select(F.struct("*").alias("row"), *_who(F.col("doc_id"), text_key(F.col("text"))))
    # equal keys meet once: the semi-join and the choice among repeated rows use one dealing
    return rows.join(keep, ["none", "id", "key"], "left_semi").dropDuplicates(["none", "id", "key"]).select("row.*")


def _who(doc_id: Column, key: Column) -> list[Column]:
    """A document's key without nulls."""
    return [doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), key.alias("key")]
