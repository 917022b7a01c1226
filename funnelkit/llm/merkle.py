"""Merkle dataset manifest kept as postorder append logs.

Each row of a table is a leaf; the leaves of one tree (one value of ``key``) stand in a fixed order, and
every two consecutive nodes of a level become their hash, the last one alone if their number is odd.  A
tree is cut into aligned blocks of ``2 ** BITS`` leaves.  A builder takes one block, appends its leaves in
order and, behind each, the nodes that this leaf completes; what it writes is one run of the tree's postorder
log.  The roots of the blocks are the leaves of the next layer, so a builder never holds more than
one block, however large a tree is, and the number of layers is the logarithm of the largest tree.  The
roots of the trees, ordered by key, are the leaves of one last tree in the same way.

Nobody searches a log: ``position`` gives the place of a node from its level, its index and the number of
leaves in closed form, since m leaves complete 2m - popcount(m) nodes.  Proofs are read top down: a block
gets the siblings above it as its tail, and each of its leaves adds those inside, found by position.

Order inside a tree: order column (null first), then leaf hash, so repeated ids and rows have a fixed
root; equal rows have equal leaves, whichever of them comes first.  Null keys form a tree of their own, the first.
Null fields are ``-``.  A tree of one leaf is that leaf.  An empty table has no trees and gives no proofs.

The leaves are hashed by Spark's own functions; what is dealt and sorted afterwards is 40 to 80 bytes a
row.  Rows are dealt by range of (key, order column, leaf, row number), so a key, an id or a row that fills a third of the table
is spread over tasks like any other rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from funnelkit.llm.shared import partitions, written

#: A block has 2 ** BITS leaves.
BITS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for null, else byte count, ``:`` and the value as text."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in shown]), 256)


def position(level: int, index: int, n: int) -> int:
    """Place in the postorder log of a tree of ``n`` leaves of the node ``index`` of ``level`` (leaves: 0)."""
    before = ((index + 1) << level) - 1  # leaves before the one that completes a full node
    if before < n:
        return 2 * before - before.bit_count() + level
    # a node on the ragged right border: behind all full nodes, one a level above the last full one
    return 2 * n - n.bit_count() + level - 1 - ((n & -n).bit_length() - 1)


def height(n: int, bits: int) -> int:
    """Levels above the leaves of a block in a tree of ``n`` leaves."""
    return min(bits, (n - 1).bit_length())


def complete(leaves: list[bytes], top: int) -> list[bytes]:
    """The nodes of a block (hex digests) in the order in which they complete."""
    log, waiting = [], []

    def closed(level: int, node: bytes) -> tuple[int, bytes]:
        if waiting and waiting[-1][0] == level:
            node = waiting.pop()[1] + node
        log.append(sha256(node).hexdigest().encode())
        return level + 1, log[-1]

    for node in leaves:
        log.append(node)
        level = 0
        while waiting and waiting[-1][0] == level:
            level, node = closed(level, node)
        waiting.append((level, node))
    level, node = waiting.pop()
    while level < top:  # the last block of a tree: its right border
        level, node = closed(level, node)
    return log


def siblings(index: int, n: int, top: int, nodes: bytes, first: int) -> tuple[str, bytes]:
    """Sides and digests of the siblings of a leaf inside its block, from the block's run of the log.

    A side is L or R (the sibling's side) or - (none: the node is hashed alone)."""
    sides, found = [], []
    for level in range(top):
        other = (index >> level) ^ 1
        if other << level >= n:
            sides.append("-")
            continue
        sides.append("L" if other < index >> level else "R")
        at = 32 * (position(level, other, n) - first)
        found.append(nodes[at: at + 32])
    return "".join(sides), b"".join(found)


BLOCK = "tree string, block long, n long, first long, nodes binary, ids array<long>, claims array<binary>"


def _build(rows: DataFrame, bits: int) -> DataFrame:
    """One row a block of ``rows`` (tree, i, n, digest, id, claim): its run of the log, its ids and claims."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        n, start = table["n"][0].as_py(), table["i"][0].as_py()
        log = complete([d.hex().encode() for d in table["digest"].to_pylist()], height(n, bits))
        return pa.table({
            "tree": pa.array([key[0].as_py()], pa.string()), "block": pa.array([start >> bits], pa.int64()),
            "n": pa.array([n], pa.int64()), "first": pa.array([position(0, start, n)], pa.int64()),
            "nodes": pa.array([bytes.fromhex(b"".join(log).decode())], pa.binary()),
            "ids": pa.array([table["id"].to_pylist()], pa.list_(pa.int64())),
            "claims": pa.array([table["claim"].to_pylist()], pa.list_(pa.binary()))})

    return rows.groupBy("tree", F.shiftright("i", bits).alias("block")).applyInArrow(run, BLOCK)


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``i``, their number inside ``tree`` in ``order``, and ``n``, the number of rows of the tree.

    The rows are dealt by range, sorted and written; each task then counts its rows of each tree.  The counts are one
    row a task and one more a tree."""
    spark = rows.sparkSession
    by = ["tree", *order, "copy"]
    fixed = written(rows.withColumn("copy", F.monotonically_increasing_id()), f"{name}-leaves")
    dealt = fixed.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    placed = written(dealt.drop("copy"), f"{name}-sorted").withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("tree", "part").agg(F.min("at").alias("least"), F.count("*").alias("size"))
    tree = Window.partitionBy("tree")
    starts = counts.select(
        F.col("tree").alias("t"), F.col("part").alias("p"), "least", F.sum("size").over(tree).alias("n"),
        F.coalesce(F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = placed.join(starts, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
    return found.select(*[c for c in rows.columns], (F.col("at") - F.col("least") + F.col("before")).alias("i"), "n")


@dataclass(frozen=True)
class Manifest:
    """The written layers of the trees and of the tree of their roots, lowest first (rows of type ``BLOCK``)."""

    trees: list[DataFrame]
    roots: list[DataFrame]
    bits: int


def _layers(rows: DataFrame, bits: int, name: str) -> list[DataFrame]:
    """All layers over ``rows`` (tree, i, n, digest, id, claim), written one after another."""
    out = []
    while True:
        out.append(written(_build(rows, bits), f"{name}-log-{len(out)}"))
        largest = out[-1].agg(F.max("n")).first()[0] or 0  # one number
        if largest <= 1 << bits:
            return out
        rows = out[-1].select("tree", F.col("block").alias("i"), F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"),
                              F.substring("nodes", -32, 32).alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))


def build(docs: DataFrame, key: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, claim: Column | None = None, bits: int = BITS) -> Manifest:
    """The manifest of ``docs``.  ``claim`` is a hex digest that a row claims for its leaf when proofs are checked (null: its own)."""
    own = leaf([F.col(c) for c in fields])
    rows = docs.select(F.col(key).cast("string").alias("tree"), F.col(order).cast("long").alias("id"), F.unhex(own).alias("digest"),
                       F.unhex(claim if claim is not None else F.lit(None).cast("string")).alias("claim"))
    trees = _layers(_numbered(rows, ["id", "digest"], "trees"), bits, "trees")
    tops = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.substring("nodes", -32, 32).alias("digest"))
    # the root of a tree is one row; the rows of the last tree are named by the key
    ordered = _numbered(tops, ["name"], "roots")
    named = written(ordered, "roots-order")
    roots = _layers(named.select("tree", "i", "n", "digest", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim")), bits, "roots")
    return Manifest(trees, [named, *roots], bits)


CHILD = "tree string, i long, id long, claim binary, digest binary, sides string, proof binary, subroot binary, root binary"


def _descend(blocks: DataFrame, bits: int) -> DataFrame:
    """One row a leaf of ``blocks`` (BLOCK and the tail: sides, proof, subroot, root; null root: the block has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, first, nodes, start = row["n"], row["first"], row["nodes"], row["block"] << bits
                top, tail, above = height(n, bits), row["sides"] or "", row["proof"] or b""
                out = []
                for k, (name, claim) in enumerate(zip(row["ids"], row["claims"])):
                    sides, proof = siblings(start + k, n, top, nodes, first)
                    at = 32 * (position(0, start + k, n) - first)
                    out.append({"tree": row["tree"], "i": start + k, "id": name, "claim": claim, "digest": nodes[at: at + 32],
                                "sides": sides + tail, "proof": proof + above, "subroot": row["subroot"], "root": row["root"] or nodes[-32:]})
                yield pa.RecordBatch.from_pylist(out, _CHILD)

    return blocks.mapInArrow(run, CHILD)


_CHILD = pa.schema([("tree", pa.string()), ("i", pa.int64()), ("id", pa.int64()), ("claim", pa.binary()), ("digest", pa.binary()),
                    ("sides", pa.string()), ("proof", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
_TAIL = ("sides", "proof", "subroot", "root")


def _tailed(layer: DataFrame, tails: DataFrame) -> DataFrame:
    """The blocks of a layer with the tails (tree, i, ...) of the layer above."""
    above = tails.select(F.col("tree").alias("t"), F.col("i").alias("b"), *_TAIL)
    return layer.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b")


def proofs(manifest: Manifest) -> DataFrame:
    """key, id, claim, digest (the leaf), sides, proof (the siblings' digests, lowest first), subroot and root of every leaf."""
    named, *layers = manifest.roots
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(_TAIL, ("string", "binary", "binary", "binary"))]
    found = _descend(layers[-1].select("*", *none), manifest.bits)
    for layer in reversed(layers[:-1]):
        found = _descend(_tailed(layer, written(found, "tails")), manifest.bits)
    # a tree's tail: its siblings among the roots
    places = named.select(F.col("name").alias("key"), F.col("i").alias("place"))
    tails = written(found.join(places, F.col("i") == F.col("place")).select(
        F.col("key").alias("tree"), F.lit(0).cast("long").alias("i"), "sides", "proof", F.col("digest").alias("subroot"), "root"), "tails")
    for layer in reversed(manifest.trees[1:]):
        tails = written(_descend(_tailed(layer, tails), manifest.bits), "tails")
    return _descend(_tailed(manifest.trees[0], tails), manifest.bits).withColumnRenamed("tree", "key")


@F.arrow_udf(StringType())
def folded(digests: pa.Array, sides: pa.Array, proofs: pa.Array) -> pa.Array:
    """The root (hex) that a leaf's digest and its proof lead to."""
    out = []
    for digest, path, proof in zip(digests.to_pylist(), sides.to_pylist(), proofs.to_pylist()):
        node, at = digest.hex(), 0
        known = proof.hex()
        for side in path:
            other = ""
            if side != "-":
                other, at = known[at: at + 64], at + 64
            node = sha256((other + node if side == "L" else node + other).encode()).hexdigest()
        out.append(node)
    return pa.array(out, pa.string())


def verified(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (hex digest of the siblings' hex digests), folded_root and verified
    of every leaf: what it claims (or is) folded with its proof, and whether that is the root."""
    found = proofs(manifest)
    hexed = {c: F.lower(F.hex(c)) for c in ("digest", "subroot", "root", "proof")}
    got = found.select(
        F.col("id").alias("doc_id"), hexed["digest"].alias("leaf"), hexed["subroot"].alias("subroot"), hexed["root"].alias("root"),
        F.sha2(hexed["proof"], 256).alias("proof_sha256"), folded(F.coalesce("claim", "digest"), "sides", "proof").alias("folded_root"))
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(seventh: int = 7) -> Column:
    """The claim of rows whose id's CRC-32 (of its decimal text) ``seventh`` divides: the leaf with one added to n_chars; others: null."""
    changed = leaf([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    return F.when(F.crc32(F.col("doc_id").cast("string")) % seventh == 0, changed)
