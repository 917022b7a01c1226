"""Token files: ids in document order under a canonical length-limited Huffman code.

A token file is a folder of three Parquet tables:

* ``codebook`` (id, bits): the code length of each id that occurs; the canonical code follows from it.
* ``segments``: runs of documents in ascending doc_id order.  ``pid`` and ``seg`` order the runs,
  ``first`` counts the ids of the run's part before it, ``doc_ids`` and ``lengths`` list its documents,
  ``payload`` is the bit stream (most significant bit first) and ``checkpoints`` the bit offset of each
  block of ``BLOCK`` ids, so blocks decode independently of one another.
* ``bases`` (pid, base): the ids before each part.

Writing: texts are dealt by ranges of (doc_id, text hash, a row number that parts equal rows), sorted,
encoded once and kept as 16-bit ids together with each part's counts.  The global counts (at most one row
an id of the vocabulary) give the code lengths by package-merge, limited to ``MAX_BITS``; a second pass
codes the segments.  Reading: a table of 2**MAX_BITS entries gives symbol and length of the next code; all
blocks of a segment are decoded side by side, one symbol of each at a step.

What reaches the driver is bounded by the vocabulary.  Every id costs bounded memory: a segment closes
at ``SEGMENT`` ids (a longer document is a segment of its own).

Null texts are empty, documents of no ids but the end id.  Null doc_ids come first.  Repeated rows and
ids follow one another in the file, each with its own place.  An empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funnelkit.llm.shared import partitions, text_key, written

MAX_BITS = 16
BLOCK = 256
SEGMENT = 512 << 10


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for the symbols with a count (package-merge)."""
    bits = np.zeros(len(counts), np.uint8)
    symbols = np.flatnonzero(counts)
    n = len(symbols)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n < 2:
        bits[symbols] = 1
        return bits
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, weights = [], np.empty(0)
    for _ in range(limit):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        merged = np.argsort(both, kind="stable")
        levels.append(merged < n)
        weights = both[merged]
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (take - chosen)
    bits[order] = depth
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """Canonical codes: by length, then by symbol, counting up."""
    codes = np.zeros(len(bits), np.uint64)
    code, last = 0, 0
    present = np.flatnonzero(bits)
    for symbol in present[np.lexsort((present, bits[present]))]:
        code <<= int(bits[symbol]) - last
        last = int(bits[symbol])
        codes[symbol] = code
        code += 1
    return codes


def compress(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bit stream of ``ids`` and the bit offset of each block."""
    width = bits[ids].astype(np.int64)
    ends = np.cumsum(width)
    starts = ends - width
    if not len(ids):
        return b"", starts
    stream = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    word, room = starts >> 6, 64 - (starts & 63) - width
    code = codes[ids]
    high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    stream[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    stream[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return stream.byteswap().tobytes()[: int(ends[-1] + 7) >> 3], starts[::BLOCK]


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every value of the next MAX_BITS bits."""
    present = np.flatnonzero(bits)
    order = present[np.lexsort((present, bits[present]))]
    spans = 1 << (MAX_BITS - bits[order].astype(np.int64))
    symbols, lengths = np.zeros(1 << MAX_BITS, np.uint16), np.ones(1 << MAX_BITS, np.uint8)
    symbols[: spans.sum()] = np.repeat(order, spans)
    lengths[: spans.sum()] = np.repeat(bits[order], spans)
    return symbols, lengths


def decompress(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of a segment; all blocks advance together, one id of each at a step."""
    symbols, lengths = table
    raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    at = np.asarray(checkpoints, np.int64).copy()
    out = np.zeros((len(at), BLOCK), np.uint16)
    last = n - (len(at) - 1) * BLOCK
    for k in range(BLOCK):
        if k == last:  # the last block is shorter
            at = at[:-1]
        if not len(at):
            break
        peek = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[: len(at), k] = symbols[peek]
        at += lengths[peek]
    return out.reshape(-1)[:n]


RAW = "pid int, seg int, first long, doc_ids array<long>, lengths array<int>, ids binary, count_ids array<int>, counts array<long>"
SEGMENTS = "pid int, seg int, first long, n_ids int, doc_ids array<long>, lengths array<int>, checkpoints array<long>, payload binary"
READ = "pid int, doc_id long, before long, n_tokens long, ids_crc32 long"


def _encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Sorted documents as raw segments; a part's last segment carries its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from funnelkit.llm.tokens import SpacedEncoder, encoder

        encode = encoder(SpacedEncoder, vocabulary).encode
        end = np.array([end_id], "<u2").tobytes()
        pid, seg, first = TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(1 << 16, np.int64)
        doc_ids, blobs, held = [], [], 0

        def closed(last: bool) -> pa.RecordBatch:
            ids = b"".join(blobs)
            counts[:] += np.bincount(np.frombuffer(ids, "<u2"), minlength=1 << 16)
            seen = np.flatnonzero(counts) if last else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array([pid], pa.int32()), pa.array([seg], pa.int32()), pa.array([first], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(b) // 2 for b in blobs]], pa.list_(pa.int32())),
                pa.array([ids], pa.binary()), pa.array([seen.tolist()], pa.list_(pa.int32())),
                pa.array([counts[seen].tolist()], pa.list_(pa.int64()))],
                ["pid", "seg", "first", "doc_ids", "lengths", "ids", "count_ids", "counts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held >= SEGMENT:
                    yield closed(False)
                    seg, first = seg + 1, first + held
                    doc_ids, blobs, held = [], [], 0
                doc_ids.append(doc_id)
                blobs.append(encode(text or "") + end)
                held += len(blobs[-1]) // 2
        if blobs:
            yield closed(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"),
                       F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), "key", "row"]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "text").mapInArrow(run, RAW)


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Write the token file of ``docs`` (doc_id, text) to ``path``."""
    spark = docs.sparkSession
    raw = written(_encoded(docs, vocabulary, end_id), "ids", compression="zstd")
    counted = raw.select(F.explode(F.arrays_zip("count_ids", "counts")).alias("c")).groupBy(F.col("c.count_ids").alias("id"))
    rows = counted.agg(F.sum("c.counts").alias("n")).collect()  # at most one row an id of the vocabulary
    counts = np.zeros(1 << 16, np.int64)
    for r in rows:
        counts[r.id] = r.n
    bits = code_lengths(counts)
    spark.createDataFrame([(int(k), int(bits[k])) for k in np.flatnonzero(bits)], "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    book = spark.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(book.value, np.uint8)
        codes = canonical(lengths)
        for batch in batches:
            for k in range(batch.num_rows):
                pid, seg, first, doc_ids, sizes, blob = (batch.column(c)[k: k + 1] for c in range(6))
                ids = np.frombuffer(blob[0].as_py(), "<u2")
                payload, marks = compress(ids, lengths, codes)
                yield pa.RecordBatch.from_arrays([
                    pid, seg, first, pa.array([len(ids)], pa.int32()), doc_ids, sizes,
                    pa.array([marks], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                    ["pid", "seg", "first", "n_ids", "doc_ids", "lengths", "checkpoints", "payload"])

    raw.select("pid", "seg", "first", "doc_ids", "lengths", "ids").mapInArrow(run, SEGMENTS).write.parquet(f"{path}/segments")
    parts = spark.read.parquet(f"{path}/segments").groupBy("pid").agg(F.sum("n_ids").alias("n"))  # one row a part
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/bases")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a token file, decoded from it."""
    bits = np.zeros(1 << 16, np.uint8)
    for r in spark.read.parquet(f"{path}/codebook").collect():  # at most one row an id of the vocabulary
        bits[r.id] = r.bits
    book = spark.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(np.frombuffer(book.value, np.uint8))
        for batch in batches:
            for pid, first, n, doc_ids, sizes, marks, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = decompress(payload, marks, n, table).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([pid] * len(sizes), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts + first, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["pid", "doc_id", "before", "n_tokens", "ids_crc32"])

    segments = spark.read.parquet(f"{path}/segments").select("pid", "first", "n_ids", "doc_ids", "lengths", "checkpoints", "payload")
    bases = spark.read.parquet(f"{path}/bases")
    return segments.mapInArrow(run, READ).join(bases, "pid").select(
        "doc_id", (F.col("before") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
