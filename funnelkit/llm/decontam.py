"""Benchmark decontamination with one Aho-Corasick automaton.

Texts and items are normalised alike: A-Z lower-cased, words are runs of 0-9, a-z and characters
beyond ASCII.  The windows of an item (ten consecutive words, or the whole item if it has fewer) are
patterns over word numbers; one automaton holds all of them and each text runs through it once.  A
word inside any occurrence of a window is hit, and hit runs of words are mapped back to code point
ranges of the original text.

The benchmark is the stated query set.  Up to ``PART_BYTES // 2`` it is one automaton, built once a worker.  A larger
one is dealt into parts of about that size: a task gathers texts of ``ROOM`` bytes, runs them through one part's automaton after the
other and merges the hits, so the result does not depend on the size and a worker holds one automaton at a time.  The plain
items of all parts are broadcast; a benchmark of more than ``MAX_BYTES`` is refused with an error.

Null texts and items have no words.  An item whose id is null hits words but has no id to name.
Repeated items and items that share windows each count; repeated ids are named once.  Repeated rows
are scanned alike.  Empty tables give no rows, an empty benchmark no hits.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
PART_BYTES = 8 << 20
MAX_BYTES = 256 << 20
ROOM = 64 << 20

_SPLIT = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_SPLIT).split()


class Scanner:
    """An automaton over the windows of some items: (item id or None, text) pairs."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            line = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words((text or "").encode()))
            for k in range(max(1, len(line) - window + 1) if line else 0):
                patterns.setdefault(line[k: k + window], set()).update([name] if name is not None else [])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, names in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), names))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of word indexes (end exclusive), merged, and the ids of the items that occur."""
        if self.empty:
            return [], set()
        runs, names = [], set()
        for end, (length, owners) in self.automaton.iter(tuple(map(self.numbers.get, found, repeat(0)))):
            runs.append((end - length + 1, end + 1))
            names |= owners
        return merged(runs), names


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def code_points(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Code point ranges of runs of words in the original text."""
    if not runs:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    at, bytes_done, out = 0, 0, []
    for a, b in runs:
        start, end = spans[a][0], spans[b - 1][1]
        at += len(text[bytes_done:start].decode())
        length = len(text[start:end].decode())
        out.append({"start": at, "end": at + length})
        at, bytes_done = at + length, end
    return out


RESULT = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items_sha256:string,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
                    ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _parts(benchmark: DataFrame) -> list[tuple[str, Broadcast]]:
    """A name and a broadcast of (id, text) items for each part of the benchmark, read part by part."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > MAX_BYTES:
        raise ValueError(f"the benchmark has {total} bytes of text; at most {MAX_BYTES} can be scanned for")
    count = -(-total // (PART_BYTES // 2)) or 1
    dealt = items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    return [(uuid.uuid4().hex, spark.sparkContext.broadcast([(r.id, r.text) for r in dealt.filter(F.col("part") == k).collect()]))
            for k in range(count)]


def scan_column(text: Column, benchmark: DataFrame, window: int = WINDOW) -> Column:
    """A struct of type ``RESULT`` for each text."""
    parts = _parts(benchmark)

    @F.arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for group in _gathered(batches, ROOM if len(parts) > 1 else 0):
            texts = [raw or b"" for batch in group for raw in batch]
            runs: list[list[tuple[int, int]]] = [[] for _ in texts]
            names: list[set[str]] = [set() for _ in texts]
            sizes = [0] * len(texts)
            for name, part in parts:
                scanner = _scanner(name, part, window)
                for k, raw in enumerate(texts):
                    found = words(raw)
                    sizes[k] = len(found)
                    hits, items = scanner.scan(found)
                    runs[k] += hits
                    names[k] |= items
            out = [_result(raw, size, merged(hits), items) for raw, size, hits, items in zip(texts, sizes, runs, names)]
            for batch in group:
                yield pa.array(out[: len(batch)], _ARROW)
                out = out[len(batch):]

    return scan(text)


def _gathered(batches: Iterator[pa.Array], room: int) -> Iterator[list[list[bytes | None]]]:
    """Consecutive batches whose texts have about ``room`` bytes together, one batch at least."""
    group, held = [], 0
    for texts in batches:
        group.append(texts.cast(pa.binary()).to_pylist())
        held += texts.nbytes
        if held >= room:
            yield group
            group, held = [], 0
    if group:
        yield group


def _result(raw: bytes, size: int, runs: list[tuple[int, int]], items: set[str]) -> dict[str, object]:
    names = sorted(items, key=str.encode)
    return {"n_words": size, "n_hit": sum(b - a for a, b in runs), "n_items": len(names),
            "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest(), "items": names, "spans": code_points(raw, runs)}


_scanners: dict[tuple[str, int], Scanner] = {}


def _scanner(name: str, part: Broadcast, window: int) -> Scanner:
    """The scanner of this Python process for a part; only the latest is kept."""
    if (name, window) not in _scanners:
        _scanners.clear()
        _scanners[name, window] = Scanner(part.value, window)
    return _scanners[name, window]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """struct ``row`` (the input row), doc_id, n_words, n_hit, n_items, items_sha256, items, spans and
    contaminated (n_hit > 0)."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", scan_column(F.col("text"), benchmark, window).alias("found"))
    return rows.select("row", "doc_id", "found.*").withColumn("contaminated", F.col("n_hit") > 0)
