"""Vector bin packing of token sequences by the dot-product heuristic.

An example (piece) takes three resources of a sequence: tokens, one segment, and loss-bearing tokens.  Of a document, the
leading tokens that a column names (a prompt) and the end id bear no loss; of a sequence, the first token has nothing
to be predicted from, so a sequence holds one loss-bearing token less than tokens by default.
A sequence is filled by placing, again and again, the piece with the largest dot product of its
demand and the sequence's free room (both as shares of the limits) among the pieces that fit in
every dimension.  Pieces with equal demands form one class, so a step costs one pass over classes.
When nothing fits, the gap takes the head of the piece with the largest product, cut to size, and the
rest of that piece stays for later sequences; gaps below ``MIN_CUT`` tokens are left.  A sequence that
cannot be filled (segments or loss ran out, or no piece is left) is cut back to a power of two, a
length that needs no padding, and the rest goes on.

Packing runs inside the tasks that tokenise: a partition is worked off in shards of about
``SHARD_TOKENS`` tokens, so memory is bounded, nothing is shuffled, and a lost task is repeated by
itself.  sequence_id is unique: the partition's number above the count of its sequences.

Null texts are empty and still have their end id.  Null ids, repeated rows and ties are placed like any
row; each input row has its own pieces.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_TOKENS = 4 << 20
MIN_CUT = 8


class Limits(NamedTuple):
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2047


class Piece(NamedTuple):
    """``length`` tokens of an example from ``start``; the example's tokens from ``loss_from`` to ``loss_to`` bear loss."""

    example: int
    start: int
    length: int
    loss_from: int
    loss_to: int

    def loss(self) -> int:
        return max(0, min(self.start + self.length, self.loss_to) - max(self.start, self.loss_from))

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(length=at), self._replace(start=self.start + at, length=self.length - at)


class Classes:
    """Pieces by demand (tokens, loss)."""

    def __init__(self) -> None:
        self.index: dict[tuple[int, int], int] = {}
        self.tokens, self.loss, self.count = (np.zeros(64, np.int64) for _ in range(3))
        self.pieces: list[list[Piece]] = []
        self.left = 0

    def add(self, piece: Piece) -> None:
        key = piece.length, piece.loss()
        k = self.index.setdefault(key, len(self.index))
        if k == len(self.pieces):
            self.pieces.append([])
            if k == len(self.tokens):
                self.tokens, self.loss, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.loss, self.count))
            self.tokens[k], self.loss[k] = key
        self.pieces[k].append(piece)
        self.count[k] += 1
        self.left += 1

    def take(self, free: tuple[int, int, int], limits: Limits, fitting: bool) -> Piece | None:
        """The piece with the largest dot product, of those that fit or of all."""
        n = len(self.pieces)
        tokens, loss = self.tokens[:n], self.loss[:n]
        there = self.count[:n] > 0
        if fitting:
            there &= (tokens <= free[0]) & (loss <= free[2])
        score = tokens * (free[0] / limits.tokens ** 2) + loss * (free[2] / max(limits.loss, 1) ** 2)
        score = np.where(there, score, -1.0)  # a segment weighs the same for each piece
        k = int(score.argmax()) if n else 0
        if not n or score[k] < 0 or free[1] < 1:
            return None
        self.count[k] -= 1
        self.left -= 1
        return self.pieces[k].pop()


def _head(piece: Piece, tokens: int, loss: int) -> int:
    """How many of a piece's first tokens fit into this room."""
    if piece.loss() <= loss:
        return min(piece.length, tokens)
    return min(piece.length, tokens, max(0, piece.loss_from - piece.start) + loss)


def pack_shard(examples: list[tuple[int, ...]], limits: Limits = Limits(), min_cut: int = MIN_CUT) -> list[list[Piece]]:
    """Sequences of pieces for (tokens, first loss-bearing token[, end of the loss-bearing ones]) examples, each of one token or more."""
    out: list[list[Piece]] = []
    classes = Classes()
    for k, (tokens, loss_from, *loss_to) in enumerate(examples):
        rest = Piece(k, 0, tokens, loss_from, loss_to[0] if loss_to else tokens)
        while rest.length >= limits.tokens and limits.tokens - (at := _head(rest, limits.tokens, limits.loss)) < min(min_cut, limits.tokens):
            full, rest = rest.cut(at)
            out.append([full])
        if rest.length:
            classes.add(rest)
    while classes.left:
        sequence: list[Piece] = []
        free = list(limits)
        while classes.left and free[0] and free[1]:
            piece = classes.take((free[0], free[1], free[2]), limits, True)
            if piece is None:
                if free[0] < min_cut:
                    break
                piece = classes.take((free[0], free[1], free[2]), limits, False)
                at = _head(piece, free[0], free[2])
                if at < 1 or at < min(min_cut, piece.length):
                    classes.add(piece)
                    break
                if at < piece.length:
                    piece, rest = piece.cut(at)
                    classes.add(rest)
            sequence.append(piece)
            free[0] -= piece.length
            free[1] -= 1
            free[2] -= piece.loss()
        used = limits.tokens - free[0]
        if used < limits.tokens and free[0] >= min_cut:
            keep = 1 << (used.bit_length() - 1)
            sequence, back = _cut_back(sequence, keep)
            for piece in back:
                classes.add(piece)
        out.append(sequence)
    return out


def _cut_back(sequence: list[Piece], keep: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``keep`` tokens of a sequence, and the rest as pieces."""
    stay, back, room = [], [], keep
    for piece in sequence:
        if piece.length <= room:
            stay.append(piece)
        elif room:
            head, tail = piece.cut(room)
            stay.append(head)
            back.append(tail)
        else:
            back.append(piece)
        room -= min(room, piece.length)
    return stay, back


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, vocabulary: str, end_id: int, limits: Limits = Limits(), min_cut: int = MIN_CUT, first_loss: str | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text), columns as in ``SCHEMA``.

    ``first_loss`` names a column with the number of leading tokens that bear no loss (null or no column: 0); the end
    id bears none either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from funnelkit.llm.tokens import BareEncoder, encoder

        encode = encoder(BareEncoder, vocabulary).encode
        end = np.array([end_id], "<u2").tobytes()
        base = TaskContext.get().partitionId() << 40
        shard: list[tuple[int | None, bytes, int]] = []
        held = 0
        for batch in batches:
            for doc_id, text, plain in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode(text or "") + end
                shard.append((doc_id, ids, max(0, plain or 0)))
                held += len(ids) // 2
                if held >= SHARD_TOKENS:
                    packed, count = _emit(shard, limits, min_cut, base)
                    base, shard, held = base + count, [], 0
                    yield packed
        if shard:
            yield _emit(shard, limits, min_cut, base)[0]

    plain = F.lit(0) if first_loss is None else F.col(first_loss)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", plain.cast("long").alias("plain")).mapInArrow(run, SCHEMA)


def _emit(shard: list[tuple[int | None, bytes, int]], limits: Limits, min_cut: int, base: int) -> tuple[pa.RecordBatch, int]:
    sequences = pack_shard([(len(ids) // 2, plain, len(ids) // 2 - 1) for _, ids, plain in shard], limits, min_cut)
    columns: dict[str, list] = defaultdict(list)
    for number, sequence in enumerate(sequences):
        offset = 0
        for piece in sequence:
            doc_id, ids, _ = shard[piece.example]
            part = np.frombuffer(ids, "<u2", piece.length, 2 * piece.start).astype("<u4")
            row = (doc_id, piece.start, piece.length, zlib.crc32(part.tobytes()), len(ids) // 2, base + number, offset, piece.loss())
            for name, value in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"), row):
                columns[name].append(value)
            offset += piece.length
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns.values()], list(columns)), len(sequences)
