"""Vector bin packing of examples into sequences under limits on tokens, segments and loss-bearing tokens.

Every task packs what it reads, so nothing is shuffled. An example is first cut into pieces that fit a sequence alone; whole
sequences leave at once, the rest waits in a pool of bounded size. A sequence is filled from the pool by the dot-product
heuristic: of the pieces that fit, take the one whose demand vector (share of tokens, segments and loss-bearing tokens) has
the largest dot product with what is left of the three limits. When none fits, the largest is cut to fill the gap. Only the
last sequence of a task can stay short; it is split at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.encoding import encoder

_PIECES = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("loss_tokens", "long"), ("padded_length", "long")]


@dataclass(frozen=True)
class Limits:
    """Of one sequence. pool: pieces that wait in a task's memory at most, each shorter than a sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    pool: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.pool) < 1:
            raise ValueError("limits are positive")


class Packer:
    """add(example) and end() yield sequences: lists of (example, start, length, loss tokens).

    An example is any object with n (its tokens) and loss_from (from there on its tokens bear loss).
    """

    def __init__(self, limits: Limits):
        self.limits = limits
        self.of: list = []  # of each place in the pool: example and start
        self.demand = np.zeros((3, 2 * limits.pool + 2))  # of each place: tokens, 1 and loss tokens; tokens 0: free
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.used = 0

    def _loss(self, example, start: int, length: int) -> int:
        return max(0, start + length - max(start, example.loss_from))

    def _cut(self, example, start: int, room: int, loss: int) -> int:
        """The longest piece from start on within so many tokens and loss tokens."""
        return min(example.n - start, room, max(0, example.loss_from - start) + loss)

    def _keep(self, example, start: int, length: int) -> None:
        self.of.append((example, start))
        self.demand[:, self.used] = length, 1, self._loss(example, start, length)
        self.used += 1

    def _take(self, at: int) -> None:
        self.used -= 1
        self.demand[:, at] = self.demand[:, self.used]
        self.of[at] = self.of[self.used]
        self.of.pop()

    def add(self, example) -> Iterator[list]:
        start = 0
        while start < example.n:
            length = self._cut(example, start, self.limits.tokens, self.limits.loss)
            if length == self.limits.tokens:
                yield [(example, start, length, self._loss(example, start, length))]
            else:
                self._keep(example, start, length)
            start += length
            while self.used >= self.limits.pool:
                yield self._sequence()

    def _sequence(self) -> list:
        left, out = self.caps.copy(), []
        while self.used and left.min() >= 1:
            d = self.demand[:, : self.used]
            score = (left / self.caps**2) @ d
            score[(d[0] > left[0]) | (d[2] > left[2])] = -1
            at = int(score.argmax())
            if score[at] < 0:  # none fits: cut the largest
                at = int(d[0].argmax())
                example, start = self.of[at]
                whole = int(d[0, at])
                length = min(whole, self._cut(example, start, int(left[0]), int(left[2])))
                self._take(at)
                self._keep(example, start + length, whole - length)
            else:
                example, start = self.of[at]
                length = int(d[0, at])
                self._take(at)
            loss = self._loss(example, start, length)
            out.append((example, start, length, loss))
            left -= (length, 1, loss)
        return out

    def end(self) -> Iterator[list]:
        while self.used:
            pieces = self._sequence()
            if self.used or sum(p[2] for p in pieces) == self.limits.tokens:
                yield pieces
            else:
                yield from self._at_powers(pieces)

    def _at_powers(self, pieces: list) -> Iterator[list]:
        """The last, short sequence as several whose lengths are powers of two."""
        total = sum(p[2] for p in pieces)
        while total:
            room, out = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                example, start, length, _ = pieces.pop(0)
                now = min(length, room)
                out.append((example, start, now, self._loss(example, start, now)))
                if now < length:
                    pieces.insert(0, (example, start + now, length - now, 0))
                room -= now
            yield out


class _Document:
    __slots__ = ("doc_id", "ids", "n", "loss_from")

    def __init__(self, doc_id: int | None, ids: bytes, loss_tokens: int | None):
        self.doc_id, self.ids, self.n = doc_id, ids, len(ids) // 4
        self.loss_from = 0 if loss_tokens is None else self.n - min(self.n, max(0, loss_tokens))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None) -> DataFrame:
    """One row for each piece of each document; every id of a document is in exactly one piece.

    A null text counts as empty, so its document is one piece with the end id; rows of one id, or with a null id, are packed
    each for itself. loss_col: how many of a document's last ids bear loss (null or none given: all). Columns: those of the
    contract, loss_tokens of the piece, and padded_length of its sequence. sequence_id is unique: the number of the task in
    its upper bits, the sequence within it in the lower 40.
    """
    limits = limits or Limits()
    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), loss.alias("loss"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end, packer = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), Packer(limits)
        sequence, out = TaskContext.get().partitionId() << 40, []

        def put(sequences: Iterator[list]) -> None:
            nonlocal sequence
            for pieces in sequences:
                total, offset = sum(p[2] for p in pieces), 0
                padded = total if total & (total - 1) == 0 else limits.tokens
                for doc, start, length, loss_tokens in pieces:
                    out.append((doc.doc_id, start, length, zlib.crc32(memoryview(doc.ids)[4 * start : 4 * (start + length)]), doc.n, sequence, offset, loss_tokens, padded))
                    offset += length
                sequence += 1

        def rows_out() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * len(_PIECES)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[n for n, _ in _PIECES])

        for batch in batches:
            for doc_id, text, loss_tokens in zip(*(batch[c] for c in ("doc_id", "text", "loss")), strict=True):
                put(packer.add(_Document(doc_id.as_py(), encode(text.as_py()) + end, loss_tokens.as_py())))
                if len(out) >= 10_000:
                    yield rows_out()
                    out.clear()
        put(packer.end())
        yield rows_out()

    return rows.mapInArrow(pack, ", ".join(map(" ".join, _PIECES)))
