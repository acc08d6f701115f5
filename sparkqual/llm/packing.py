"""Packing documents into training sequences by the sum-of-squares rule.

A sequence that is partly filled stands at a level: the tokens in it. N(h) counts the open
sequences at level h. A piece of s tokens goes from level h to h + s where that makes the sum
of N(h)^2 over 0 < h < length smallest; level 0 opens a sequence, and a full one is closed.
Keeping the levels equally often used keeps a partner for every size of piece.

Each task packs the documents of its own partition while it reads them: no shuffle, and a task
that is run again gives the same rows. Documents longer than a sequence fill whole sequences
first. What is open at the end of a task is drained: the emptiest sequences are cut to fill the
fullest, and the last remainder is split at powers of two, so nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkqual.llm.tables import texts
from sparkqual.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
# Open sequences a task holds at most before it drains them early; about 4 KB each.
OPEN = 4096
# Sequence ids of a task start at its number times this.
TASK_SPAN = 1 << 40


class Packer:
    """Places pieces (doc_id, start, doc_tokens, ids) and hands out finished rows."""

    def __init__(self, length: int, first_id: int, open_limit: int = OPEN):
        self.length, self.next_id, self.open_limit = length, first_id, open_limit
        self.levels = np.zeros(length + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(length + 1)]
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, doc_tokens, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, doc_tokens, self.next_id, offset, ids))
            offset += n
        self.next_id += 1

    def level_for(self, size: int) -> int:
        """The level 0 <= h <= length - size that a piece of this size should go to."""
        n, top = self.levels, self.length - size
        # Change of the sum of squares: N(h) loses one, N(h + size) gains one.
        change = 2 * (n[size : size + top + 1] - n[: top + 1]) + 2
        change[0] = 2 * n[size] + 1
        change[top] = 1 - 2 * n[top]  # becomes full, and no longer counts
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        # Ties go to the fullest.
        return top - int(np.argmin(change[::-1]))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        tokens, width = len(ids) // 4, 4 * self.length
        whole = len(ids) // width * width
        for k in range(0, whole, width):
            self._close([(doc_id, k // 4, tokens, ids[k : k + width])])
        if whole < len(ids):
            self._place((doc_id, whole // 4, tokens, ids[whole:]))

    def _place(self, piece: tuple) -> None:
        size = len(piece[3]) // 4
        h = self.level_for(size)
        pieces = []
        if h:
            pieces = self.at[h].pop()
            self.levels[h] -= 1
        pieces.append(piece)
        if h + size == self.length:
            self._close(pieces)
            return
        self.at[h + size].append(pieces)
        self.levels[h + size] += 1
        if self.levels.sum() > self.open_limit:
            self._drain()

    def _drain(self) -> None:
        """Fill the fullest open sequences with tokens cut from the emptiest; at most one stays open."""
        queue = [(h, pieces) for h, group in enumerate(self.at) for pieces in group]
        self.at = [[] for _ in range(self.length + 1)]
        self.levels[:] = 0
        low, high = 0, len(queue) - 1
        while low < high:
            fill, pieces = queue[high]
            have, source = queue[low]
            while fill < self.length and source:
                doc_id, start, tokens, ids = source.pop()
                room = 4 * (self.length - fill)
                pieces.append((doc_id, start, tokens, ids[:room]))
                if len(ids) > room:
                    source.append((doc_id, start + room // 4, tokens, ids[room:]))
                taken = min(room, len(ids)) // 4
                fill, have = fill + taken, have - taken
            queue[low], queue[high] = (have, source), (fill, pieces)
            if fill == self.length:
                self._close(pieces)
                high -= 1
            if not source:
                low += 1
        if low == high:
            fill, pieces = queue[low]
            if fill == self.length:
                self._close(pieces)
            else:
                self.at[fill].append(pieces)
                self.levels[fill] = 1

    def finish(self) -> None:
        """Drain, then split what is left into sequences whose lengths are powers of two."""
        self._drain()
        pieces = [p for group in self.at for found in group for p in found][::-1]
        left = sum(len(p[3]) // 4 for p in pieces)
        while left:
            room = 4 * (1 << (left.bit_length() - 1))
            left -= room // 4
            part = []
            while room:
                doc_id, start, tokens, ids = pieces.pop()
                part.append((doc_id, start, tokens, ids[:room]))
                if len(ids) > room:
                    pieces.append((doc_id, start + room // 4, tokens, ids[room:]))
                room -= min(room, len(ids))
            self._close(part)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame,
    length: int = 1024,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0,
    open_limit: int = OPEN,
) -> DataFrame:
    """All documents, each followed by `end_id`, as pieces of sequences of `length` tokens.

    One row per piece: (doc_id, start, length, doc_tokens, sequence_id, offset, ids), ids as
    little-endian unsigned 32-bit integers. Every token is in exactly one piece, offsets of a
    sequence have no gaps. Sequences are full, but for up to one of each smaller power of two
    per task. Null or empty text is `end_id` alone; a null doc_id stays null; an empty table
    gives no rows; repeated rows are packed once each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        context = TaskContext.get()
        packer = Packer(length, (context.partitionId() if context else 0) * TASK_SPAN, open_limit)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = code.ids(part.column(1).to_pylist())
                for doc_id, found in zip(part.column(0).to_pylist(), ids, strict=True):
                    packer.add(doc_id, found + end)
                yield as_batch(packer.take())
        packer.finish()
        yield as_batch(packer.take())

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return texts(docs).mapInArrow(run, SCHEMA)
