"""Sum-of-squares packing of token sequences (operator 7).

Every document becomes its token ids and an end id.  A piece goes to the fill
level whose choice leaves the smallest sum of squared counts of partly filled
windows per level; a level array holds those counts, so placing a piece looks at
no window.  Documents longer than a window fill whole windows first.  When a
task's input ends, or more than ``open_limit`` windows are open, the emptiest
open windows are cut to fill the fullest ones; the last window of a task is cut
at powers of two.  So no padding is left at all, and a task holds at most
``open_limit`` windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trajspark.llm.bpe_tokens import encoder
from trajspark.llm.common import Rows, slices

Piece = tuple[int | None, int, bytes, int]  # document, its ids before the piece, ids, ids of the document

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_length", pa.int64()), ("ids", pa.binary())])


class Windows:
    """Open windows by fill level, and the level array of their counts."""

    def __init__(self, capacity: int, open_limit: int):
        self.capacity, self.open_limit = capacity, open_limit
        self.counts = np.zeros(capacity + 1, np.int64)
        self.levels: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def level_for(self, size: int) -> int:
        """Level (0: a new window) after which the sum of squared counts is least; ties: the fullest."""
        c, n = self.capacity, self.counts
        last = c - size
        change = n[size:] - n[:last + 1]       # half the change, but for the terms below
        change[:last] += 1                     # the piece leaves a partly filled window behind
        cost = 2 * change
        cost[0] = 2 * n[size] + 1 if last else 0
        if last:
            cost[last] = 1 - 2 * n[last]
        cost[1:][n[1:last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(cost[::-1]))

    def take(self, level: int) -> list[Piece]:
        stack = self.levels[level]
        window = stack.pop()
        if not stack:
            del self.levels[level]
        self.counts[level] -= 1
        self.n_open -= 1
        return window

    def put(self, level: int, window: list[Piece]) -> None:
        self.levels.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.n_open += 1

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Place a piece shorter than a window; gives the windows that are full now."""
        size = len(piece[2]) // 4
        level = self.level_for(size)
        window = self.take(level) if level else []
        window.append(piece)
        if level + size == self.capacity:
            yield window
        else:
            self.put(level + size, window)
            if self.n_open > self.open_limit:
                yield from self.settle()

    def settle(self) -> Iterator[list[Piece]]:
        """Fill the fullest open windows with pieces cut from the emptiest; one open window stays."""
        order = sorted(self.levels)
        todo = [(level, w) for level in order for w in self.levels[level]]
        self.levels, self.n_open = {}, 0
        self.counts[:] = 0
        low, loose = 0, []
        while todo:
            level, window = todo.pop()
            while level < self.capacity and (loose or todo):
                if not loose:
                    loose = todo.pop(0)[1] if low == 0 else todo.pop(low)[1]
                doc, start, ids, total = loose.pop()
                room = 4 * (self.capacity - level)
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    loose.append((doc, start + room // 4, ids[room:], total))
                level += len(window[-1][2]) // 4
            if level == self.capacity:
                yield window
            else:
                self.put(level, window)
        if loose:
            level = sum(len(p[2]) for p in loose) // 4
            self.put(level, loose)

    def end(self) -> Iterator[list[Piece]]:
        """The rest, cut so that each sequence is full or a power of two long."""
        yield from self.settle()
        for level, stack in sorted(self.levels.items()):
            pieces = list(reversed(stack[0]))
            for bit in reversed(range(level.bit_length())):
                if not level >> bit & 1:
                    continue
                out, room = [], 4 << bit
                while room:
                    doc, start, ids, total = pieces.pop()
                    out.append((doc, start, ids[:room], total))
                    if len(ids) > room:
                        pieces.append((doc, start + room // 4, ids[room:], total))
                    room -= len(out[-1][2])
                yield out


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 1024, end_id: int = 0, open_limit: int = 4096) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset,
    sequence_length, ids`` (``ids``: little-endian unsigned 32-bit integers).

    Each task packs the rows it reads, so nothing is shuffled; sequence ids are
    the task's number times 2^32 plus a running number.  A null text is empty (its
    only id is ``end_id``); a null id stays null; repeated rows are packed once
    each; an empty table gives no rows; other columns are not read.  A text of any
    length is cut over as many windows as it needs.
    """
    if capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two, 2 at least")
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        windows, rows, enc = Windows(capacity, open_limit), Rows(PIECES), encoder(tokenizer)

        def give(done):
            nonlocal number
            for window in done:
                at, length = 0, sum(len(p[2]) for p in window) // 4
                for doc, start, ids, total in window:
                    rows.add(doc, start, len(ids) // 4, total, base + number, at, length, ids, weight=len(ids))
                    at += len(ids) // 4
                number += 1

        for part in slices(batches):
            docs_, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for doc, raw in zip(docs_, enc.encode_many(texts)):
                raw += end
                total, whole = len(raw) // 4, len(raw) // (4 * capacity)
                step = 4 * capacity
                for k in range(whole):
                    give([[(doc, k * capacity, raw[k * step:(k + 1) * step], total)]])
                    if rows.ready():
                        yield rows.take()
                if len(raw) > whole * step:
                    give(windows.place((doc, whole * capacity, raw[whole * step:], total)))
            if rows.ready():
                yield rows.take()
        give(windows.end())
        yield from rows.rest()

    schema = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
              "sequence_length long, ids binary")
    picked = docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS doc_id", f"CAST(`{text_col}` AS STRING) AS text")
    return picked.mapInArrow(run, schema)
