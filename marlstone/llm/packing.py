"""Sum-of-squares online packing of token sequences.

A document's ids (its text's, then an end id) first fill whole windows; what is
left is placed online: of all fill levels at which an open window takes it, and
of a new window, the one is chosen that leaves the least sum of squared counts
of open windows by level.  The counts stand in a level array, so a choice costs
one vector operation however many windows are open.

Levels are LEVELS steps of a window, not single tokens, for windows close along
the way only if fills meet often.  A placement that reaches the last level
closes its window: what a piece has too much is cut off and goes into windows
that lack a little, or is placed like a document of its own.  So at any time
less than a step is lacking in the windows that wait for such an end, and what
is open in the others is some windows a level.

Each input partition packs on its own, in one pass, with no shuffle.  Open
windows are bounded: past the bound, and at the partition's end, they are
joined and cut anew into full windows.  What is then left of a partition, less
than one window, is cut into sequences whose lengths are powers of two, which
need no padding.  A task that is run again packs the same rows alike, so
sequence ids (partition number, then a count) agree.

Defined cases: null and empty texts are their end id alone; rows with equal or
null doc_id are documents of their own; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.tokens import VOCABULARY, piece_table

WINDOW = 4096
END_ID = 2
MAX_OPEN = 1024
LEVELS = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequences of one partition that its number leaves room for.
PER_PARTITION = 1 << 36


class Packer:
    """Packs the documents of one partition; finished pieces gather in ``out``, tokens by what filled their windows in ``paths``."""

    def __init__(self, first_sequence: int, window: int = WINDOW, max_open: int = MAX_OPEN, levels: int = LEVELS):
        self.window, self.max_open, self.next = window, max_open, first_sequence
        self.n_levels = min(levels, window)
        self.step = window // self.n_levels
        self.level = np.zeros(self.n_levels + 1, dtype=np.int64)  # open windows by level
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(self.n_levels + 1)]  # (fill, pieces); the last are those that lack less than a step
        self.n_open = 0
        self.out: list[tuple] = []
        self.paths = {"whole": 0, "placed": 0, "joined": 0}

    def emit(self, pieces: list[tuple], path: str) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.paths[path] += at
        self.next += 1

    def choose(self, size: int) -> int:
        """The level to place a piece at; 0 opens a window."""
        steps = min(self.n_levels, max(1, round(size / self.step)))
        n = self.level[: self.n_levels - steps + 1]
        cost = 2 * self.level[steps:] + 1
        cost[-1] = 0  # at the last level a window is open no more
        cost[1:] += 1 - 2 * n[1:]
        cost[1:][n[1:] == 0] = np.iinfo(np.int64).max
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def put(self, fill: int, pieces: list, piece: tuple) -> tuple | None:
        """Fill a window with a piece, and set it back or emit it; gives what didn't go in."""
        doc, start, ids, total = piece
        k = min(len(ids), self.window - fill)
        pieces.append((doc, start, ids[:k], total))
        fill += k
        if fill == self.window:
            self.emit(pieces, "placed")
        else:
            at = min(self.n_levels, -(-fill // self.step))
            self.open[at].append((fill, pieces))
            self.n_open += 1
            if at < self.n_levels:
                self.level[at] += 1
        return (doc, start + k, ids[k:], total) if k < len(ids) else None

    def take(self, at: int) -> tuple[int, list]:
        self.n_open -= 1
        if at < self.n_levels:
            self.level[at] -= 1
        return self.open[at].pop()

    def add(self, doc, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.emit([(doc, at, ids[at : at + self.window], total)], "whole")
            at += self.window
        piece = (doc, at, ids[at:], total) if at < total else None
        lacking, first = self.open[self.n_levels], True
        while piece is not None:
            # ends that were cut off go where little is lacking; if too many windows wait for one, so does a document's head
            if lacking and (not first or len(lacking) > self.n_levels):
                piece = self.put(*self.take(self.n_levels), piece)
            else:
                level = self.choose(len(piece[2]))
                piece = self.put(*(self.take(level) if level else (0, [])), piece)
            first = False
        if self.n_open > self.max_open:
            rest, fill = self.join()
            if rest:
                level = min(self.n_levels, -(-fill // self.step))
                self.open[level].append((fill, rest))
                self.n_open = 1
                if level < self.n_levels:
                    self.level[level] = 1

    def join(self) -> tuple[list, int]:
        """Cut the open windows anew into full ones; gives what is left and its fill."""
        held, fill = [], 0
        for windows in self.open:
            for doc, start, ids, total in (p for _, w in windows for p in w):
                while fill + len(ids) >= self.window:
                    k = self.window - fill
                    self.emit([*held, (doc, start, ids[:k], total)], "joined")
                    held, fill, start, ids = [], 0, start + k, ids[k:]
                if len(ids):
                    held.append((doc, start, ids, total))
                    fill += len(ids)
            windows.clear()
        self.level[:] = 0
        self.n_open = 0
        return held, fill

    def close(self) -> None:
        rest, fill = self.join()
        for k in reversed(range(fill.bit_length())):
            if not fill >> k & 1:
                continue
            room, held = 1 << k, []
            while room:
                doc, start, ids, total = rest.pop(0)
                held.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self.emit(held, "joined")


def packed(vocabulary: str, window: int, end_id: int, max_open: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in PIECES.split(",")]
        packer = Packer((TaskContext.get().partitionId() if TaskContext.get() else 0) * PER_PARTITION, window, max_open)
        table = piece_table(vocabulary)

        def rows():
            out, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names=names)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), table.texts(batch.column(1))):
                packer.add(doc, np.append(ids, np.int32(end_id)))
            if len(packer.out) > 4096:
                yield rows()
        packer.close()
        yield rows()

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed(vocabulary, window, end_id, max_open), PIECES)
