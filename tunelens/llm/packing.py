"""Packing documents into fixed windows by the sum-of-squares rule.

Each task packs the documents of its partition on line. Whole windows are cut from long documents; the rest of each
document goes to the fill level, or to a new window, that makes the sum over levels of squared counts of partially
filled windows smallest. Open windows are bounded: when they reach ``OPEN`` they, and at the end of the partition the
last ones, are poured together and cut anew, and the final remainder is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tunelens.llm.encoding import batches, encoder

WINDOW = 2048
OPEN = 4096
#: Sequences of one partition are numbered from partition << SEQUENCE_BITS.
SEQUENCE_BITS = 40
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, token_ids binary")


@dataclass(slots=True)
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


class SumOfSquares:
    """The level array and the open windows of one partition."""

    def __init__(self, window: int, first_sequence: int):
        self.window = window
        self.next = first_sequence
        self.levels = np.zeros(window + 1, np.int64)  # open windows by fill
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def level(self, size: int) -> int:
        """The fill level to place ``size`` on; 0 is a new window. Ties go to the fullest."""
        last = self.window - size
        counts = self.levels
        change = 2.0 * (counts[size + 1 : self.window + 1] - counts[1 : last + 1]) + 2
        if last >= 1:
            change[-1] = 1 - 2 * counts[last]  # a window that gets full leaves the array
            change[counts[1 : last + 1] == 0] = np.inf
            best = last - 1 - int(np.argmin(change[::-1]))
            if change[best] <= 2 * counts[size] + 1:
                return best + 1
        return 0

    def place(self, piece: Piece) -> list[list[Piece]]:
        """Windows that are full after ``piece``."""
        size = len(piece.ids)
        h = self.level(size)
        if h:
            held = self.open[h].pop()
            self.levels[h] -= 1
            self.n_open -= 1
        else:
            held = []
        held.append(piece)
        if h + size == self.window:
            return [held]
        self.open[h + size].append(held)
        self.levels[h + size] += 1
        self.n_open += 1
        return self.pour(False) if self.n_open >= OPEN else []

    def pour(self, last: bool) -> list[list[Piece]]:
        """All open windows poured together, fullest first, and cut into full ones; what is left over stays open or,
        at the end, is cut into powers of two."""
        pieces = [p for level in reversed(self.open) for held in level for p in held]
        self.open = [[] for _ in range(self.window + 1)]
        self.levels[:] = 0
        self.n_open = 0
        total = sum(len(p.ids) for p in pieces)
        cuts = [self.window] * (total // self.window)
        rest = total % self.window
        if last:
            cuts += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        elif rest:
            cuts.append(rest)
        out: list[list[Piece]] = []
        held: list[Piece] = []
        room = cuts[0] if cuts else 0
        for p in pieces:
            while len(p.ids):
                part = Piece(p.doc, p.start, p.ids[:room], p.doc_tokens)
                p = Piece(p.doc, p.start + len(part.ids), p.ids[room:], p.doc_tokens)
                held.append(part)
                room -= len(part.ids)
                if not room:
                    out.append(held)
                    held = []
                    room = cuts[len(out)] if len(out) < len(cuts) else 0
        if not last and rest:
            held = out.pop()
            self.open[rest].append(held)
            self.levels[rest] += 1
            self.n_open = 1
        return out

    def number(self) -> int:
        self.next += 1
        return self.next - 1


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = 1,
         keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids as
    little-endian unsigned 32-bit integers (null without ``keep_ids``).

    A null or empty text is the end id alone. Rows that repeat a doc_id are packed each on its own; a null doc_id stays
    null. The partitions of ``docs`` are packed independently, without a shuffle: every piece of a document and every
    sequence comes from one task, so a task that is run again replaces all of it. An empty table gives no rows; columns
    other than doc_id and text are not read.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        packer = SumOfSquares(window, TaskContext.get().partitionId() << SEQUENCE_BITS)
        for batch, texts in batches(rows):
            ids, ends, _, _ = coder.encode(texts)
            done: list[list[Piece]] = []
            at = 0
            for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                own = np.append(ids[at:end], np.uint32(end_id)).astype("<u4")
                at = end
                n = len(own)
                for start in range(0, n - window + 1, window):
                    done.append([Piece(doc, start, own[start : start + window], n)])
                if rest := n % window:
                    # A copy: the rest of a long document must not hold on to all of it.
                    done += packer.place(Piece(doc, n - rest, own[n - rest :].copy(), n))
            yield _record(done, packer, keep_ids)
        yield _record(packer.pour(True), packer, keep_ids)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _record(windows: list[list[Piece]], packer: SumOfSquares, keep_ids: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(8)]
    for held in windows:
        number, offset = packer.number(), 0
        for p in held:
            raw = p.ids.tobytes()
            row = (p.doc, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, number, offset, raw if keep_ids else None)
            for c, v in zip(columns, row):
                c.append(v)
            offset += len(p.ids)
    arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "token_ids"]
    return pa.RecordBatch.from_arrays(arrays, names)
