"""Packing documents into sequences by bounded-space best fit, on line.

Each task packs the documents of its partition as they come. A document longer than a sequence is cut into whole
sequences and a rest; every other document stays in one piece. A piece goes to the open bin with the least free space
that still holds it. The free spaces that open bins have are the set bits of one number, so that bin is the lowest bit
at or above the piece's length. At most ``open_bins`` bins are open: before one more is opened, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tunelens.llm.encoding import batches, encoder

WINDOW = 2048
OPEN_BINS = 4096
#: Sequences of one partition are numbered from partition << SEQUENCE_BITS.
SEQUENCE_BITS = 40
SCHEMA = (
    "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, "
    "token_ids binary")


class OpenBins:
    """The open bins of one partition by free space; a bin is its sequence number."""

    def __init__(self, window: int, limit: int, first_sequence: int):
        if limit < 1:
            raise ValueError("at least one bin has to be open")
        self.window, self.limit, self.next = window, limit, first_sequence
        self.free = 0  # bit f: some open bin has f tokens free
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def _take(self, space: int) -> int:
        held = self.bins[space]
        number = held.pop()
        if not held:
            self.free ^= 1 << space
        self.n_open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of ``size`` tokens."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if size < self.window and self.n_open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, number = self.window, self.next
            self.next += 1
        if rest := space - size:
            self.bins[rest].append(number)
            self.free |= 1 << rest
            self.n_open += 1
        return number, self.window - space


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = 0,
         open_bins: int = OPEN_BINS, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids as little-endian
    unsigned 32-bit integers (null without ``keep_ids``).

    A null or empty text is the end id alone. Rows that repeat a doc_id are packed each on its own; a null doc_id stays
    null. Among bins with equal free space the one that got it last is taken. The partitions of ``docs`` are packed
    independently, without a shuffle: every piece of a document and every sequence comes from one task, so a task that
    is run again replaces all of it. A task holds ``open_bins`` numbers and one batch of documents, however long they
    are in sum; each partition leaves at most ``open_bins`` sequences that later pieces might have filled, all but one
    of them at least half full unless that limit was reached. An empty table gives no rows; columns other than doc_id
    and text are not read.
    """
    if window < 1:
        raise ValueError("a sequence holds one token at least")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        bins = OpenBins(window, open_bins, TaskContext.get().partitionId() << SEQUENCE_BITS)
        for batch, texts in batches(rows):
            ids, ends, _, _ = coder.encode(texts)
            columns: list[list] = [[] for _ in range(8)]
            at = 0
            for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                own = np.append(ids[at:end], np.uint32(end_id)).astype("<u4")
                at = end
                for piece, start in enumerate(range(0, len(own), window)):
                    raw = own[start : start + window].tobytes()
                    length = len(raw) // 4
                    row = (doc, piece, start, length, zlib.crc32(raw), *bins.place(length), raw if keep_ids else None)
                    for c, v in zip(columns, row):
                        c.append(v)
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]] + [pa.array(columns[7], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
