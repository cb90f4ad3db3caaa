"""Tables replayed as streams of count-based chunks, and watched folders."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from tunelens.operators.ordering import Ordered, in_order

CHUNK_SIZE = 10_000


class Replay:
    """Rows in order, cut into chunks of ``chunk`` records. ``limit`` ends the replay early; None replays all."""

    def __init__(self, ordered: Ordered, chunk: int, limit: int | None = None):
        self.ordered = ordered
        self.chunk = chunk
        self.rows = ordered.count if limit is None else min(limit, ordered.count)

    def __len__(self) -> int:
        return ceil(self.rows / self.chunk)

    def __iter__(self):
        for i in range(len(self)):
            yield i, self.batch(i)

    def batch(self, i: int) -> DataFrame:
        return self.ordered.slice(i * self.chunk, min((i + 1) * self.chunk, self.rows))

    def table(self) -> DataFrame:
        """All replayed rows with their chunk number."""
        return self.numbered("rn", "chunk_id").drop("rn")

    def numbered(self, row: str, chunk: str, first: int = 0, end: int | None = None) -> DataFrame:
        """The replayed rows, of the chunks [first, end) or of all, with their number, from 1, and their chunk number."""
        last = None if end is None else min(end * self.chunk, self.rows)
        rows = self.ordered.numbered(row, first * self.chunk, last).where(F.col(row) <= self.rows)
        return rows.withColumn(chunk, F.floor((F.col(row) - 1) / self.chunk))


def replay_file(df: DataFrame, order: str, chunk: int = CHUNK_SIZE, limit: int | None = None) -> Replay:
    """Replay ``df`` in ``order``, all of it unless the caller sets a ``limit``.

    The chunk does not depend on the table: a stream's first chunks are the same however many follow.
    """
    return Replay(in_order(df, order), chunk, limit)


def dir_partitions(df: DataFrame, order: str, max_count: int = 1000) -> DataFrame:
    """Records cut into partitions of at most ``max_count``."""
    rows = in_order(df, order).numbered("rn")
    return rows.withColumn("partition_id", F.floor((F.col("rn") - 1) / max_count)).drop("rn")


def dir_stream(
    spark: SparkSession, schema: str, max_files: int | None = None, max_bytes: str | None = None
) -> DataStreamReader:
    """Reader of a watched folder; admission is limited per micro-batch by files or bytes. Load any file format."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader
