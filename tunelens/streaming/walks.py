"""Many chunks of rows learnt in a few jobs, one chunk after another, by learners that can walk through them.

A learner that walks has ``walk(rows, chunk, row)``: it judges and learns the chunks of ``rows`` in their order, as its
``step`` would take them one by one, and returns the rows of these steps with the number of their chunk in front. ``chunk``
and ``row`` name the columns that hold the number of a row's chunk and its place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.sources.replay import Replay

#: Rows of the largest chunk that one task holds; a larger one is stepped through, its rows summed in many tasks.
CHUNK_ROWS = 200_000
#: Rows of a replay that are walked through by one job.
WALK_ROWS = 1_000_000


def walks(learner) -> bool:
    inner = getattr(learner, "learner", learner)  # behind an extractor
    return hasattr(learner, "walk") and hasattr(inner, "walk")


def walk(learner, rows: DataFrame, chunk: str) -> list[tuple]:
    """Judge and learn the chunks of ``rows`` in the order of their numbers; a few rows per chunk, its number in front."""
    sizes = sorted(tuple(r) for r in rows.groupBy(chunk).count().collect())  # a row per chunk
    if walks(learner) and all(n <= CHUNK_ROWS for _, n in sizes):
        return learner.walk(rows.withColumn("_row", F.monotonically_increasing_id()), chunk, "_row") if sizes else []
    out = []
    for number, _ in sizes:
        out += [(number, *r) for r in learner.step(rows.where(F.col(chunk) == number).drop(chunk))]
    return out


def in_blocks(learner, replay: Replay) -> bool:
    return walks(learner) and replay.chunk <= CHUNK_ROWS


def walked(learner, replay: Replay) -> Iterator[list[tuple]]:
    """The rows of the steps of a replay, block by block."""
    length = max(1, WALK_ROWS // replay.chunk)
    for start in range(0, len(replay), length):
        yield learner.walk(replay.numbered("_row", "_chunk", start, min(len(replay), start + length)), "_chunk", "_row")
