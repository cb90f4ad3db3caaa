"""Linear models over a whole replay: the batches of a block are learnt in one job.

A model of a batch needs the one before it, so batches follow one another; models do not need each other. The rows of a
block of batches are dealt to groups of models, and each group walks through the block batch by batch where its rows are,
as :meth:`LinearLearner.step` would. A block is bounded by its rows, so a task holds one batch and has passed one block
when it ends; a chunk beyond that bound is stepped through instead, where its rows are summed in many tasks.

Of each batch a model notes its weights before it and the counts by label and prediction; these are written. Only the
weights after a block reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.session import dropped, scratch_path
from tunelens.sources.replay import Replay
from tunelens.streaming.linear import LinearLearner, descend

#: Rows of a block of batches, and of the largest batch that is taken in one task.
BLOCK_ROWS = 200_000

_WALKED = "batch bigint, member string, w array<array<double>>, labels array<int>, predictions array<int>, ns array<bigint>"


def in_blocks(learner, replay: Replay) -> bool:
    return isinstance(learner, LinearLearner) and replay.chunk <= BLOCK_ROWS


class _Group:
    """Models on their way through the batches of a block; ``w`` is (model, class, slopes and bias)."""

    def __init__(self, learner: LinearLearner, names: list[str], weights: dict):
        self.classes = learner.classes
        self.names, self.options = names, [learner.options[n] for n in names]
        self.w = np.array([[weights[n, c] for c in range(self.classes or 1)] for n in names], dtype=float)

    def step(self, batch: int, x: np.ndarray, label: np.ndarray) -> list[tuple]:
        """Rows of one batch: judged by the models as they are, then learnt."""
        seen, own = np.unique(label, return_inverse=True)
        out = []
        for m, (name, o) in enumerate(zip(self.names, self.options)):
            w = self.w[m]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = []
                for c in range(len(w)):
                    # The terms in the order of the expression that a step evaluates.
                    s = np.full(len(x), w[c, -1])
                    for i in range(x.shape[1]):
                        s = s + w[c, i] * x[:, i]
                    scores.append(s)
                if self.classes is None:
                    guess, width = ~(scores[0] <= 0), 2  # not a number counts as above 0, as in SQL
                else:
                    guess, width = np.argmax(np.stack(scores), axis=0), len(w)
                key = own * width + guess
                n = np.bincount(key, minlength=len(seen) * width)
                met = np.flatnonzero(n)
                labels, predictions = seen[met // width], met % width
                out.append((batch, name, w.tolist(), labels.tolist(), predictions.tolist(), n[met].tolist()))
                moved = []
                for c, s in enumerate(scores):
                    y = label.astype(float) if self.classes is None else (label == c).astype(float)
                    slope = _slope(o.loss, s, y)
                    sums = [np.bincount(key, slope * x[:, i], len(n)) for i in range(x.shape[1])]
                    sums.append(np.bincount(key, slope, len(n)))
                    gradient = [sum(v[met].tolist(), 0.0) / len(x) for v in sums]
                    moved.append(descend(w[c].tolist(), gradient, o))
            self.w[m] = moved
        return out


def _slope(loss: str, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What ``linear.SLOPE`` states."""
    if loss == "LogisticLoss":
        return 1.0 / (1.0 + np.exp(-s)) - y
    sign = 2 * y - 1
    if loss == "SquaredLoss":
        return s - sign
    return np.where(sign * s < 1 if loss == "HingeLoss" else sign * s <= 0, -sign, 0.0)


def _walk(learner: LinearLearner, groups: list[list[str]], end: int):
    """Groups of models through the rows of their block, which come sorted by group and row."""
    weights, n_features = dict(learner.weights), len(learner.features)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        doubles = pa.list_(pa.list_(pa.float64()))
        schema = pa.schema([
            ("batch", pa.int64()), ("member", pa.string()), ("w", doubles), ("labels", pa.list_(pa.int32())),
            ("predictions", pa.list_(pa.int32())), ("ns", pa.list_(pa.int64()))])

        def packed(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        group: _Group | None = None
        at: tuple[int, int] | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def closed():
            x, label = (np.concatenate(parts) for parts in zip(*held))
            return packed(group.step(at[1], x, label))

        def left():
            return packed([(end, name, w.tolist(), [], [], []) for name, w in zip(group.names, group.w)])

        for table in batches:
            if not table.num_rows:
                continue
            columns = [table.column(c).to_numpy(zero_copy_only=False) for c in ("g", "batch", "label")]
            x = np.column_stack([table.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(n_features)])
            g, batch, label = columns
            starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (batch[1:] != batch[:-1])])
            for i, j in zip(starts, [*starts[1:], len(g)]):
                key = int(g[i]), int(batch[i])
                if key != at:
                    if held:
                        yield closed()
                    if at is None or key[0] != at[0]:
                        if group is not None:
                            yield left()
                        group = _Group(learner, groups[key[0]], weights)
                    at, held = key, []
                held.append((x[i:j], label[i:j]))
        if held:
            yield closed()
            yield left()

    return run


def _learn_block(learner: LinearLearner, rows: DataFrame, end: int, path: str) -> None:
    """Write what the models note of the batches of a block; the learner has their weights after it. ``rows`` hold batch, row,
    label and features."""
    spark, names = rows.sparkSession, list(learner.options)
    n_groups = min(len(names), spark.sparkContext.defaultParallelism)
    groups = [names[i::n_groups] for i in range(n_groups)]
    features = [F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(learner.features)]
    rows = rows.where("label IS NOT NULL").fillna(0.0, learner.features)
    rows = rows.select("batch", "row", F.col("label").cast("int").alias("label"), *features)
    dealt = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    in_turn = dealt.repartitionByRange(n_groups, "g").sortWithinPartitions("g", "batch", "row")
    in_turn.mapInArrow(_walk(learner, groups, end), _WALKED).write.parquet(path)
    after = spark.read.schema(_WALKED).parquet(path).where(F.size("labels") == 0)
    for r in after.select("member", "w").collect():  # a row per model
        for c, w in enumerate(r["w"]):
            learner.weights[r["member"], c] = list(w)


def walked(learner: LinearLearner, replay: Replay) -> DataFrame:
    """(batch, member, w, labels, predictions, ns): of every batch with labelled rows each model's weights before it, and
    its counts. The learner ends as if it had stepped through the batches."""
    spark = replay.ordered.table.sparkSession
    length = BLOCK_ROWS // replay.chunk
    path = scratch_path(spark, "walked")
    for start in range(0, len(replay), length):
        end = min(len(replay), start + length)
        _learn_block(learner, replay.numbered("row", "batch", start, end), end, f"{path}/{start}")
    if not len(replay):
        return spark.createDataFrame([], _WALKED)
    blocks = [f"{path}/{start}" for start in range(0, len(replay), length)]
    return spark.read.schema(_WALKED).parquet(*blocks).where(F.size("labels") > 0)


def walk(learner: LinearLearner, rows: DataFrame, chunk: str, row: str) -> list[tuple]:
    """(batch, member, label, prediction, n) of the chunks of ``rows``, which are learnt."""
    spark = rows.sparkSession
    path = scratch_path(spark, "walked")
    named = rows.select(F.col(chunk).cast("bigint").alias("batch"), F.col(row).alias("row"), "label", *[f"`{f}`" for f in learner.features])
    _learn_block(learner, named, -1, path)
    noted = spark.read.schema(_WALKED).parquet(path).where(F.size("labels") > 0)
    seen = [tuple(r) for r in confusion_of(noted).collect()]  # members * classes^2 rows a batch at the most
    dropped(spark, path)
    return seen


def confusion_of(rows: DataFrame) -> DataFrame:
    """(batch, member, label, prediction, n) of walked batches."""
    counts = F.inline(F.arrays_zip("labels", "predictions", "ns")).alias("label", "prediction", "n")
    return rows.select("batch", "member", counts)
