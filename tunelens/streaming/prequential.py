"""Test-then-train runs over replays."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from tunelens.session import scratch_path
from tunelens.sources.replay import Replay
from tunelens.streaming import linearreplay, treewalk, walks
from tunelens.streaming.clustering import StreamingKMeans
from tunelens.streaming.linear import LinearLearner, LinearOptions
from tunelens.streaming.outliers import OutlierDetector
from tunelens.streaming.treereplay import in_blocks, run_replay
from tunelens.streaming.trees import Forest, OneVsRestTrees, TreeLearner, TreeOptions


class Learner(Protocol):
    """What runs and streams need of a learner, whatever it learns."""

    #: Columns of the rows that a step returns.
    row_schema: str

    def state(self) -> dict: ...

    def load(self, state: dict) -> None: ...

    def step(self, batch: DataFrame) -> list[tuple]:
        """Judge a batch with the model as it is, then train it; a few rows of what was seen."""

    # A learner may have ``walk``, too: see :mod:`tunelens.streaming.walks`.

    def report(self, rows: DataFrame, **options: Any) -> DataFrame:
        """Metrics of the rows of any number of steps, with their ``batch``."""


# Learners by name; each is built from its feature list and keyword options.
LEARNERS = {
    "sgd": LinearLearner, "ht": TreeLearner, "mc": OneVsRestTrees, "rf": Forest, "kmeans": StreamingKMeans,
    "outliers": OutlierDetector,
}

#: Rows of steps that wait on the driver before they are written.
PENDING_ROWS = 10_000


class StepLog:
    """Rows of steps by batch; all but the last few lie in a table."""

    def __init__(self, spark: SparkSession, row_schema: str):
        self.spark, self.schema = spark, f"batch bigint, {row_schema}"
        self.path: str | None = None
        self.pending: list[tuple] = []

    def add(self, batch: int, rows: list[tuple]) -> None:
        self.extend([(batch, *r) for r in rows])

    def extend(self, rows: list[tuple]) -> None:
        """Rows of any batches, the number of the batch in front."""
        self.pending += rows
        if len(self.pending) >= PENDING_ROWS:
            self.path = self.path or scratch_path(self.spark, "steps")
            self.spark.createDataFrame(self.pending, self.schema).coalesce(1).write.mode("append").parquet(self.path)
            self.pending = []

    def table(self) -> DataFrame:
        rows = self.spark.createDataFrame(self.pending, self.schema)
        return rows.unionByName(self.spark.read.schema(self.schema).parquet(self.path)) if self.path else rows


def prequential(spark: SparkSession, replay: Replay, learner: Learner, evaluator: str | None = None, **options) -> DataFrame:
    """Metrics of every batch: it is judged by the model before it, then trains it. ``options`` go to the report.

    Only counts, and model sums or splits that won, reach the driver. Learners that can take many batches in one job do so.
    """
    if evaluator:
        options["evaluator"] = evaluator
    if treewalk.in_tasks(learner, replay):
        return learner.report(treewalk.run(learner, replay), **options)
    if in_blocks(learner):
        return learner.report(run_replay(learner, replay), **options)
    if linearreplay.in_blocks(learner, replay):
        return learner.report(linearreplay.confusion_of(linearreplay.walked(learner, replay)), **options)
    log = StepLog(spark, learner.row_schema)
    if walks.in_blocks(learner, replay):
        for rows in walks.walked(learner, replay):
            log.extend(rows)
    else:
        for i, batch in replay:
            log.add(i, learner.step(batch))
    return learner.report(log.table(), **options)


def prequential_rows(spark: SparkSession, replay: Replay, learner: LinearLearner) -> DataFrame:
    """Every replayed row with the prediction of each model as it was before the row's batch.

    The models of all batches are a table; one pass over the rows judges them, and nothing about rows is kept while the
    learner runs.
    """
    rows = replay.table().where("label IS NOT NULL")
    if linearreplay.in_blocks(learner, replay):
        return learner.predict_by_version(rows, linearreplay.walked(learner, replay).select("batch", "member", "w"))
    log = StepLog(spark, "member string, w array<array<double>>")
    for i, batch in replay:
        log.add(i, [v[1:] for v in learner.versions(i)])
        learner.step(batch)
    return learner.predict_by_version(rows, log.table())


def sgd_grid(features: list[str], settings: list[dict]) -> LinearLearner:
    """All linear settings of a grid in one learner; ``settings`` are rows of the grid with keys l, o, r, p."""
    options = {
        s["hp"]: LinearOptions(len(features), float(s["l"]), s["o"], s["r"], float(s["p"])) for s in settings
    }
    return LinearLearner(features, options)


def tree_grid(features, classes: int, settings: list[dict]) -> TreeLearner:
    """All tree settings of a grid in one learner; ``settings`` are rows of the grid with keys c, t, g, s, d."""
    options = {
        s["hp"]: TreeOptions(
            confidence=float(s["c"]), tie=float(s["t"]), grace=float(s["g"]), criterion=s["s"], max_depth=int(s["d"])
        )
        for s in settings
    }
    return TreeLearner(features, classes, options)
