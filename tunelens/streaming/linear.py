"""Linear models trained by mini-batch gradient descent, one Spark job per batch for any number of models."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.streaming.evaluate import Classifier

LOSSES = ("LogisticLoss", "SquaredLoss", "HingeLoss", "PerceptronLoss")
REGULARIZERS = ("ZeroRegularizer", "L1Regularizer", "L2Regularizer")


@dataclass(frozen=True)
class LinearOptions:
    """``num_features`` must equal the number of feature columns; ``lam`` is the learning rate."""

    num_features: int = 3
    lam: float = 0.01
    loss: str = "LogisticLoss"
    regularizer: str = "ZeroRegularizer"
    reg_param: float = 0.001

    def __post_init__(self):
        if self.loss not in LOSSES or self.regularizer not in REGULARIZERS:
            raise ValueError(f"unknown loss or regularizer: {self.loss}, {self.regularizer}")


class LinearLearner(Classifier):
    """Named linear models over the same features and a label column of class indices.

    With ``classes`` each name becomes a one-against-rest set: a model per class, the highest score wins, ties to the
    lower class. Otherwise a score above 0 predicts class 1.
    """

    def __init__(self, features: list[str], options: dict[str, LinearOptions], classes: int | None = None):
        for name, o in options.items():
            if o.num_features != len(features):
                raise ValueError(f"{name}: {o.num_features} features declared, {len(features)} given")
        self.features, self.options, self.classes = features, options, classes
        width = len(features) + 1
        self.weights = {(name, c): [0.0] * width for name in options for c in range(classes or 1)}

    def state(self) -> dict:
        weights = [[name, c, w] for (name, c), w in self.weights.items()]
        return {"options": {n: asdict(o) for n, o in self.options.items()}, "weights": weights}

    def load(self, state: dict) -> None:
        self.weights = {(name, c): w for name, c, w in state["weights"]}

    def _models(self, names: list[str]) -> Column:
        """(member, loss, w) of the named models; ``w`` holds slopes and bias by class. One literal, so that the
        generated code stays the same from batch to batch."""
        table = [
            {"member": n, "loss": self.options[n].loss, "w": [self.weights[n, c] for c in range(self.classes or 1)]}
            for n in names
        ]
        schema = "array<struct<member: string, loss: string, w: array<array<double>>>>"
        return F.from_json(F.lit(json.dumps(table)), schema)

    def _score(self, cls: int) -> str:
        terms = [f"w[{cls}][{len(self.features)}]"]
        terms += [f"w[{cls}][{i}] * `{f}`" for i, f in enumerate(self.features)]
        return " + ".join(terms)

    def _scored(self, batch: DataFrame, names: list[str]) -> DataFrame:
        """One row per (row, model) with the scores by class and the prediction."""
        scores = ", ".join(self._score(c) for c in range(self.classes or 1))
        guess = "scores[0] > 0" if self.classes is None else "array_position(scores, array_max(scores)) - 1"
        return (
            batch.select("*", F.inline(self._models(names)))
            .withColumn("scores", F.expr(f"array({scores})"))
            .withColumn("prediction", F.expr(f"CAST({guess} AS INT)"))
            .drop("w")
        )

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        return self._scored(df, [name]).select(*df.columns, "prediction")

    def versions(self, batch: int) -> list[tuple]:
        """The models in force before ``batch``: (batch, member, w) with slopes and bias by class."""
        return [(batch, n, [self.weights[n, c] for c in range(self.classes or 1)]) for n in self.options]

    def predict_by_version(self, rows: DataFrame, versions: DataFrame, batch: str = "chunk_id") -> DataFrame:
        """``rows`` with ``member`` and ``prediction``, each row judged by the models in force before its batch.

        ``versions`` has a row per member and batch, or one for several batches on: the last one not after the row's
        batch is in force. Models meet rows on their batch, so no model gathers the rows of many batches.
        """
        later = Window.partitionBy("member").orderBy("batch")
        spans = versions.withColumn("until", F.lead("batch").over(later) - 1)
        # Chunk numbers are few beside rows: each is given its version before rows meet versions.
        numbers = rows.select(F.col(batch).alias("_at")).distinct()
        in_force = (F.col("batch") <= F.col("_at")) & (F.coalesce("until", F.col("_at")) >= F.col("_at"))
        dealt = numbers.join(spans, in_force).select(F.col("_at").alias(batch), "member", "w")
        scores = ", ".join(self._score(c) for c in range(self.classes or 1))
        guess = "scores[0] > 0" if self.classes is None else "array_position(scores, array_max(scores)) - 1"
        filled = rows.fillna(0.0, self.features)
        judged = filled.join(dealt, batch).withColumn("scores", F.expr(f"array({scores})"))
        return judged.select(*rows.columns, "member", F.expr(f"CAST({guess} AS INT)").alias("prediction"))

    def step(self, batch: DataFrame) -> list[tuple[str, int, int, int]]:
        """Predict with the current weights, count (name, label, prediction, n), then train.

        Scores, counts and gradient sums of all models come from one aggregation. A NULL feature counts as 0; rows
        without a label are left out.
        """
        known = batch.where("label IS NOT NULL").fillna(0.0, self.features)
        rows = self._scored(known.select(*self.features, "label"), list(self.options))
        if self.classes is None:
            each = rows.selectExpr("*", "0 AS cls", "scores[0] AS s", "CAST(label AS DOUBLE) AS y")
        else:
            each = rows.selectExpr("*", "posexplode(scores) AS (cls, s)").selectExpr("*", "CAST(label = cls AS DOUBLE) AS y")
        sums = (
            each.drop("scores")
            .withColumn("slope", F.expr(SLOPE))
            .groupBy("member", "cls", "label", "prediction")
            .agg(
                F.count("*").alias("n"),
                F.expr(f"array({', '.join(f'sum(slope * `{f}`)' for f in self.features)}, sum(slope)) AS gradient"),
            )
        )
        return self._learn(sums.collect())  # at most members * classes^3 rows

    def walk(self, rows: DataFrame, chunk: str, row: str) -> list[tuple]:
        """The steps of many batches, models dealt to tasks."""
        from tunelens.streaming import linearreplay

        return linearreplay.walk(self, rows, chunk, row)

    def _learn(self, rows) -> list[tuple[str, int, int, int]]:
        seen = {key: 0 for key in self.weights}
        gradient = {key: [0.0] * len(w) for key, w in self.weights.items()}
        counts: dict[tuple[str, int, int], int] = {}
        for r in sorted(rows, key=lambda r: (r["member"], r["cls"], r["label"], r["prediction"])):
            key = (r["member"], r["cls"])
            seen[key] += r["n"]
            gradient[key] = [a + b for a, b in zip(gradient[key], r["gradient"])]
            if r["cls"] == 0:
                counts[r["member"], r["label"], r["prediction"]] = r["n"]
        for key, n in seen.items():
            if n:
                self.weights[key] = descend(self.weights[key], [g / n for g in gradient[key]], self.options[key[0]])
        return [(*key, n) for key, n in counts.items()]


# Derivative of the loss by the score, per row.
SLOPE = """CASE loss WHEN 'LogisticLoss' THEN 1.0D / (1.0D + exp(-s)) - y
    WHEN 'SquaredLoss' THEN s - (2 * y - 1)
    WHEN 'HingeLoss' THEN IF((2 * y - 1) * s < 1, 1 - 2 * y, 0.0D)
    ELSE IF((2 * y - 1) * s <= 0, 1 - 2 * y, 0.0D) END"""


def descend(weights: list[float], gradient: list[float], o: LinearOptions) -> list[float]:
    *slopes, bias = weights
    penalty = {
        "ZeroRegularizer": lambda w: 0.0,
        "L1Regularizer": lambda w: float((w > 0) - (w < 0)),
        "L2Regularizer": lambda w: w,
    }[o.regularizer]
    moved = [w - o.lam * (g + o.reg_param * penalty(w)) for w, g in zip(slopes, gradient)]
    return [*moved, bias - o.lam * gradient[-1]]
