"""Evaluators over (label, prediction) counts, and prequential metrics sampled along a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.functions.scalars import ratio_or_zero
from tunelens.operators.ordering import number_rows, running_sums

CONFUSION = ["label", "prediction", "n"]


def confusion(df: DataFrame, keys: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows per (keys, label, prediction): all an evaluator needs, reduced before any shuffle."""
    return df.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )


def _f1(precision: Column, recall: Column) -> Column:
    return ratio_or_zero(2 * precision * recall, precision + recall)


def basic_evaluator(counts: DataFrame, keys: list[str], positive: int = 1) -> DataFrame:
    """Accuracy, and recall, precision and F1 of the positive class; an undefined ratio is 0."""

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    is_true, is_predicted = F.col("label") == positive, F.col("prediction") == positive
    sums = counts.groupBy(*keys).agg(
        F.sum("n").alias("instances"),
        total(F.col("label") == F.col("prediction")).alias("_right"),
        total(is_true & is_predicted).alias("_tp"),
        total(is_true).alias("_p"),
        total(is_predicted).alias("_pp"),
    )
    return sums.select(
        *keys,
        "instances",
        ratio_or_zero(F.col("_right"), F.col("instances")).alias("accuracy"),
        ratio_or_zero(F.col("_tp"), F.col("_p")).alias("recall"),
        ratio_or_zero(F.col("_tp"), F.col("_pp")).alias("precision"),
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def extended_evaluator(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, and recall, precision and F1 averaged over the classes seen in truth or prediction."""
    right = F.col("label") == F.col("prediction")
    sides = counts.select(
        *keys, "n", right.alias("_right"), F.inline(
            F.array(
                F.struct(F.col("label").alias("cls"), F.lit(True).alias("_truth")),
                F.struct(F.col("prediction").alias("cls"), F.lit(False).alias("_truth")),
            )
        )
    )
    per_class = sides.groupBy(*keys, "cls").agg(
        F.sum(F.when(F.col("_truth") & F.col("_right"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_truth"), F.col("n")).otherwise(0)).alias("p"),
        F.sum(F.when(~F.col("_truth"), F.col("n")).otherwise(0)).alias("pp"),
    )
    scored = per_class.withColumns(
        {
            "recall": ratio_or_zero(F.col("tp"), F.col("p")),
            "precision": ratio_or_zero(F.col("tp"), F.col("pp")),
        }
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    return scored.groupBy(*keys).agg(
        F.sum("p").alias("instances"),
        ratio_or_zero(F.sum("tp"), F.sum("p")).alias("accuracy"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        F.avg("f1").alias("f1"),
    )


EVALUATORS = {"basic": basic_evaluator, "extended": extended_evaluator}


def classification_metrics(counts: DataFrame, keys: list[str], evaluator: str = "basic", **options) -> DataFrame:
    """Metrics of confusion counts, rounded to 6 digits."""
    rows = EVALUATORS[evaluator](counts, keys, **options)
    return rows.withColumns({m: F.round(m, 6) for m in ("accuracy", "recall", "precision", "f1")})


def sampled_metrics(
    df: DataFrame, keys: list[str], order: str, frequency: int = 1000, width: int = 1000, positive: int = 1
) -> DataFrame:
    """Metrics at every ``frequency`` rows of each stream, over all rows so far and over the last ``width`` rows.

    Sample k looks at rows up to k * frequency. Row r counts from the first sample that has reached it, and leaves the
    sliding view at the first sample that has passed it by ``width``; rows shrink to counts by these two numbers, a few
    per sample whatever the two lengths are. The sliding view is what has come in less what has left. Columns of the
    running view end in ``_all``, of the sliding view in ``_last``.
    """
    rows = number_rows(df.select(*keys, order, "label", "prediction"), keys, [order])
    counts = (
        rows.withColumn("came", F.ceil(F.col("rn") / F.lit(frequency)))
        .withColumn("left", F.ceil((F.col("rn") + width) / F.lit(frequency)))
        .groupBy(*keys, "came", "left", "label", "prediction")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys, "came", "left")
        .agg(*_tallies(positive))
    )

    def so_far(by: str) -> DataFrame:
        own = counts.groupBy(*keys, F.col(by).alias("sample")).agg(*[F.sum(c).alias(f"own_{c}") for c in TALLIES])
        return running_sums(own, keys, "sample", {c: F.col(f"own_{c}") for c in TALLIES}).select(*keys, "sample", *TALLIES)

    # A sample past the end of its stream has seen too few rows.
    running = so_far("came").where(F.col("t_n") == F.col("sample") * frequency)
    gone = so_far("left").withColumnsRenamed({c: f"gone_{c}" for c in TALLIES})
    both = running.join(gone, [*keys, "sample"], "left")
    sliding = both.select(*keys, "sample", *[(F.col(c) - F.coalesce(f"gone_{c}", F.lit(0))).alias(c) for c in TALLIES])
    return (
        _from_tallies(running, keys, "_all")
        .join(_from_tallies(sliding, keys, "_last"), [*keys, "sample"])
        .withColumn("rows", F.col("sample") * frequency)
    )


TALLIES = ["t_n", "t_right", "t_tp", "t_p", "t_pp"]


def _tallies(positive: int) -> list[Column]:
    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    is_true, is_predicted = F.col("label") == positive, F.col("prediction") == positive
    return [
        F.sum("n").alias("t_n"),
        total(F.col("label") == F.col("prediction")).alias("t_right"),
        total(is_true & is_predicted).alias("t_tp"),
        total(is_true).alias("t_p"),
        total(is_predicted).alias("t_pp"),
    ]


def _from_tallies(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    rows = df.select(
        *keys,
        "sample",
        F.col("t_n").alias("instances"),
        ratio_or_zero(F.col("t_right"), F.col("t_n")).alias("accuracy"),
        ratio_or_zero(F.col("t_tp"), F.col("t_p")).alias("recall"),
        ratio_or_zero(F.col("t_tp"), F.col("t_pp")).alias("precision"),
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    measures = ("accuracy", "recall", "precision", "f1")
    return rows.select(
        *keys, "sample", F.col("instances").alias(f"instances{suffix}"),
        *[F.round(m, 6).alias(f"{m}{suffix}") for m in measures],
    )


class Classifier:
    """Reports of learners whose steps return confusion counts: (member, label, prediction, n), a few rows per batch."""

    row_schema = "member string, label int, prediction int, n bigint"

    def report(self, rows: DataFrame, evaluator: str = "basic", **options) -> DataFrame:
        return classification_metrics(rows, ["member", "batch"], evaluator, **options)
