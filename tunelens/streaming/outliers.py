"""Outliers against the statistics of all earlier batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.operators.ordering import bounded
from tunelens.streaming import moments

LIMIT = 3.0


def _far(feature: str, mean: Column, m2: Column, n: Column, limit: float) -> Column:
    z = F.try_divide(F.abs(F.col(feature) - mean), F.sqrt(F.try_divide(m2, n)))
    return F.coalesce(z > limit, F.lit(False))


def _own_moments(features: list[str]) -> list[Column]:
    """Count, mean and squared deviations of each feature; Spark merges its moments pairwise."""
    out = []
    for f in features:
        n = F.count(f).cast("double")
        out += [n.alias(f"{f}_n"), F.avg(f).alias(f"{f}_mean"), (F.var_pop(f) * n).alias(f"{f}_m2")]
    return out


def flag_outliers(df: DataFrame, features: list[str], batch: str = "chunk_id", limit: float = LIMIT) -> DataFrame:
    """``df`` with ``outlier``: some feature lies more than ``limit`` deviations from its mean over earlier batches.

    Statistics are one row per batch; those of all earlier batches are joined back on the batch number. The first batch
    flags nothing, and a NULL neither stands out nor counts.
    """
    own = df.groupBy(batch).agg(*_own_moments(features))
    past = {f: moments.before(own, batch, f) for f in features}
    named = [c.alias(f"_{k}_{f}") for f in features for k, c in zip(("n", "mean", "m2"), past[f])]
    joined = df.join(bounded(own.select(batch, *named)), batch)
    far = F.lit(False)
    for f in features:
        far = far | _far(f, F.col(f"_mean_{f}"), F.col(f"_m2_{f}"), F.col(f"_n_{f}"), limit)
    return joined.select(*df.columns, far.alias("outlier"))


def outlier_counts(df: DataFrame, features: list[str], batch: str = "chunk_id", limit: float = LIMIT) -> DataFrame:
    return (
        flag_outliers(df, features, batch, limit)
        .groupBy(batch)
        .agg(F.count("*").alias("instances"), F.count_if("outlier").alias("outliers"))
    )


class OutlierDetector:
    """The same flags batch by batch, with the moments of all batches so far as its model."""

    row_schema = "instances bigint, outliers bigint"

    def __init__(self, features: list[str], limit: float = LIMIT):
        self.features, self.limit = features, limit
        self.past: dict[str, moments.Moments] = {f: (0.0, 0.0, 0.0) for f in features}

    def state(self) -> dict:
        return {"past": self.past}

    def load(self, state: dict) -> None:
        self.past = {f: tuple(m) for f, m in state["past"].items()}

    def flag(self, batch: DataFrame) -> DataFrame:
        far = F.lit(False)
        for f, (n, mean, m2) in self.past.items():
            if n:
                far = far | _far(f, F.lit(mean), F.lit(m2), F.lit(n), self.limit)
        return batch.withColumn("outlier", far)

    def step(self, batch: DataFrame) -> list[tuple[int, int]]:
        """(rows, outliers) of one batch: flags first, then its values join the past."""
        row = self.flag(batch).agg(F.count("*").alias("n"), F.count_if("outlier").alias("far"), *_own_moments(self.features)).first()
        for f in self.features:
            own = (row[f"{f}_n"], row[f"{f}_mean"] or 0.0, row[f"{f}_m2"] or 0.0)
            self.past[f] = moments.merge(self.past[f], own)
        return [(row["n"], row["far"])] if row["n"] else []

    def walk(self, rows: DataFrame, chunk: str, row: str) -> list[tuple]:
        """The steps of many batches in two jobs: the moments of every batch, and its flags by those of all before it."""
        own = rows.groupBy(F.col(chunk).cast("bigint").alias("_batch")).agg(*_own_moments(self.features))
        before = []
        for r in sorted(own.collect(), key=lambda r: r["_batch"]):  # a row per batch
            before.append((r["_batch"], *[v for f in self.features for v in self.past[f]]))
            for f in self.features:
                self.past[f] = moments.merge(self.past[f], (r[f"{f}_n"], r[f"{f}_mean"] or 0.0, r[f"{f}_m2"] or 0.0))
        names = [f"_{k}{i}" for i in range(len(self.features)) for k in ("n", "mean", "m2")]
        known = rows.sparkSession.createDataFrame(before, f"_batch bigint, {', '.join(f'{n} double' for n in names)}")
        joined = rows.withColumn("_batch", F.col(chunk).cast("bigint")).join(F.broadcast(known), "_batch")
        far = F.lit(False)
        for i, f in enumerate(self.features):
            stands_out = _far(f, F.col(f"_mean{i}"), F.col(f"_m2{i}"), F.col(f"_n{i}"), self.limit)
            far = far | ((F.col(f"_n{i}") != 0) & stands_out)
        counts = joined.groupBy("_batch").agg(F.count("*").alias("n"), F.count_if(far).alias("far"))
        return sorted(tuple(r) for r in counts.collect())

    def report(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("batch").alias("chunk_id"), "instances", "outliers")
