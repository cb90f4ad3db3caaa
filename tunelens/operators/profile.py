"""Column profiles of a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.sources.arff import attributes_of

STATS = "min double, max double, mean double, stdev double"


def profile_numeric(df: DataFrame) -> DataFrame:
    """(name, pos, min, max, mean, population stdev) of every numeric column, in one pass over the rows."""
    names = [(i, a.name) for i, a in enumerate(attributes_of(df)) if not a.nominal]
    aggs = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(i).alias("pos"),
            F.min(name).cast("double").alias("min"),
            F.max(name).cast("double").alias("max"),
            F.avg(name).alias("mean"),
            F.stddev_pop(name).alias("stdev"),
        )
        for i, name in names
    ]
    return df.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def profile_nominal(df: DataFrame) -> DataFrame:
    """(name, pos, value, value_pos, n) for every declared value, zeros kept; an undeclared value fails the job."""
    spark = df.sparkSession
    declared = [
        (a.name, i, v, j) for i, a in enumerate(attributes_of(df)) if a.nominal for j, v in enumerate(a.domain)
    ]
    domain = spark.createDataFrame(declared, "name string, pos int, value string, value_pos int")
    names = list(dict.fromkeys(d[0] for d in declared))
    counted = df.select(*names).unpivot([], names, "name", "value").groupBy("name", "value").agg(F.count("*").alias("n"))
    undeclared = F.raise_error(F.concat(F.lit("undeclared value of "), "name", F.lit(": "), "value"))
    return (
        domain.join(counted, ["name", "value"], "full")
        .withColumn("pos", F.when(F.col("pos").isNull(), undeclared.cast("int")).otherwise(F.col("pos")))
        .select("name", "pos", "value", "value_pos", F.coalesce("n", F.lit(0)).alias("n"))
    )


def profile(df: DataFrame) -> DataFrame:
    """(name, pos, type, min, max, mean, stdev, domain, counts): the head-file view of a relation.

    ``domain`` keeps the declared order of the values, which a map does not promise.
    """
    attributes = attributes_of(df)
    parts = []
    if any(not a.nominal for a in attributes):
        parts.append(
            profile_numeric(df).select(
                "name", "pos", F.lit("numeric").alias("type"), "min", "max", "mean", "stdev",
                F.lit(None).cast("array<string>").alias("domain"),
                F.lit(None).cast("map<string,bigint>").alias("counts"),
            )
        )
    if any(a.nominal for a in attributes):
        nothing = [F.lit(None).cast("double").alias(s) for s in ("min", "max", "mean", "stdev")]
        entries = F.array_sort(F.collect_list(F.struct("value_pos", "value", "n")))  # one per declared value
        parts.append(
            profile_nominal(df)
            .groupBy("name", "pos")
            .agg(entries.alias("e"))
            .select(
                "name", "pos", F.lit("nominal").alias("type"), *nothing, F.col("e.value").alias("domain"),
                F.map_from_arrays("e.value", "e.n").alias("counts"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def feature_count(profile_df: DataFrame) -> DataFrame:
    """Number of features: attributes without the class."""
    return profile_df.agg((F.count("*") - 1).alias("features"))
