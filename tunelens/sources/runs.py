"""Files a tuning run leaves behind: metrics, results, configuration and learner logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.functions.scalars import to_percent
from tunelens.operators.ordering import number_rows

METRICS_HEADER = "batch_time string, instances string, accuracy string, recall string, precision string, f1 string"


def _line_order() -> Column:
    """Line order inside one file, the same on every attempt of a task."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    )


def run_key(path: Column) -> list[Column]:
    """(exp, hp) from ``.../s<k>/<hp>.<extension>`` or the partitioned layout ``exp=s<k>/hp=<hp>/``."""
    return [
        F.regexp_extract(path, r"/(?:exp=)?s(\d+)/(?:hp=)?[^/]+", 1).cast("int").alias("exp"),
        F.regexp_extract(path, r"/(?:exp=)?s\d+/(?:hp=)?([^/]+?)(?:\.(?:csv|log))?(?:/[^/]*)?$", 1).alias("hp"),
    ]


def read_metrics_csv(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """(exp, hp, batch, instances, accuracy, recall, precision, f1) in percent; ``batch`` is the line number from 0."""
    raw = (
        spark.read.option("recursiveFileLookup", "true")
        .schema(METRICS_HEADER)
        .csv(path, header=header, enforceSchema=True)
    )
    rows = raw.select(
        *run_key(F.col("_metadata.file_path")),
        _line_order().alias("ord"),
        F.col("instances").cast("double").cast("bigint").alias("instances"),
        *[to_percent(F.col(m).cast("double")).alias(m) for m in ("accuracy", "recall", "precision", "f1")],
    )
    return number_rows(rows, ["exp", "hp"], ["ord"], "batch").withColumn("batch", F.col("batch") - 1).drop("ord")


def write_metrics_csv(metrics: DataFrame, path: str, header: bool = True) -> None:
    """CSV files, with a header or without, in one folder per run, fractions as the learners emit them.

    Rows are cut by range: a long run spreads over several files whose names follow the batch order.
    """
    (
        metrics.repartitionByRange("exp", "hp", "batch")
        .sortWithinPartitions("exp", "hp", "batch")
        .select("exp", "hp", F.col("batch").alias("batch_time"), "instances", "accuracy", "recall", "precision", "f1")
        .write.partitionBy("exp", "hp")
        .csv(path, header=header)
    )


# Result file titles by column name.
RESULT_TITLES = {
    "exp": "Configuration",
    "depth": "HT Depth",
    "accuracy": "Accuracy (%)",
    "norm_accuracy": "Normalized Accuracy (%)",
    "overall_accuracy": "Overall Accuracy (%)",
    "norm_overall_accuracy": "Normalized Overall Accuracy (%)",
    "f1": "F1-Score (%)",
    "norm_f1": "Normalized F1-Score (%)",
    "job_ms": "Average Job Time (sec)",
    "norm_job_ms": "Normalized Average Job Time (%)",
    "task_ms": "Average Task Time (sec)",
    "norm_task_ms": "Normalized Average Task Time (%)",
    "norm_joined_time": "Average Normalized Time Joined (%)",
}
# Titles of the cluster result file.
CLUSTER_TITLES = {
    "instances": "Instances",
    "accuracy": "Accuracy (%)",
    "norm_accuracy": "Normalized Accuracy (%)",
    "recall": "Recall (%)",
    "norm_recall": "Normalized Recall (%)",
    "precision": "Precision (%)",
    "norm_precision": "Normalized Precision (%)",
    "f1": "F1-Score (%)",
    "norm_f1": "Normalized F1-Score (%)",
    "jobs": "Jobs (Count)",
    "job_ms": "Job Time (ms)",
    "norm_job_ms": "Normalized Job Time (%)",
    "tasks": "Tasks (Count)",
    "task_ms": "Task Time (ms)",
    "norm_task_ms": "Normalized Task Time (%)",
    "norm_joined_time": "Normalized Time Joined (%)",
}


def write_results_csv(results: DataFrame, path: str, keys: list[str], model: str = "ht") -> None:
    """``;`` CSV with the hyper-parameter ``keys`` first. Models: ht, sgd (no tree depth), cluster."""
    if model == "cluster":
        columns = [F.concat(F.lit("s"), F.col("exp")).alias("ExpID"), *keys]
        columns += [F.col(c).alias(t) for c, t in CLUSTER_TITLES.items()]
    else:
        titles = {c: t for c, t in RESULT_TITLES.items() if not (model == "sgd" and c == "depth")}
        columns = [*keys, *[F.col(c).alias(t) for c, t in titles.items()]]
    (
        results.repartitionByRange("hp_idx", "exp")
        .sortWithinPartitions("hp_idx", "exp")
        .select(*columns)
        .write.option("sep", ";")
        .csv(path, header=True)
    )


def read_results_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A result file of any layout: the key columns as text, the others under our names, ``exp`` as a number.

    The layout is told by its first title: ``ExpID`` with values like ``s1`` in cluster files, ``Configuration`` after
    the keys in the others. Time titles may say ``(ms)`` or ``(sec)``.
    """
    raw = spark.read.option("sep", ";").csv(path, header=True)
    cluster = "ExpID" in raw.columns
    titles = {t: c for c, t in (CLUSTER_TITLES if cluster else RESULT_TITLES).items()}
    titles |= {t.replace("(sec)", "(ms)"): c for t, c in titles.items()}
    wanted = {t: titles[t] for t in raw.columns if t in titles and titles[t] != "exp"}
    exp = F.regexp_extract("ExpID", r"^s([0-9]+)$", 1) if cluster else F.col(RESULT_TITLES["exp"])
    keys = [c for c in raw.columns if c not in titles and c != "ExpID"]
    return raw.select(exp.cast("int").alias("exp"), *keys, *[F.col(f"`{t}`").cast("double").alias(c) for t, c in wanted.items()])


def read_results_columns(
    spark: SparkSession, path: str | list[str], conf: int, accuracy: int, overall_accuracy: int, job: int, task: int
) -> DataFrame:
    """A result file by column numbers from 0: the columns before ``conf`` are keys, as text."""
    raw = spark.read.option("sep", ";").csv(path, header=True)
    numbers = {"accuracy": accuracy, "overall_accuracy": overall_accuracy, "job_ms": job, "task_ms": task}
    values = [F.col(f"`{raw.columns[i]}`").cast("double").alias(c) for c, i in numbers.items()]
    exp = F.col(f"`{raw.columns[conf]}`").cast("int").alias("exp")
    return raw.select(*raw.columns[:conf], exp, *values)


def read_spark_conf(spark: SparkSession, path: str) -> DataFrame:
    """(exp, key, value) of each setting; comments and empty lines are dropped, any other shape is an error."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    exp = F.regexp_extract("_metadata.file_path", r"/(?:exp=)?s?(\d+)/[^/]+$", 1).try_cast("int").alias("exp")
    kept = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    tokens = F.split(F.trim("value"), r"\s+")
    checked = F.when(F.size(tokens) == 2, tokens).otherwise(
        F.raise_error(F.concat(F.lit("not a key and a value: "), F.col("value")))
    )
    return kept.select(exp, checked.alias("t")).select("exp", F.col("t")[0].alias("key"), F.col("t")[1].alias("value"))


def read_tree_depth(spark: SparkSession, path: str) -> DataFrame:
    """(exp, hp, depth): the deepest tree each learner log mentions, 0 if it mentions none."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    depth = F.regexp_extract("value", r"depth: (\d+) \|", 1).try_cast("int")
    return (
        lines.select(*run_key(F.col("_metadata.file_path")), depth.alias("depth"))
        .groupBy("exp", "hp")
        .agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))
    )
