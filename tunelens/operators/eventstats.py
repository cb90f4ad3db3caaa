"""Aggregates over the event-log tables.

Where several aggregates are wanted, give them one ``EventTables`` of the log, which builds each table once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.functions.scalars import run_time_ms
from tunelens.operators import eventtables as tables


def _run():
    return run_time_ms(F.col("launch_ms"), F.col("finish_ms"))


def _tasks(log: DataFrame | tables.EventTables, tasks: DataFrame | None) -> DataFrame:
    return tables.of(log).tasks if tasks is None else tasks


def task_summary(log: DataFrame | tables.EventTables, tasks: DataFrame | None = None) -> DataFrame:
    """Task counts, and run-time statistics over successful tasks. Anything but ``Success`` is a failure."""
    success = F.coalesce(F.col("end_reason") == "Success", F.lit(False))
    good = F.when(success, _run())
    return _tasks(log, tasks).groupBy("app_id").agg(
        F.count("*").alias("tasks"),
        F.count_if(success).alias("successes"),
        F.count_if(~success).alias("failures"),
        F.round(F.avg(good), 6).alias("avg_ms"),
        F.round(F.stddev_pop(good), 6).alias("std_ms"),
        F.min(good).alias("min_ms"),
        F.max(good).alias("max_ms"),
    )


def executor_summary(log: DataFrame | tables.EventTables, tasks: DataFrame | None = None) -> DataFrame:
    """Per executor: block managers, tasks and run-time statistics over every finished task."""
    task_stats = _tasks(log, tasks).groupBy("app_id", "executor_id").agg(
        F.count("*").alias("tasks"),
        F.round(F.avg(_run()), 6).alias("avg_ms"),
        F.round(F.stddev_pop(_run()), 6).alias("std_ms"),
        F.min(_run()).alias("min_ms"),
        F.max(_run()).alias("max_ms"),
    )
    managers = (
        tables.of(log).block_managers
        .where(F.col("executor_id") != "driver")
        .groupBy("app_id", "executor_id")
        .agg(F.count("*").alias("block_managers"))
    )
    key = ["app_id", "executor_id"]
    return (
        tables.of(log).executors
        .join(managers, key, "left")
        .join(task_stats, key, "left")
        .select(
            *key,
            "host",
            "cores",
            "start_ms",
            run_time_ms(F.col("start_ms"), F.col("remove_ms")).alias("run_ms"),
            F.coalesce("block_managers", F.lit(0)).alias("block_managers"),
            F.coalesce("tasks", F.lit(0)).alias("tasks"),
            "avg_ms",
            "std_ms",
            "min_ms",
            "max_ms",
            "remove_reason",
        )
    )


def job_summary(log: DataFrame | tables.EventTables) -> DataFrame:
    listed = tables.of(log).job_stages.groupBy("app_id", "job_id").agg(F.count("*").alias("stages"))
    return (
        tables.of(log).jobs
        .join(listed, ["app_id", "job_id"], "left")
        .select(
            "app_id",
            "job_id",
            "submission_ms",
            run_time_ms(F.col("submission_ms"), F.col("end_ms")).alias("run_ms"),
            "result",
            F.coalesce("stages", F.lit(0)).alias("stages"),
        )
    )


def _tasks_by_stage(log: DataFrame | tables.EventTables, tasks: DataFrame | None = None) -> DataFrame:
    # Tasks are reduced to one row per stage before they meet the jobs that list the stage.
    times = tables.of(log).task_times if tasks is None else tasks
    return times.groupBy("app_id", "stage_id").agg(
        F.count("*").alias("stage_tasks"), F.sum(_run()).alias("stage_task_ms")
    )


def stage_summary(log: DataFrame | tables.EventTables, tasks: DataFrame | None = None) -> DataFrame:
    """Declared and executed tasks of every (job, stage); a stage listed by several jobs counts for each."""
    return (
        tables.of(log).job_stages
        .join(_tasks_by_stage(log, tasks), ["app_id", "stage_id"], "left")
        .select(
            "app_id",
            "job_id",
            "stage_id",
            "name",
            "num_tasks",
            F.coalesce("stage_tasks", F.lit(0)).alias("executed_tasks"),
            run_time_ms(F.col("submission_ms"), F.col("completion_ms")).alias("run_ms"),
        )
    )


def entity_counts(log: DataFrame | tables.EventTables, tasks: DataFrame | None = None) -> DataFrame:
    """Jobs, tasks, executors and block managers of each application."""
    parts = [
        tables.of(log).jobs.select("app_id", F.lit("jobs").alias("entity")),
        _tasks(log, tasks).select("app_id", F.lit("tasks").alias("entity")),
        tables.of(log).executors.select("app_id", F.lit("executors").alias("entity")),
        tables.of(log).block_managers.select("app_id", F.lit("block_managers").alias("entity")),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    names = ["jobs", "tasks", "executors", "block_managers"]
    return stacked.groupBy("app_id").agg(*[F.count_if(F.col("entity") == n).alias(n) for n in names])


def avg_times(log: DataFrame | tables.EventTables, tasks: DataFrame | None = None) -> DataFrame:
    """Single-node view: mean run time of all jobs, mean run time of successful tasks to 2 decimals."""
    job_ms = tables.of(log).jobs.groupBy("app_id").agg(
        F.round(F.avg(run_time_ms(F.col("submission_ms"), F.col("end_ms"))), 6).alias("avg_job_ms")
    )
    good = F.when(F.col("end_reason") == "Success", _run())
    task_ms = _tasks(log, tasks).groupBy("app_id").agg(F.round(F.avg(good), 2).alias("avg_task_ms"))
    return job_ms.join(task_ms, "app_id", "left")


def _ignored_starts(log: DataFrame | tables.EventTables) -> DataFrame:
    receiver = "exists(s.`RDD Info`, r -> startswith(r.Name, 'Receiver'))"
    return tables.of(log).job_starts.where(F.expr(f"exists(stages, s -> s.`Number of Tasks` = 0 OR {receiver})"))


def ignored_jobs(log: DataFrame | tables.EventTables) -> DataFrame:
    """Jobs with a stage of zero tasks, or with an RDD whose name begins with ``Receiver``."""
    return _ignored_starts(log).select("app_id", "job_id")


def drop_receiver_and_empty_jobs(log: DataFrame | tables.EventTables) -> DataFrame:
    return tables.of(log).jobs.join(ignored_jobs(log), ["app_id", "job_id"], "left_anti")


def experiment_times(log: DataFrame | tables.EventTables) -> DataFrame:
    """Cluster view by (exp, hp), for logs kept as ``s<k>/<hp>``: ready to join with the metrics of the runs."""
    times = cluster_times(log)
    return times.select(
        F.regexp_extract("app_id", r"^s(\d+)/", 1).cast("int").alias("exp"),
        F.regexp_extract("app_id", r"^s\d+/(.+)$", 1).alias("hp"),
        "jobs",
        "job_ms",
        "tasks",
        "task_ms",
    )


def cluster_times(log: DataFrame | tables.EventTables, tasks: DataFrame | None = None) -> DataFrame:
    """Cluster view: counts and summed times over kept jobs, and over tasks outside the stages of ignored jobs."""
    job_side = (
        drop_receiver_and_empty_jobs(log)
        .groupBy("app_id")
        .agg(F.count("*").alias("jobs"), F.sum(run_time_ms(F.col("submission_ms"), F.col("end_ms"))).alias("job_ms"))
    )
    ignored_stages = _ignored_starts(log).select("app_id", F.explode("stages.`Stage ID`").alias("stage_id"))
    task_side = (
        _tasks_by_stage(log, tasks)
        .join(ignored_stages, ["app_id", "stage_id"], "left_anti")
        .groupBy("app_id")
        .agg(F.sum("stage_tasks").alias("tasks"), F.sum("stage_task_ms").alias("task_ms"))
    )
    return job_side.join(task_side, "app_id", "full")
