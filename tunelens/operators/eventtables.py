"""Entity tables rebuilt from an event log: applications, jobs, stages, RDDs, tasks, executors, block managers.

Every table is keyed by ``app_id`` so that any number of applications is handled in one pass. A start event and its
end event meet in a single aggregation on the entity key instead of a join: one shuffle, no skewed join side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.session import stored
from tunelens.sources.eventlog import parsed


class EventTables:
    """The entity tables of one log. With ``keep`` each is built once, when it is first asked for, and written; the log is
    then read once per table, however many results are made of it."""

    def __init__(self, log: DataFrame, keep: bool = True):
        self.log, self.keep = log, keep

    def _built(self, name: str, table: DataFrame) -> DataFrame:
        return stored(table, name) if self.keep else table

    @cached_property
    def applications(self) -> DataFrame:
        return self._built("applications", applications(self.log))

    @cached_property
    def jobs(self) -> DataFrame:
        return self._built("jobs", jobs(self.log))

    @cached_property
    def job_starts(self) -> DataFrame:
        return self._built("job-starts", job_starts(self.log))

    @cached_property
    def job_stages(self) -> DataFrame:
        return self._built("job-stages", job_stages(self.log, self.job_starts))

    @cached_property
    def tasks(self) -> DataFrame:
        return self._built("tasks", tasks(self.log))

    @property
    def task_times(self) -> DataFrame:
        """Of the tasks if they have been built, else by an aggregation that carries nothing but the times."""
        return self.tasks if "tasks" in self.__dict__ else task_times(self.log)

    @cached_property
    def executors(self) -> DataFrame:
        return self._built("executors", executors(self.log))

    @cached_property
    def block_managers(self) -> DataFrame:
        return self._built("block-managers", block_managers(self.log))


def of(log: DataFrame | EventTables) -> EventTables:
    """The tables of a log that is given with or without them."""
    return log if isinstance(log, EventTables) else EventTables(log, keep=False)


def _of(kind: str, value):
    return F.when(F.col("kind") == kind, value)


def _last(kind: str, value, name: str):
    return F.max_by(value, _of(kind, F.col("ord"))).alias(name)


def _first(kind: str, value, name: str):
    return F.min_by(value, _of(kind, F.col("ord"))).alias(name)


def applications(log: DataFrame) -> DataFrame:
    """One row per application; the end falls back to the start while no end event was written."""
    events = parsed(log, "LogStart", "EnvironmentUpdate", "ApplicationStart", "ApplicationEnd")
    props = F.col("e.`Spark Properties`")
    rows = events.groupBy("app_id").agg(
        _last("LogStart", F.col("e.`Spark Version`"), "spark_version"),
        _last("EnvironmentUpdate", F.col("e.`JVM Information`.`Java Version`"), "java_version"),
        _last("EnvironmentUpdate", props["spark.app.name"], "app_name"),
        _last("EnvironmentUpdate", props["spark.app.id"], "spark_app_id"),
        _last("EnvironmentUpdate", props["spark.executor.memory"], "executor_memory"),
        _last("EnvironmentUpdate", F.col("e.`System Properties`.`sun.java.command`"), "command_line"),
        _last("ApplicationStart", F.col("e.`Timestamp`"), "start_ms"),
        _last("ApplicationEnd", F.col("e.`Timestamp`"), "end_ms"),
    )
    return rows.withColumn("end_ms", F.coalesce("end_ms", "start_ms"))


def jobs(log: DataFrame) -> DataFrame:
    """First start of a job id wins; the last end counts if it follows that start; ends without a start are dropped."""
    events = parsed(log, "JobStart", "JobEnd").select(
        "app_id",
        "ord",
        "kind",
        F.col("e.`Job ID`").alias("job_id"),
        F.col("e.`Submission Time`").alias("submission_ms"),
        F.col("e.`Completion Time`").alias("completion_ms"),
        F.col("e.`Job Result`.`Result`").alias("result"),
    )
    rows = events.groupBy("app_id", "job_id").agg(
        F.min(_of("JobStart", F.col("ord"))).alias("start_ord"),
        F.max(_of("JobEnd", F.col("ord"))).alias("end_ord"),
        _first("JobStart", F.col("submission_ms"), "submission_ms"),
        _last("JobEnd", F.struct("completion_ms", "result"), "finish"),
    )
    ended = F.col("end_ord") > F.col("start_ord")
    return rows.where(F.col("start_ord").isNotNull()).select(
        "app_id",
        "job_id",
        "submission_ms",
        F.when(ended, F.col("finish.completion_ms")).alias("end_ms"),
        F.when(ended, F.col("finish.result")).alias("result"),
    )


def job_starts(log: DataFrame) -> DataFrame:
    """The first start of each job with its stage list as logged: (app_id, job_id, start_ord, stages)."""
    starts = parsed(log, "JobStart").select(
        "app_id", "ord", F.col("e.`Job ID`").alias("job_id"), F.col("e.`Stage Infos`").alias("stages")
    )
    return starts.groupBy("app_id", "job_id").agg(
        F.min("ord").alias("start_ord"), F.min_by("stages", "ord").alias("stages")
    )


def _listed_stages(starts: DataFrame) -> DataFrame:
    """Stages as listed by the first start of each job, with their position in the list."""
    return starts.select(
        "app_id", "job_id", "start_ord", F.posexplode("stages").alias("stage_pos", "s")
    ).select("app_id", "job_id", "start_ord", "stage_pos", F.col("s.`Stage ID`").alias("stage_id"), "s")


def job_stages(log: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Stages of every job with the times of the last completion that followed the job's start."""
    done = (
        parsed(log, "StageCompleted")
        .select("app_id", "ord", F.col("e.`Stage Info`").alias("i"))
        .groupBy("app_id", F.col("i.`Stage ID`").alias("stage_id"))
        .agg(
            F.max("ord").alias("done_ord"),
            F.max_by(
                F.struct(
                    F.col("i.`Submission Time`").alias("submission_ms"),
                    F.col("i.`Completion Time`").alias("completion_ms"),
                ),
                "ord",
            ).alias("done"),
        )
    )
    counts = F.col("done_ord") > F.col("start_ord")
    return (
        _listed_stages(job_starts(log) if starts is None else starts)
        .join(done, ["app_id", "stage_id"], "left")
        .select(
            "app_id",
            "job_id",
            "stage_id",
            "stage_pos",
            F.col("s.`Stage Name`").alias("name"),
            F.col("s.`Details`").alias("details"),
            F.col("s.`Number of Tasks`").alias("num_tasks"),
            F.when(counts, F.col("done.submission_ms")).alias("submission_ms"),
            F.when(counts, F.col("done.completion_ms")).alias("completion_ms"),
        )
    )


def stage_rdds(log: DataFrame | EventTables) -> DataFrame:
    return (
        _listed_stages(of(log).job_starts)
        .select("app_id", "job_id", "stage_id", "stage_pos", F.posexplode("s.`RDD Info`").alias("rdd_pos", "r"))
        .select(
            "app_id",
            "job_id",
            "stage_id",
            "stage_pos",
            "rdd_pos",
            F.col("r.`RDD ID`").alias("rdd_id"),
            F.col("r.`Name`").alias("name"),
            F.col("r.`Disk Size`").alias("disk_size"),
            F.col("r.`Memory Size`").alias("memory_size"),
            F.col("r.`Number of Partitions`").alias("partitions"),
            F.col("r.`Storage Level`.`Replication`").alias("replication"),
        )
    )


# Columns of a task as expressions over its start and end events.
_INFO, _METRICS = "e.`Task Info`", "e.`Task Metrics`"
_STARTED = {
    "stage_id": "e.`Stage ID`",
    "executor_id": f"{_INFO}.`Executor ID`",
    "launch_ms": f"{_INFO}.`Launch Time`",
    "locality": f"{_INFO}.`Locality`",
    "speculative": f"{_INFO}.`Speculative`",
}
_FINISHED = {
    "finish_ms": f"{_INFO}.`Finish Time`",
    "end_reason": "e.`Task End Reason`.`Reason`",
    "failed": f"{_INFO}.`Failed`",
    "getting_result_ms": f"{_INFO}.`Getting Result Time`",
    "index": f"{_INFO}.`Index`",
    "type": "e.`Task Type`",
    "metrics": f"""CASE WHEN {_METRICS} IS NOT NULL THEN struct(
        {_METRICS}.`Disk Bytes Spilled` AS disk_spilled_bytes,
        {_METRICS}.`Memory Bytes Spilled` AS memory_spilled_bytes,
        {_METRICS}.`Executor Deserialize Time` AS executor_deserialize_ms,
        {_METRICS}.`Executor Run Time` AS executor_run_ms,
        {_METRICS}.`JVM GC Time` AS jvm_gc_ms,
        {_METRICS}.`Result Serialization Time` AS result_serialize_ms,
        {_METRICS}.`Result Size` AS result_size) END""",
}


def _task_rows(log: DataFrame, started: dict, finished: dict) -> DataFrame:
    """Tasks with these columns of their last start, and of the last end if it follows that start."""
    events = parsed(log, "TaskStart", "TaskEnd").select(
        "app_id", "ord", "kind", F.col(f"{_INFO}.`Task ID`").alias("task_id"), "e"
    )
    start = F.struct(*[F.expr(c).alias(name) for name, c in started.items()])
    end = F.struct(*[F.expr(c).alias(name) for name, c in finished.items()])
    slim = events.select(
        "app_id", "ord", "kind", "task_id", _of("TaskStart", start).alias("s"), _of("TaskEnd", end).alias("f")
    )
    rows = slim.groupBy("app_id", "task_id").agg(
        F.max(_of("TaskStart", F.col("ord"))).alias("start_ord"),
        F.max(_of("TaskEnd", F.col("ord"))).alias("end_ord"),
        _last("TaskStart", F.col("s"), "s"),
        _last("TaskEnd", F.col("f"), "f"),
    )
    finish = F.when(F.col("end_ord") > F.col("start_ord"), F.col("f"))
    kept = rows.where(F.col("start_ord").isNotNull()).select("app_id", "task_id", "s.*", finish.alias("f"))
    return kept.select("app_id", "task_id", *started, *[F.col(f"f.{name}").alias(name) for name in finished])


def tasks(log: DataFrame) -> DataFrame:
    """Last start of a task id wins and forgets ends before it; unfinished tasks keep NULL end columns."""
    return _task_rows(log, _STARTED, _FINISHED).withColumn("failed", F.coalesce("failed", F.lit(False)))


def task_times(log: DataFrame) -> DataFrame:
    """(app_id, task_id, stage_id, launch_ms, finish_ms) of :func:`tasks`; nothing else of a task is carried along."""
    started = {name: _STARTED[name] for name in ("stage_id", "launch_ms")}
    return _task_rows(log, started, {"finish_ms": _FINISHED["finish_ms"]})


def executors(log: DataFrame) -> DataFrame:
    """Last addition wins; a removal counts if it follows that addition; removals of unknown executors are dropped."""
    events = parsed(log, "ExecutorAdded", "ExecutorRemoved").select(
        "app_id",
        "ord",
        "kind",
        F.col("e.`Executor ID`").alias("executor_id"),
        F.col("e.`Timestamp`").alias("at_ms"),
        F.col("e.`Executor Info`.`Host`").alias("host"),
        F.col("e.`Executor Info`.`Total Cores`").alias("cores"),
        F.col("e.`Removed Reason`").alias("reason"),
    )
    rows = events.groupBy("app_id", "executor_id").agg(
        F.max(_of("ExecutorAdded", F.col("ord"))).alias("add_ord"),
        F.max(_of("ExecutorRemoved", F.col("ord"))).alias("remove_ord"),
        _last("ExecutorAdded", F.struct("host", "cores", F.col("at_ms").alias("start_ms")), "a"),
        _last("ExecutorRemoved", F.struct("at_ms", "reason"), "r"),
    )
    gone = F.col("remove_ord") > F.col("add_ord")
    return rows.where(F.col("add_ord").isNotNull()).select(
        "app_id",
        "executor_id",
        "a.*",
        F.when(gone, F.col("r.at_ms")).alias("remove_ms"),
        F.when(gone, F.col("r.reason")).alias("remove_reason"),
    )


def block_managers(log: DataFrame) -> DataFrame:
    return parsed(log, "BlockManagerAdded").select(
        "app_id",
        "ord",
        F.col("e.`Block Manager ID`.`Executor ID`").alias("executor_id"),
        F.col("e.`Maximum Memory`").alias("max_memory"),
        F.col("e.`Timestamp`").alias("add_ms"),
    )


def executor_block_managers(log: DataFrame) -> DataFrame:
    """Block managers with their executor; the driver's is left out, one without an executor stays unmatched."""
    managers = block_managers(log).where(F.col("executor_id") != "driver")
    return managers.join(
        executors(log).select("app_id", "executor_id", "host", "cores"), ["app_id", "executor_id"], "left"
    )
