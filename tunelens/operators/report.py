"""Text report of an event log as sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.functions.scalars import ms_to_ts, sizeof_fmt
from tunelens.operators import eventstats
from tunelens.operators import eventtables as tables

SORT_KEYS = ["app_id", "section", "item", "stage_pos", "rdd_pos", "line"]


def _when(ms: str) -> Column:
    return F.date_format(ms_to_ts(F.col(ms)), "yyyy-MM-dd HH:mm:ss")


def _text(template: str, *values: Column) -> Column:
    """Fill ``{}`` slots; NULL prints as None."""
    parts: list[Column] = []
    pieces = template.split("{}")
    for i, piece in enumerate(pieces):
        if piece:
            parts.append(F.lit(piece))
        if i < len(values):
            parts.append(F.coalesce(values[i].cast("string"), F.lit("None")))
    return F.concat(*parts)


def _fixed(value: str) -> Column:
    return F.format_string("%.6f", F.col(value))


def _lines(df: DataFrame, section: int, item: Column, lines: list[Column], stage: Column = None, rdd: Column = None):
    none = F.lit(-1)
    return df.select(
        "app_id",
        F.lit(section).alias("section"),
        item.cast("bigint").alias("item"),
        (none if stage is None else stage).cast("int").alias("stage_pos"),
        (none if rdd is None else rdd).cast("int").alias("rdd_pos"),
        F.posexplode(F.array_compact(F.array(*lines))).alias("line", "text"),
    )


def event_report(log: DataFrame | tables.EventTables) -> DataFrame:
    """Report rows (app_id, section, item, stage_pos, rdd_pos, line, text); sections: 0 application, 1 jobs,
    2 tasks, 3 executors, 4 block managers. Sorting by those keys gives the text of each application."""
    # The wording of the report lines.
    c = F.col
    log = log if isinstance(log, tables.EventTables) else tables.EventTables(log)  # most tables serve several sections
    tasks = log.tasks
    heads = (
        log.applications
        .join(eventstats.entity_counts(log, tasks), "app_id", "left")
        .join(eventstats.task_summary(log, tasks).drop("tasks"), "app_id", "left")
    )
    first = F.lit(-1)
    rows = _lines(
        heads,
        0,
        first,
        [
            _text("Report for '{}' execution {}", c("app_name"), c("spark_app_id")),
            _text("Spark version: {}", c("spark_version")),
            _text("Java version: {}", c("java_version")),
            _text("Application Start time: {}", _when("start_ms")),
            _text("Application End time: {}", _when("end_ms")),
            _text("Commandline: {}", c("command_line")),
        ],
    )
    rows = rows.unionByName(
        _lines(
            heads,
            1,
            first,
            [F.lit("---> Jobs <---"), _text("In total, there are {} jobs in {}", c("jobs"), c("app_name"))],
        )
    )
    rows = rows.unionByName(
        _lines(
            eventstats.job_summary(log),
            1,
            c("job_id"),
            [
                _text("Job {}", c("job_id")),
                _text(" Submission time: {}", _when("submission_ms")),
                _text(" Run time: {}ms", c("run_ms")),
                _text(" Result: {}", c("result")),
                _text(" Number of stages: {}", c("stages")),
            ],
        )
    )
    stages = eventstats.stage_summary(log, tasks).join(
        log.job_stages.select("app_id", "job_id", "stage_id", "stage_pos"), ["app_id", "job_id", "stage_id"]
    )
    rows = rows.unionByName(
        _lines(
            stages,
            1,
            c("job_id"),
            [
                _text(" Stage {} ({})", c("name"), c("stage_id")),
                _text("  Number of tasks: {}", c("num_tasks")),
                _text("  Number of executed tasks: {}", c("executed_tasks")),
                _text("  Completion time: {}ms", c("run_ms")),
            ],
            c("stage_pos"),
        )
    )
    rows = rows.unionByName(
        _lines(
            tables.stage_rdds(log),
            1,
            c("job_id"),
            [
                _text("  RDD {} ({})", c("name"), c("rdd_id")),
                _text("   Size: {}B memory {}B disk", c("memory_size"), c("disk_size")),
                _text("   Partitions: {}", c("partitions")),
                _text("   Replication: {}", c("replication")),
            ],
            c("stage_pos"),
            c("rdd_pos"),
        )
    )
    rows = rows.unionByName(
        _lines(
            heads,
            2,
            first,
            [
                F.lit("---> Tasks <---"),
                _text("Total tasks: {}", c("tasks")),
                _text("Successful tasks: {}", c("successes")),
                _text("Failed tasks: {}", c("failures")),
                _text("Task average runtime: {} ({} stddev)", _fixed("avg_ms"), _fixed("std_ms")),
                _text("Task min/max runtime: {} min, {} max", c("min_ms"), c("max_ms")),
            ],
        )
    )

    def metric(template: str, *names: str) -> Column:
        values = [c(f"metrics.{n}") for n in names]
        return F.when(c("metrics").isNotNull(), _text(template, *values))

    rows = rows.unionByName(
        _lines(
            tasks,
            2,
            c("task_id"),
            [
                _text("Task {} (stage: {}, executor: {})", c("task_id"), c("stage_id"), c("executor_id")),
                _text(" Started at: {}", _when("launch_ms")),
                _text(" Run time: {}ms", c("finish_ms") - c("launch_ms")),
                _text(" End reason: {}", c("end_reason")),
                _text(" Locality: {}", c("locality")),
                _text(" Speculative: {}", F.initcap(c("speculative").cast("string"))),
                _text(" Type: {}", c("type")),
                _text(" Index: {}", c("index")),
                metric(" Metrics:"),
                metric("  Spilled bytes: {}B memory, {}B disk", "memory_spilled_bytes", "disk_spilled_bytes"),
                metric("  Executor deserialize time: {}ms", "executor_deserialize_ms"),
                metric("  Executor run time: {}ms", "executor_run_ms"),
                metric("  JVM GC time: {}ms", "jvm_gc_ms"),
                metric("  Result serialize time: {}ms", "result_serialize_ms"),
                metric("  Result size: {}B", "result_size"),
            ],
        )
    )
    rows = rows.unionByName(
        _lines(
            heads,
            3,
            first,
            [
                F.lit("---> Executors <---"),
                _text("In total, there are {} executors in {}", c("executors"), c("app_name")),
            ],
        )
    )
    rows = rows.unionByName(
        _lines(
            eventstats.executor_summary(log, tasks),
            3,
            c("executor_id").try_cast("bigint"),
            [
                _text("Executor {}", c("executor_id")),
                _text(" Host: {}", c("host")),
                _text(" Total cores: {}", c("cores")),
                _text(" Started at: {}", _when("start_ms")),
                F.when(c("run_ms").isNotNull(), _text(" Run time: {}ms", c("run_ms"))),
                _text(" Number of block managers: {}", c("block_managers")),
                _text(" Number of executed tasks: {}", c("tasks")),
                _text(" Average task runtime: {} (stddev {})", _fixed("avg_ms"), _fixed("std_ms")),
                _text(" Min/max task time: {} min, {} max", c("min_ms"), c("max_ms")),
                _text(" Termination reason: {}", c("remove_reason")),
            ],
        )
    )
    rows = rows.unionByName(
        _lines(
            heads,
            4,
            first,
            [
                F.lit("---> Block managers <---"),
                _text("In total, there are {} block managers in {}", c("block_managers"), c("app_name")),
            ],
        )
    )
    return rows.unionByName(
        _lines(
            log.block_managers,
            4,
            F.coalesce(c("executor_id").try_cast("bigint"), F.lit(1 << 40)),
            [
                F.lit("Block manager"),
                _text(" Executor ID: {}", c("executor_id")),
                _text(" Time added: {}", _when("add_ms")),
                _text(" Maximum memory: {}", sizeof_fmt(c("max_memory"))),
            ],
        )
    )


def write_report(log: DataFrame, path: str) -> None:
    """Sorted text, one folder per application."""
    ordered = event_report(log).repartitionByRange(*SORT_KEYS).sortWithinPartitions(*SORT_KEYS)
    ordered.select("app_id", F.col("text").alias("value")).write.partitionBy("app_id").text(path)
