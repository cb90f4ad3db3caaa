"""Registered queries over event logs, each with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunelens.functions.scalars import ms_to_ts, sizeof_fmt
from tunelens.operators import eventstats, eventtables
from tunelens.operators.report import event_report
from tunelens.plans.fixtures import event_log, event_store, table
from tunelens.plans.oracle_report import REPORT
from tunelens.plans.oracle_views import EVENTS
from tunelens.session import scratch_path, stored
from tunelens.sources.eventlog import (
    latest_event_log, newest_log, open_event_store, read_event_log, route_events, store_events)


def _on_log(operator):
    return lambda spark, sf_dir: operator(event_store(spark, sf_dir))


def _applications(spark, sf_dir):
    apps = eventtables.applications(event_store(spark, sf_dir))
    return apps.withColumn("started", F.date_format(ms_to_ts(F.col("start_ms")), "yyyy-MM-dd HH:mm:ss"))


def _tasks(log):
    return eventtables.tasks(log).select("*", "metrics.*").drop("metrics")


def _sizes(log):
    return eventtables.block_managers(log).select(
        "app_id", "executor_id", "max_memory", sizeof_fmt(F.col("max_memory")).alias("size")
    )


def _event_counts(log):
    """Rows per routed kind: the two ignored kinds are absent from the log, all others are present."""
    counted = None
    for kind, events in route_events(log).items():
        part = events.select(F.lit(kind).alias("kind"))
        counted = part if counted is None else counted.unionByName(part)
    return counted.groupBy("kind").agg(F.count("*").alias("events"))


def _write_log(spark, sf_dir):
    path = scratch_path(spark, "eventlog")
    # Written once before the range sort, which reads its input twice.
    log = stored(event_log(spark, sf_dir).select("app_id", "ord", "value"), "lines")
    # By range: the files of an application follow the line order by name, and a long log spreads over several.
    ordered = log.repartitionByRange("app_id", "ord").sortWithinPartitions("app_id", "ord")
    ordered.select("app_id", "value").write.partitionBy("app_id").text(path)
    return path


def _times_from_files(spark, sf_dir):
    """The cluster view of every application: its text files are read and decoded once."""
    path = scratch_path(spark, "events")
    store_events(read_event_log(spark, _write_log(spark, sf_dir)), path)
    return eventstats.cluster_times(eventtables.EventTables(open_event_store(spark, path)))


def _from_files(spark, sf_dir):
    """Event counts per kind after a round trip through text files."""
    log = read_event_log(spark, _write_log(spark, sf_dir))
    return log.groupBy("event").agg(F.count("*").alias("events"))


def _latest_listed(spark, sf_dir):
    """The newest log of a listing: a log per user of the events, changed at the user's last event."""
    files = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("modified"))
    files = files.selectExpr("concat('hdfs://logs/', if(user_id % 3 = 0, 'other', 'app'), '-', user_id, '.zstd') AS path", "modified")
    return newest_log(files).withColumn("modified", F.date_format("modified", "yyyy-MM-dd HH:mm:ss"))


def _latest(spark, sf_dir):
    return latest_event_log(spark, _write_log(spark, sf_dir))


QUERIES = {
    "evlog_applications": _applications,
    "evlog_jobs": _on_log(eventtables.jobs),
    "evlog_stages": _on_log(eventtables.job_stages),
    "evlog_rdds": _on_log(eventtables.stage_rdds),
    "evlog_tasks": _on_log(_tasks),
    "evlog_executors": _on_log(eventtables.executors),
    "evlog_block_managers": _on_log(lambda log: eventtables.executor_block_managers(log).drop("ord")),
    "evlog_route": _on_log(_event_counts),
    "evlog_read_files": _from_files,
    "evlog_files_cluster_times": _times_from_files,
    "evlog_task_summary": _on_log(eventstats.task_summary),
    "evlog_executor_summary": _on_log(eventstats.executor_summary),
    "evlog_job_summary": _on_log(eventstats.job_summary),
    "evlog_stage_summary": _on_log(eventstats.stage_summary),
    "evlog_entity_counts": _on_log(eventstats.entity_counts),
    "evlog_avg_times": _on_log(eventstats.avg_times),
    "evlog_kept_jobs": _on_log(eventstats.drop_receiver_and_empty_jobs),
    "evlog_cluster_times": _on_log(eventstats.cluster_times),
    "evlog_sizes": _on_log(_sizes),
    "evlog_report": _on_log(event_report),
    "evlog_latest_log": _latest,
    "evlog_latest_of_listing": _latest_listed,
}

_W = f"WITH {EVENTS}"
_RUN = "finish_ms - launch_ms"
_KINDS = f"""{_W}, kinds AS (
  SELECT 'TaskStart' AS kind, count(*) AS events FROM ev
  UNION ALL SELECT 'TaskEnd', count(*) + (SELECT count(*) FROM ap) FROM ev WHERE event_id % 97 <> 0
  UNION ALL SELECT 'JobStart', count(*) + count(*) FILTER (job % 19 = 0) FROM jb
  UNION ALL SELECT 'JobEnd', count(*) + (SELECT count(*) FROM ap) FROM jb
  UNION ALL SELECT 'StageCompleted', count(*) + count(*) FILTER (job % 23 = 0) + (SELECT count(*) FROM ap) FROM st
  UNION ALL SELECT 'LogStart', count(*) FROM ap
  UNION ALL SELECT 'EnvironmentUpdate', count(*) FROM ap
  UNION ALL SELECT 'ApplicationStart', count(*) FROM ap
  UNION ALL SELECT 'ApplicationEnd', count(*) FROM ap WHERE app > 0
  UNION ALL SELECT 'ExecutorAdded', 8 * count(*) FROM ap
  UNION ALL SELECT 'BlockManagerAdded', 9 * count(*) FROM ap
  UNION ALL SELECT 'ExecutorRemoved', 2 * count(*) FROM ap)"""
_IGNORED_JOBS = "job_id % 11 = 0 OR job_id % 13 = 0"

ORACLES = {
    "evlog_applications": f"""{_W} SELECT 'app-' || app AS app_id, '4.1.2' AS spark_version, '17' AS java_version,
        'fixture' AS app_name, 'app-' || app AS spark_app_id, CASE WHEN app % 2 = 0 THEN '1g' END AS executor_memory,
        'fixture' AS command_line, start AS start_ms, CASE WHEN app = 0 THEN start ELSE last + 1000 END AS end_ms,
        strftime(make_timestamp((start // 1000) * 1000000), '%Y-%m-%d %H:%M:%S') AS started FROM ap""",
    "evlog_jobs": f"{_W} SELECT * FROM jo",
    "evlog_stages": f"""{_W} SELECT *, CAST(stage_id % 2 AS INTEGER) AS stage_pos,
        'details ' || stage_id AS details FROM js""",
    "evlog_rdds": f"""{_W} SELECT app_id, job_id, stage_id, CAST(stage_id % 2 AS INTEGER) AS stage_pos, 0 AS rdd_pos,
        stage_id AS rdd_id, CASE WHEN job_id % 13 = 0 THEN 'Receiver 0' ELSE 'MapPartitionsRDD' END AS name,
        CAST(0 AS BIGINT) AS disk_size, 1000 * stage_id AS memory_size, CAST(4 AS BIGINT) AS partitions,
        1 + stage_id % 2 AS replication FROM js""",
    "evlog_tasks": f"""{_W} SELECT app_id, task_id, stage_id, executor_id, launch_ms, locality, false AS speculative,
        finish_ms, end_reason, coalesce(end_reason = 'ExceptionFailure', false) AS failed,
        CASE WHEN k IS NOT NULL THEN CAST(0 AS BIGINT) END AS getting_result_ms,
        CASE WHEN k IS NOT NULL THEN task_id % 100 END AS index,
        CASE WHEN k IS NOT NULL THEN 'ResultTask' END AS type,
        CASE WHEN k IS NOT NULL THEN CAST(0 AS BIGINT) END AS disk_spilled_bytes,
        CAST(1024 * k AS BIGINT) AS memory_spilled_bytes, CAST(k % 7 AS BIGINT) AS executor_deserialize_ms,
        {_RUN} - k % 5 AS executor_run_ms, CAST(k % 3 AS BIGINT) AS jvm_gc_ms,
        CASE WHEN k IS NOT NULL THEN CAST(1 AS BIGINT) END AS result_serialize_ms,
        CAST(10 * k AS BIGINT) AS result_size FROM tk""",
    "evlog_executors": f"{_W} SELECT * FROM ex",
    "evlog_block_managers": f"""{_W} SELECT app_id, executor_id, 100000000 * (CAST(executor_id AS BIGINT) + 1)
        * CASE WHEN executor_id = '5' THEN 1000 ELSE 1 END AS max_memory, start_ms AS add_ms, host, cores FROM ex""",
    "evlog_route": f"{_KINDS} SELECT * FROM kinds WHERE events > 0",
    "evlog_read_files": f"{_KINDS} SELECT 'SparkListener' || kind AS event, events FROM kinds WHERE events > 0",
    "evlog_task_summary": f"""{_W} SELECT app_id, count(*) AS tasks, count(*) FILTER (end_reason = 'Success') AS successes,
        count(*) FILTER (coalesce(end_reason, '') <> 'Success') AS failures,
        round(avg({_RUN}) FILTER (end_reason = 'Success'), 6) AS avg_ms,
        round(stddev_pop({_RUN}) FILTER (end_reason = 'Success'), 6) AS std_ms,
        min({_RUN}) FILTER (end_reason = 'Success') AS min_ms,
        max({_RUN}) FILTER (end_reason = 'Success') AS max_ms FROM tk GROUP BY app_id""",
    "evlog_executor_summary": f"""{_W} SELECT app_id, executor_id, any_value(host) AS host, any_value(cores) AS cores,
        any_value(start_ms) AS start_ms, any_value(remove_ms - start_ms) AS run_ms, CAST(1 AS BIGINT)
        AS block_managers, count(task_id) AS tasks, round(avg({_RUN}), 6) AS avg_ms,
        round(stddev_pop({_RUN}), 6) AS std_ms, min({_RUN}) AS min_ms, max({_RUN}) AS max_ms,
        any_value(remove_reason) AS remove_reason
        FROM ex LEFT JOIN tk USING (app_id, executor_id) GROUP BY app_id, executor_id""",
    "evlog_job_summary": f"""{_W} SELECT app_id, job_id, submission_ms, end_ms - submission_ms AS run_ms, result,
        (SELECT count(*) FROM js WHERE js.job_id = jo.job_id) AS stages FROM jo""",
    "evlog_stage_summary": f"""{_W} SELECT js.app_id, job_id, js.stage_id, name, num_tasks,
        count(task_id) AS executed_tasks, completion_ms - submission_ms AS run_ms
        FROM js LEFT JOIN tk ON js.stage_id = tk.stage_id GROUP BY ALL""",
    "evlog_entity_counts": f"""{_W} SELECT 'app-' || ap.app AS app_id,
        (SELECT count(*) FROM jb WHERE jb.app = ap.app) AS jobs, (SELECT count(*) FROM ev WHERE ev.app = ap.app)
        AS tasks, CAST(8 AS BIGINT) AS executors, CAST(9 AS BIGINT) AS block_managers FROM ap""",
    "evlog_avg_times": f"""{_W}, a AS (SELECT app_id, round(avg(end_ms - submission_ms), 6) AS avg_job_ms
        FROM jo GROUP BY app_id), b AS (SELECT app_id, CAST(sum({_RUN}) AS BIGINT) AS s, count(*) AS n
        FROM tk WHERE end_reason = 'Success' GROUP BY app_id) SELECT app_id, avg_job_ms,
        CAST((200 * s + n) // (2 * n) AS DOUBLE) / 100 AS avg_task_ms FROM a LEFT JOIN b USING (app_id)""",
    "evlog_kept_jobs": f"{_W} SELECT * FROM jo WHERE NOT ({_IGNORED_JOBS})",
    "evlog_cluster_times": f"""{_W}, a AS (SELECT app_id, count(*) AS jobs, CAST(sum(end_ms - submission_ms)
        AS BIGINT) AS job_ms FROM jo WHERE NOT ({_IGNORED_JOBS}) GROUP BY app_id),
        b AS (SELECT app_id, count(*) AS tasks, CAST(sum({_RUN}) AS BIGINT) AS task_ms FROM tk
        WHERE stage_id NOT IN (SELECT stage_id FROM js WHERE {_IGNORED_JOBS}) GROUP BY app_id)
        SELECT * FROM a FULL JOIN b USING (app_id)""",
    "evlog_sizes": f"""{_W}, m AS (SELECT app_id, executor_id, 100000000 * (CAST(executor_id AS BIGINT) + 1)
        * CASE WHEN executor_id = '5' THEN 1000 ELSE 1 END AS max_memory FROM ex UNION ALL SELECT 'app-' || app, 'driver', 50000000 FROM ap)
        SELECT *, CASE WHEN max_memory < 1048576 THEN printf('%3.1fKiB', max_memory / 1024.0)
        WHEN max_memory < 1073741824 THEN printf('%3.1fMiB', max_memory / 1048576.0)
        ELSE printf('%3.1fGiB', max_memory / 1073741824.0) END AS size FROM m""",
}
ORACLES["evlog_latest_of_listing"] = """SELECT 'app-' || arg_max(user_id, (modified, 'app-' || user_id)) || '.zstd' AS log,
    strftime(max(modified), '%Y-%m-%d %H:%M:%S') AS modified
    FROM (SELECT user_id, max(ts) AS modified FROM events WHERE user_id % 3 <> 0 GROUP BY 1)"""
ORACLES["evlog_report"] = REPORT
ORACLES["evlog_files_cluster_times"] = ORACLES["evlog_cluster_times"]
