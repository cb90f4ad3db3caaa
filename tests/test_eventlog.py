"""A hand-written event log with one quirk per line, real logs, and layout independence."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tunelens.operators import eventstats, eventtables
from tunelens.operators.experiments import experiment_cube
from tunelens.operators.report import SORT_KEYS, event_report, write_report
from tunelens.sources.eventlog import (
    app_of,
    latest_event_log,
    open_event_store,
    read_event_log,
    route_events,
    store_events,
    tag_events,
)


def ev(kind, **fields):
    return json.dumps({"Event": f"SparkListener{kind}", **{k.replace("_", " "): v for k, v in fields.items()}})


def stage(sid, n, rdd="MapPartitionsRDD"):
    info = {"RDD ID": sid, "Name": rdd, "Disk Size": 0, "Memory Size": 10, "Number of Partitions": 2,
            "Storage Level": {"Replication": 1}}
    return {"Stage ID": sid, "Details": "d", "Number of Tasks": n, "Stage Name": f"s{sid}", "RDD Info": [info]}


def job_start(jid, at, *stages):
    return json.dumps({"Event": "SparkListenerJobStart", "Job ID": jid, "Submission Time": at, "Stage Infos": stages})


def job_end(jid, at, result="JobSucceeded"):
    return json.dumps({"Event": "SparkListenerJobEnd", "Job ID": jid, "Completion Time": at, "Job Result": {"Result": result}})


def task_start(tid, sid, at, executor="1"):
    info = {"Task ID": tid, "Executor ID": executor, "Launch Time": at, "Locality": "ANY", "Speculative": False}
    return json.dumps({"Event": "SparkListenerTaskStart", "Stage ID": sid, "Task Info": info})


def task_end(tid, at, reason="Success", metrics=True):
    e = {"Event": "SparkListenerTaskEnd", "Task Type": "ResultTask", "Task End Reason": {"Reason": reason},
         "Task Info": {"Task ID": tid, "Failed": reason != "Success", "Finish Time": at, "Getting Result Time": 0, "Index": tid}}
    if metrics:
        e["Task Metrics"] = {"Disk Bytes Spilled": 1, "Memory Bytes Spilled": 2, "Executor Deserialize Time": 3,
                             "Executor Run Time": 4, "JVM GC Time": 5, "Result Serialization Time": 6, "Result Size": 7}
    return json.dumps(e)


def completed(sid, start, end):
    return json.dumps({"Event": "SparkListenerStageCompleted",
                       "Stage Info": {"Stage ID": sid, "Submission Time": start, "Completion Time": end}})


GOLDEN = [
    ev("LogStart", Spark_Version="3.5.0"),
    ev("EnvironmentUpdate", JVM_Information={"Java Version": "17"},
       Spark_Properties={"spark.app.name": "golden", "spark.app.id": "app-1"}, System_Properties={"sun.java.command": "run"}),
    ev("ApplicationStart", Timestamp=1000),
    ev("ExecutorAdded", Executor_ID="1", Timestamp=1001, Executor_Info={"Host": "h", "Total Cores": 2}),
    ev("ExecutorAdded", Executor_ID="1", Timestamp=1002, Executor_Info={"Host": "g", "Total Cores": 4}),  # last wins
    ev("ExecutorAdded", Executor_ID="2", Timestamp=1003, Executor_Info={"Host": "idle", "Total Cores": 1}),
    ev("BlockManagerAdded", Block_Manager_ID={"Executor ID": "driver"}, Maximum_Memory=500, Timestamp=1000),
    ev("BlockManagerAdded", Block_Manager_ID={"Executor ID": "1"}, Maximum_Memory=2048, Timestamp=1001),
    ev("BlockManagerAdded", Block_Manager_ID={"Executor ID": "9"}, Maximum_Memory=2048, Timestamp=1001),  # unmatched
    ev("SomethingNew", Payload=1),  # unknown kind
    completed(0, 1, 2),  # before its job exists: ignored
    job_start(0, 2000, stage(0, 2), stage(1, 1)),
    ev("StageSubmitted", Stage_Info={}),
    task_start(0, 0, 2010),
    task_start(1, 0, 2020),
    task_end(0, 2110),
    task_end(1, 2220, "ExceptionFailure", metrics=False),
    task_end(77, 2300),  # orphan end
    task_start(2, 1, 2300),
    task_end(2, 2310),
    task_start(2, 1, 2400),  # second start: its end is gone
    task_start(3, 1, 2500),
    task_end(3, 2800),
    completed(0, 2005, 2230),
    completed(0, 2006, 2240),  # re-attempt: last wins
    job_start(0, 9999, stage(5, 1)),  # duplicate: first wins
    job_end(0, 3000),
    job_start(1, 3100, stage(2, 0)),  # empty stage: ignored by the cluster view
    job_end(1, 3200),
    job_start(2, 3300, stage(3, 1, "Receiver 0")),  # receiver
    task_start(4, 3, 3310, "1"),
    task_end(4, 3320),
    job_start(3, 3400, stage(4, 1)),  # never ends
    job_end(50, 3500),  # orphan end
    ev("ExecutorRemoved", Executor_ID="1", Timestamp=4002, Removed_Reason="lost"),
    ev("ExecutorRemoved", Executor_ID="33", Timestamp=4002, Removed_Reason="unknown"),
    ev("BlockManagerRemoved"),
]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("logs") / "app-1"
    path.write_text("\n".join(GOLDEN) + "\n")
    return read_event_log(spark, str(path)).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_applications(log):
    got = eventtables.applications(log).first()
    assert (got.app_id, got.app_name, got.spark_version, got.executor_memory) == ("app-1", "golden", "3.5.0", None)
    assert (got.start_ms, got.end_ms) == (1000, 1000)  # no end event: the start


def test_jobs(log):
    assert rows(eventtables.jobs(log), "job_id", "submission_ms", "end_ms", "result") == [
        (0, 2000, 3000, "JobSucceeded"), (1, 3100, 3200, "JobSucceeded"), (2, 3300, None, None), (3, 3400, None, None)]


def test_stages_take_the_last_completion_after_the_job_start(log):
    got = rows(eventtables.job_stages(log), "job_id", "stage_id", "num_tasks", "submission_ms", "completion_ms")
    assert got == [(0, 0, 2, 2006, 2240), (0, 1, 1, None, None), (1, 2, 0, None, None), (2, 3, 1, None, None), (3, 4, 1, None, None)]


def test_tasks(log):
    got = rows(eventtables.tasks(log), "task_id", "stage_id", "launch_ms", "finish_ms", "end_reason", "metrics.result_size")
    assert got[:2] == [(0, 0, 2010, 2110, "Success", 7), (1, 0, 2020, 2220, "ExceptionFailure", None)]
    assert got[2] == (2, 1, 2400, None, None, None)
    assert [g[0] for g in got] == [0, 1, 2, 3, 4]


def test_executors_and_block_managers(log):
    assert rows(eventtables.executors(log), "executor_id", "host", "cores", "start_ms", "remove_ms", "remove_reason") == [
        ("1", "g", 4, 1002, 4002, "lost"), ("2", "idle", 1, 1003, None, None)]
    assert rows(eventtables.executor_block_managers(log), "executor_id", "cores") == [("1", 4), ("9", None)]
    assert eventtables.block_managers(log).count() == 3


def test_summaries(log):
    got = eventstats.task_summary(log).first()
    assert (got.tasks, got.successes, got.failures, got.min_ms, got.max_ms) == (5, 3, 2, 10, 300)
    assert got.avg_ms == pytest.approx((100 + 300 + 10) / 3)
    by_executor = {r.executor_id: r for r in eventstats.executor_summary(log).collect()}
    assert (by_executor["1"].tasks, by_executor["1"].block_managers, by_executor["1"].run_ms) == (5, 1, 3000)
    assert (by_executor["2"].tasks, by_executor["2"].avg_ms) == (0, None)
    assert rows(eventstats.job_summary(log), "job_id", "run_ms", "stages") == [(0, 1000, 2), (1, 100, 1), (2, None, 1), (3, None, 1)]
    assert rows(eventstats.stage_summary(log), "stage_id", "executed_tasks", "run_ms") == [
        (0, 2, 234), (1, 2, None), (2, 0, None), (3, 1, None), (4, 0, None)]
    assert tuple(eventstats.entity_counts(log).first()) == ("app-1", 4, 5, 2, 3)


def test_cluster_view_drops_receiver_and_empty_jobs(log):
    assert rows(eventstats.drop_receiver_and_empty_jobs(log), "job_id") == [(0,), (3,)]
    got = eventstats.cluster_times(log).first()
    assert (got.jobs, got.job_ms, got.tasks, got.task_ms) == (2, 1000, 4, 100 + 200 + 300)
    plain = eventstats.avg_times(log).first()
    assert (plain.avg_job_ms, plain.avg_task_ms) == (550.0, 136.67)


def test_routing_knows_fourteen_kinds(log):
    routed = route_events(log)
    assert len(routed) == 14
    assert routed["StageSubmitted"].columns == ["app_id", "ord"] and routed["StageSubmitted"].count() == 1
    assert sum(df.count() for df in routed.values()) == len(GOLDEN) - 1


def test_malformed_line_fails(spark):
    bad = spark.createDataFrame([("a", 1, '{"Event": "SparkListenerLogStart"'), ("a", 2, GOLDEN[0])], "app_id string, ord bigint, value string")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tag_events(bad).collect()


def test_result_does_not_depend_on_layout(spark, log):
    flat = log.withColumn("ord", F.struct("ord.*"))
    want = rows(eventtables.tasks(log).drop("metrics"), "task_id", "finish_ms")
    for n in (1, 8):
        again = tag_events(flat.repartition(n).select("app_id", "ord", "value"))
        assert rows(eventtables.tasks(again), "task_id", "finish_ms") == want


def test_report_text(spark, log, tmp_path):
    text = [r.text for r in event_report(log).orderBy(*SORT_KEYS).collect()]
    assert text[0] == "Report for 'golden' execution app-1"
    at = text.index("Job 0")
    assert text[at + 2] == " Run time: 1000ms" and text[at + 5] == " Stage s0 (0)"
    assert "Task average runtime: 136.666667 (121.197726 stddev)" in text or any(t.startswith("Task average runtime: 136.666667") for t in text)
    assert " Maximum memory: 2.0KiB" in text
    write_report(log, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == len(text)


def test_store_reads_back_by_kind(spark, log, tmp_path):
    store_events(log, str(tmp_path / "store"))
    stored = open_event_store(spark, str(tmp_path / "store"))
    assert rows(eventtables.jobs(stored), "job_id", "end_ms") == rows(eventtables.jobs(log), "job_id", "end_ms")


def test_latest_log(spark, tmp_path):
    import os
    for i, name in enumerate(["app-1", "app-2", "other"]):
        (tmp_path / name).write_text("{}\n")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert latest_event_log(spark, str(tmp_path)).first().log == "app-2"


RUN = """
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
     .config("spark.eventLog.dir", "file://{path}").getOrCreate())
s.range(0, 100, 1, 4).selectExpr("id % 3 AS k").groupBy("k").count().collect()
s.stop()
"""


def test_log_of_a_real_run(spark, tmp_path):
    subprocess.run([sys.executable, "-c", RUN.format(path=tmp_path)], check=True, capture_output=True, timeout=120)
    log = read_event_log(spark, str(tmp_path)).cache()
    counts = eventstats.entity_counts(log).first()
    assert counts.app_id.startswith("local-") and counts.jobs >= 1 and counts.tasks >= 5
    summary = eventstats.task_summary(log).first()
    assert summary.successes == counts.tasks and summary.failures == 0
    starts = log.where("event = 'SparkListenerTaskStart'").count()
    assert starts == counts.tasks


def test_logs_kept_by_experiment(spark, tmp_path):
    hps = ["spark_ht_c0.01_t0.05", "spark_ht_c0.1_t0.05"]
    for exp in ("s1", "s10"):
        for hp in hps:
            (tmp_path / exp).mkdir(exist_ok=True)
            (tmp_path / exp / hp).write_text("\n".join(GOLDEN) + "\n")
    got = eventstats.experiment_times(read_event_log(spark, str(tmp_path))).cache()
    metrics = spark.createDataFrame(
        [(1, hps[0], 0, 500, 80.0, 1.0, 1.0, 1.0), (10, hps[1], 0, 700, 90.0, 1.0, 1.0, 1.0)],
        "exp int, hp string, batch bigint, instances bigint, accuracy double, recall double, precision double, f1 double")
    cube = experiment_cube(metrics, got, ["exp", "hp"])
    assert rows(cube, "exp", "hp", "throughput", "latency") == [(1, hps[0], 500.0, 300.0), (10, hps[1], 700.0, 300.0)]
    assert rows(got, "exp", "hp", "jobs", "tasks") == sorted((e, h, 2, 4) for e in (1, 10) for h in hps)


def test_application_keys(spark):
    paths = {"file:/x/app-1.zstd": "app-1", "file:/x/eventlog_v2_app-2/events_1_app-2.zstd": "app-2",
             "file:/x/s3/spark_sgd_l0.1": "s3/spark_sgd_l0.1", "file:/x/app_id=app-4/part-0.txt": "app-4",
             "file:/x/local-1.lz4.inprogress": "local-1"}
    df = spark.createDataFrame(list(paths.items()), "p string, want string").select("want", app_of(F.col("p")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


def _last_plan(spark):
    """The physical plan of the last SQL execution."""
    executions = spark._jsparkSession.sharedState().statusStore().executionsList()
    return executions.last().physicalPlanDescription()


def test_store_does_not_sort(spark, tmp_path):
    """F16: events go to the files of their kinds as they come; a task does not gather its share of the log to sort it."""
    lines = [task_start(t, t % 3, 10 * t) for t in range(50)] + [task_end(t, 10 * t + 5) for t in range(50)]
    lines += [job_start(1, 0, stage(0, 5)), job_end(1, 900), completed(0, 0, 900)]
    log = tag_events(spark.createDataFrame([("a", i, v) for i, v in enumerate(lines)], "app_id string, ord int, value string"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    store_events(log, f"{tmp_path}/store")
    assert "Sort" not in _last_plan(spark)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    found = open_event_store(spark, f"{tmp_path}/store").groupBy("event").count().collect()
    assert {r["event"].removeprefix("SparkListener"): r["count"] for r in found} == {
        "TaskStart": 50, "TaskEnd": 50, "JobStart": 1, "JobEnd": 1, "StageCompleted": 1}


def test_times_carry_no_other_columns(spark):
    """the cluster view shuffles the times of tasks, not their reasons and metrics; the times are those of the tasks."""
    lines = [task_start(1, 0, 10), task_end(1, 15), task_start(2, 0, 20), task_end(2, 24), task_start(2, 1, 30), task_start(3, 1, 7)]
    log = tag_events(spark.createDataFrame([("a", i, v) for i, v in enumerate(lines)], "app_id string, ord int, value string"))
    kept = eventtables.EventTables(log)
    times = kept.task_times
    assert "tasks" not in kept.__dict__ and times.columns == ["app_id", "task_id", "stage_id", "launch_ms", "finish_ms"]
    want = [("a", 1, 0, 10, 15), ("a", 2, 1, 30, None), ("a", 3, 1, 7, None)]
    assert sorted(map(tuple, times.collect()), key=str) == want
    assert sorted(map(tuple, kept.tasks.select(*times.columns).collect()), key=str) == want
    assert eventstats.cluster_times(kept).schema == eventstats.cluster_times(log).schema
