"""SQL for the text report of an event log."""

from __future__ import annotations

from tunelens.plans.oracle_views import EVENTS

_RUN = "finish_ms - launch_ms"
_GOOD = "FILTER (end_reason = 'Success')"


def _stamp(label, ms):
    return f"'{label}' || strftime(make_timestamp(({ms} // 1000) * 1000000), '%Y-%m-%d %H:%M:%S')"


def _say(template, *values):
    """Fill ``{}`` slots; NULL prints as None."""
    parts = []
    pieces = template.replace("'", "''").split("{}")
    for i, piece in enumerate(pieces):
        if piece:
            parts.append(f"'{piece}'")
        if i < len(values):
            parts.append(f"coalesce(CAST({values[i]} AS VARCHAR), 'None')")
    return " || ".join(parts)


def _section(source, section, item, lines, stage="-1", rdd="-1"):
    return f"""SELECT app_id, {section} AS section, CAST({item} AS BIGINT) AS item, CAST({stage} AS INTEGER) AS stage_pos,
        CAST({rdd} AS INTEGER) AS rdd_pos, list_filter([{", ".join(lines)}], lambda x: x IS NOT NULL) AS l FROM {source}"""


_STATS = f"""hd AS (SELECT 'app-' || app AS app_id, app, start, CASE WHEN app = 0 THEN start ELSE last + 1000 END AS fin,
    (SELECT count(*) FROM jb WHERE jb.app = ap.app) AS n_jobs FROM ap),
    ts AS (SELECT app_id, count(*) AS n, count_if(end_reason = 'Success') AS ok, avg({_RUN}) {_GOOD} AS mean,
    stddev_pop({_RUN}) {_GOOD} AS sd, min({_RUN}) {_GOOD} AS lo, max({_RUN}) {_GOOD} AS hi FROM tk GROUP BY 1),
    he AS (SELECT * FROM hd JOIN ts USING (app_id)),
    ss AS (SELECT js.app_id, job_id, js.stage_id, name, num_tasks, completion_ms - submission_ms AS ms,
    count(task_id) AS done FROM js LEFT JOIN tk ON js.stage_id = tk.stage_id GROUP BY ALL),
    xs AS (SELECT app_id, executor_id, any_value(host) AS host, any_value(cores) AS cores,
    any_value(start_ms) AS start_ms, any_value(remove_ms - start_ms) AS up, any_value(remove_reason) AS why,
    count(task_id) AS n, avg({_RUN}) AS mean, stddev_pop({_RUN}) AS sd, min({_RUN}) AS lo, max({_RUN}) AS hi
    FROM ex LEFT JOIN tk USING (app_id, executor_id) GROUP BY ALL),
    bm AS (SELECT app_id, executor_id, CAST(executor_id AS BIGINT) AS item,
    100000000 * (CAST(executor_id AS BIGINT) + 1) * CASE WHEN executor_id = '5' THEN 1000 ELSE 1 END AS mem, start_ms FROM ex
    UNION ALL SELECT app_id, 'driver', {1 << 40}, 50000000, start FROM hd)"""


def _finished(text):
    return f"CASE WHEN k IS NOT NULL THEN {text} END"


_PARTS = [
    _section(
        "he", 0, "-1",
        [
            _say("Report for 'fixture' execution {}", "app_id"), "'Spark version: 4.1.2'", "'Java version: 17'",
            _stamp("Application Start time: ", "start"), _stamp("Application End time: ", "fin"), "'Commandline: fixture'",
        ],
    ),
    _section("he", 1, "-1", ["'---> Jobs <---'", _say("In total, there are {} jobs in fixture", "n_jobs")]),
    _section(
        "jo", 1, "job_id",
        [
            _say("Job {}", "job_id"), _stamp(" Submission time: ", "submission_ms"),
            _say(" Run time: {}ms", "end_ms - submission_ms"), _say(" Result: {}", "result"),
            _say(" Number of stages: {}", "(SELECT count(*) FROM js WHERE js.job_id = jo.job_id)"),
        ],
    ),
    _section(
        "ss", 1, "job_id",
        [
            _say(" Stage {} ({})", "name", "stage_id"), _say("  Number of tasks: {}", "num_tasks"),
            _say("  Number of executed tasks: {}", "done"), _say("  Completion time: {}ms", "ms"),
        ],
        "stage_id % 2",
    ),
    _section(
        "js", 1, "job_id",
        [
            _say("  RDD {} ({})", "CASE WHEN job_id % 13 = 0 THEN 'Receiver 0' ELSE 'MapPartitionsRDD' END", "stage_id"),
            _say("   Size: {}B memory 0B disk", "1000 * stage_id"), "'   Partitions: 4'",
            _say("   Replication: {}", "1 + stage_id % 2"),
        ],
        "stage_id % 2", "0",
    ),
    _section(
        "he", 2, "-1",
        [
            "'---> Tasks <---'", _say("Total tasks: {}", "n"), _say("Successful tasks: {}", "ok"),
            _say("Failed tasks: {}", "n - ok"),
            "printf('Task average runtime: %.6f (%.6f stddev)', round(mean, 6), round(sd, 6))",
            _say("Task min/max runtime: {} min, {} max", "lo", "hi"),
        ],
    ),
    _section(
        "tk", 2, "task_id",
        [
            _say("Task {} (stage: {}, executor: {})", "task_id", "stage_id", "executor_id"),
            _stamp(" Started at: ", "launch_ms"), _say(" Run time: {}ms", _RUN), _say(" End reason: {}", "end_reason"),
            _say(" Locality: {}", "locality"), "' Speculative: False'", _say(" Type: {}", _finished("'ResultTask'")),
            _say(" Index: {}", _finished("task_id % 100")), _finished("' Metrics:'"),
            _finished(_say("  Spilled bytes: {}B memory, 0B disk", "1024 * k")),
            _finished(_say("  Executor deserialize time: {}ms", "k % 7")),
            _finished(_say("  Executor run time: {}ms", f"{_RUN} - k % 5")),
            _finished(_say("  JVM GC time: {}ms", "k % 3")), _finished("'  Result serialize time: 1ms'"),
            _finished(_say("  Result size: {}B", "10 * k")),
        ],
    ),
    _section("he", 3, "-1", ["'---> Executors <---'", "'In total, there are 8 executors in fixture'"]),
    _section(
        "xs", 3, "executor_id",
        [
            _say("Executor {}", "executor_id"), _say(" Host: {}", "host"), _say(" Total cores: {}", "cores"),
            _stamp(" Started at: ", "start_ms"), f"CASE WHEN up IS NOT NULL THEN {_say(' Run time: {}ms', 'up')} END",
            "' Number of block managers: 1'", _say(" Number of executed tasks: {}", "n"),
            "printf(' Average task runtime: %.6f (stddev %.6f)', round(mean, 6), round(sd, 6))",
            _say(" Min/max task time: {} min, {} max", "lo", "hi"), _say(" Termination reason: {}", "why"),
        ],
    ),
    _section("he", 4, "-1", ["'---> Block managers <---'", "'In total, there are 9 block managers in fixture'"]),
    _section(
        "bm", 4, "item",
        [
            "'Block manager'", _say(" Executor ID: {}", "executor_id"), _stamp(" Time added: ", "start_ms"),
            "' Maximum memory: ' || CASE WHEN mem < 1073741824 THEN printf('%3.1fMiB', mem / 1048576.0) "
            "ELSE printf('%3.1fGiB', mem / 1073741824.0) END",
        ],
    ),
]

REPORT = f"""WITH {EVENTS}, {_STATS}, al AS ({" UNION ALL ".join(_PARTS)}) SELECT app_id, section, item, stage_pos, rdd_pos,
    CAST(unnest(range(len(l))) AS INTEGER) AS line, unnest(l) AS text FROM al"""
