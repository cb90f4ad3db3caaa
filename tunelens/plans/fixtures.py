"""Views derived from the given tables: event-log lines, experiment metrics, instances and short texts.

Keys are integer arithmetic and no engine-specific hash is used, so that the same views can be stated in SQL
(:mod:`tunelens.plans.oracle_views`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.session import scratch_path, shared_dir
from tunelens.sources.eventlog import open_event_store, store_events, tag_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple, str] = {}


def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log laid out by event kind, written once per application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "events", shared_dir(spark))  # kept for all queries of the application
        store_events(event_log(spark, sf_dir), path)
        _STORED[key] = path
    return open_event_store(spark, _STORED[key])


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "event_id div 5000 AS app",
        "event_id div 100 AS job",
        "2 * (event_id div 100) + event_id % 2 AS stage",
        "CAST(user_id % 8 AS STRING) AS executor",
        "unix_millis(CAST(ts AS TIMESTAMP)) AS launch",
        "unix_millis(CAST(ts AS TIMESTAMP)) + CAST(round(value * 10) AS BIGINT) AS finish",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "event_type",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete event log as (app_id, ord, event, value); ``ord`` is the line order inside the application."""
    rows = _event_rows(spark, sf_dir)
    stages = rows.groupBy("app", "job", "stage").agg(
        F.count("*").alias("n"), F.min("launch").alias("first"), F.max("finish").alias("last")
    )
    jobs = stages.groupBy("app", "job").agg(
        F.min("first").alias("submission"), F.sort_array(F.collect_list(F.struct("stage", "n"))).alias("parts")
    )
    apps = stages.groupBy("app").agg(F.min("first").alias("start"), F.max("last").alias("last"))

    def line(ord_: str, event: str, fields: str, when: str = "true") -> str:
        text = f"to_json(named_struct('Event', 'SparkListener{event}'{', ' + fields if fields else ''}))"
        return f"IF({when}, named_struct('ord', {ord_}, 'value', {text}), NULL)"

    def spread(source: DataFrame, *lines: str) -> DataFrame:
        # One pass over the source for all its lines.
        return source.selectExpr("app", f"inline(array_compact(array({', '.join(lines)})))")

    task_lines = spread(
        rows,
        line(
            "event_id * 100",
            "TaskStart",
            """'Stage ID', stage, 'Stage Attempt ID', 0,
            'Task Info', named_struct('Task ID', event_id, 'Index', event_id % 100, 'Executor ID', executor,
              'Launch Time', launch, 'Locality', if(k % 3 = 0, 'NODE_LOCAL', 'PROCESS_LOCAL'),
              'Speculative', false, 'Finish Time', 0, 'Failed', false)""",
        ),
        line(
            "event_id * 100 + 1",
            "TaskEnd",
            """'Stage ID', stage, 'Task Type', 'ResultTask',
            'Task End Reason', named_struct('Reason', if(event_type = 'error', 'ExceptionFailure', 'Success')),
            'Task Info', named_struct('Task ID', event_id, 'Index', event_id % 100, 'Failed', event_type = 'error',
              'Finish Time', finish, 'Getting Result Time', 0),
            'Task Metrics', named_struct('Disk Bytes Spilled', 0, 'Memory Bytes Spilled', 1024 * k,
              'Executor Deserialize Time', k % 7, 'Executor Run Time', finish - launch - k % 5,
              'JVM GC Time', k % 3, 'Result Serialization Time', 1, 'Result Size', 10 * k)""",
            "event_id % 97 <> 0",
        ),
    )
    infos = """transform(parts, p -> named_struct('Stage ID', p.stage, 'Stage Attempt ID', 0,
        'Stage Name', concat('stage ', p.stage), 'Number of Tasks',
        if(p.stage % 2 = 1 AND job % 11 = 0, 0, p.n), 'Details', concat('details ', p.stage),
        'RDD Info', array(named_struct('RDD ID', p.stage, 'Name', if(job % 13 = 0, 'Receiver 0', 'MapPartitionsRDD'),
          'Storage Level', named_struct('Use Disk', false, 'Replication', 1 + p.stage % 2),
          'Number of Partitions', 4, 'Memory Size', 1000 * p.stage, 'Disk Size', 0))))"""
    job_lines = spread(
        jobs.withColumn("infos", F.expr(infos)),
        line("job * 10000 - 50", "JobStart", "'Job ID', job, 'Submission Time', submission, 'Stage Infos', infos"),
        line(
            "(job + 1) * 10000 - 60",
            "JobStart",
            "'Job ID', job, 'Submission Time', submission + 5, 'Stage Infos', infos",
            "job % 19 = 0",
        ),
        line(
            "(job + 1) * 10000 - 70",
            "JobEnd",
            """'Job ID', job, 'Completion Time', submission + 1000 + 7 * (job % 50),
            'Job Result', named_struct('Result', if(job % 17 = 0, 'JobFailed', 'JobSucceeded'))""",
        ),
    )
    info = "'Stage Info', named_struct('Stage ID', stage, 'Submission Time', {}, 'Completion Time', {})"
    stage_lines = spread(
        stages,
        line("(job + 1) * 10000 - 80 + stage % 2", "StageCompleted", info.format("first", "last")),
        line("(job + 1) * 10000 - 90 + stage % 2", "StageCompleted", info.format("0L", "0L"), "job % 23 = 0"),
    )
    head = apps.selectExpr("app", "app * 500000 - 1000 AS base", "start", "last")
    app_lines = spread(
        head,
        line("base", "LogStart", "'Spark Version', '4.1.2'"),
        line(
            "base + 1",
            "EnvironmentUpdate",
            """'JVM Information', named_struct('Java Version', '17'),
            'Spark Properties', named_struct('spark.app.name', 'fixture', 'spark.app.id', concat('app-', app),
              'spark.executor.memory', if(app % 2 = 1, NULL, '1g')),
            'System Properties', named_struct('sun.java.command', 'fixture')""",
        ),
        line("base + 2", "ApplicationStart", "'Timestamp', start"),
        line("(app + 1) * 500000 - 2000", "ApplicationEnd", "'Timestamp', last + 1000", "app > 0"),
        line(
            "base + 40",
            "BlockManagerAdded",
            """'Block Manager ID', named_struct('Executor ID', 'driver', 'Host', 'h'),
            'Maximum Memory', 50000000L, 'Timestamp', start""",
        ),
        line(
            "(app + 1) * 500000 - 3000",
            "ExecutorRemoved",
            "'Timestamp', start + 60000, 'Executor ID', '7', 'Removed Reason', 'lost'",
        ),
        # Ends of what never started.
        line("(app + 1) * 500000 - 2501", "JobEnd", "'Job ID', -1 - app, 'Completion Time', last"),
        line("(app + 1) * 500000 - 2503", "TaskEnd", "'Stage ID', 0, 'Task Info', named_struct('Task ID', -1 - app)"),
        line("(app + 1) * 500000 - 2505", "ExecutorRemoved", "'Timestamp', last, 'Executor ID', 'never added'"),
        line(
            "(app + 1) * 500000 - 2507", "StageCompleted",
            "'Stage Info', named_struct('Stage ID', -1 - app, 'Completion Time', last)",
        ),
    )
    executor_lines = spread(
        head.selectExpr("app", "base", "start", "explode(sequence(0, 7)) AS x"),
        line(
            "base + 10 + x",
            "ExecutorAdded",
            """'Timestamp', start, 'Executor ID', CAST(x AS STRING),
            'Executor Info', named_struct('Host', concat('h', x), 'Total Cores', 1 + x % 4)""",
        ),
        line(
            "base + 30 + x",
            "BlockManagerAdded",
            """'Block Manager ID', named_struct('Executor ID', CAST(x AS STRING), 'Host', concat('h', x)),
            'Maximum Memory', 100000000 * CAST(x + 1 AS BIGINT) * if(x = 5, 1000, 1), 'Timestamp', start""",
        ),
    )
    lines = task_lines
    for part in (job_lines, stage_lines, app_lines, executor_lines):
        lines = lines.unionByName(part)
    return tag_events(lines.selectExpr("concat('app-', app) AS app_id", "ord", "value"))


def metrics(spark: SparkSession, sf_dir: str, batches: int = 20) -> DataFrame:
    """Per-batch metrics (fractions) of nine configurations by 32 hyper-parameter sets."""
    p, r = "round(0.5 + 3 * avg(l_discount), 6)", "round(0.95 - 4 * avg(l_tax), 6)"
    grouped = table(spark, sf_dir, "lineitem").groupBy(
        F.expr("CAST(l_suppkey % 9 + 1 AS INT) AS exp"),
        F.expr("CAST(l_partkey % 32 AS INT) AS hp_idx"),
        F.expr(f"l_orderkey % {batches} AS batch"),
    )
    return grouped.agg(
        F.expr("CAST(sum(l_quantity) AS BIGINT) AS instances"),
        F.expr("round(0.5 + 4 * avg(l_discount), 6) AS accuracy"),
        F.expr(f"{r} AS recall"),
        F.expr(f"{p} AS precision"),
    ).withColumn("f1", F.expr("round(2 * precision * recall / (precision + recall), 6)"))


def percent(metrics_df: DataFrame) -> DataFrame:
    scaled = {m: F.round(F.col(m) * 100, 6) for m in ("accuracy", "recall", "precision", "f1")}
    return metrics_df.withColumns(scaled)


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job and task counts and times of the same runs."""
    grouped = table(spark, sf_dir, "lineitem").groupBy(
        F.expr("CAST(l_suppkey % 9 + 1 AS INT) AS exp"), F.expr("CAST(l_partkey % 32 AS INT) AS hp_idx")
    )
    return grouped.agg(
        F.expr("count(DISTINCT l_orderkey % 20) AS jobs"),
        F.expr("CAST(sum(l_quantity * (8 + l_linenumber % 5)) AS BIGINT) AS job_ms"),
        F.expr("count(*) AS tasks"),
        F.expr("CAST(round(sum(l_extendedprice) / 100) AS BIGINT) AS task_ms"),
    )


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree depth of the same runs."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.expr("CAST(l_suppkey % 9 + 1 AS INT) AS exp"), F.expr("CAST(l_partkey % 32 AS INT) AS hp_idx"))
        .agg(F.expr("CAST(max(l_linenumber) AS INT) AS depth"))
    )


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
INSTANCE_FEATURES = ["f_value", "f_hour", "f_user", "f_k", "f_type"]


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled instances: four numeric features, one nominal, a learnable binary label with 10 % noise."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        "value AS f_value",
        "CAST(hour(ts) AS DOUBLE) AS f_hour",
        "CAST(user_id % 10 AS DOUBLE) AS f_user",
        "CAST(get_json_object(props, '$.k') AS DOUBLE) AS f_k",
        "event_type AS f_type",
    ).selectExpr(
        "*",
        "CAST((f_value + f_k > 100) <> (id % 10 = 0) AS INT) AS label",
        "CASE WHEN f_value + f_k < 60 THEN 0 WHEN f_value + f_k < 120 THEN 1 ELSE 2 END AS label3",
    )


def relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instances as a relation: id, features and class, with the nominal domains declared."""
    from tunelens.sources.arff import with_domains

    rows = instances(spark, sf_dir).select("id", *INSTANCE_FEATURES, "label")
    return with_domains(rows, {"f_type": EVENT_TYPES, "label": ["0", "1"]})


def tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with author counters, and a class where they are labelled; some gain a hashtag, a user name or a link."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").selectExpr(
        "doc_id AS id",
        """concat(if(doc_id % 4 = 0, 'RT @user ', ''), text, if(doc_id % 3 = 0, concat(' #topic', doc_id % 10), ''),
             if(doc_id % 5 = 0, concat(' SEE https://example.org/', doc_id), '')) AS text""",
        "n_chars AS cntPosts",
        "doc_id % 7 AS cntLists",
        "doc_id % 1000 AS cntFollowers",
        "doc_id % 300 AS cntFriends",
        "doc_id % 3650 AS accountAge",
        "CASE WHEN toxic = 1 THEN 'abusive' WHEN quality = 0 THEN 'spam' WHEN toxic = 0 THEN 'normal' END AS class",
    )


# The fixture lexicon, frequent tokens of the texts under arbitrary tags.
LEXICON_TAGS = {
    "adjective": "the der die das le la les un en el los ein ist est is",
    "adverb": "of de que und et y to on in as by at zu von auf",
    "verb": "was be are er es ou oi re it for with from an this that",
    "swear": "rewh orre thatin inoran ononst orantion hehely ci vi pa tre ble tion ment eau",
}


def lexicon_rows() -> list[tuple[str, str, float | None]]:
    rows = []
    for tag, words in LEXICON_TAGS.items():
        for i, word in enumerate(words.split()):
            score = {0: 1.5, 1: -0.5, 2: None}[i % 3] if tag != "swear" else -2.0
            rows.append((word, tag, score))
    return rows


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lexicon_rows(), "token string, tag string, score double")
