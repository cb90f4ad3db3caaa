"""Spark event logs: one JSON object per line, discriminated by its ``Event`` key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.session import configured

PREFIX = "SparkListener"
#: Bytes of events that an open file of a store holds before it writes them.
ROW_GROUP_BYTES = 32 << 20

# The keys read from each event kind, as they appear in the log.
_RDD_INFO = (
    "struct<`RDD ID`: bigint, `Name`: string, `Disk Size`: bigint, `Memory Size`: bigint, "
    "`Number of Partitions`: bigint, `Storage Level`: struct<`Replication`: bigint>>"
)
_STAGE_INFO = (
    "struct<`Stage ID`: bigint, `Details`: string, `Number of Tasks`: bigint, `Stage Name`: string, "
    f"`RDD Info`: array<{_RDD_INFO}>>"
)
_TASK_INFO = (
    "struct<`Task ID`: bigint, `Executor ID`: string, `Launch Time`: bigint, `Locality`: string, "
    "`Speculative`: boolean, `Failed`: boolean, `Finish Time`: bigint, `Getting Result Time`: bigint, "
    "`Index`: bigint>"
)
_TASK_METRICS = (
    "struct<`Disk Bytes Spilled`: bigint, `Memory Bytes Spilled`: bigint, `Executor Deserialize Time`: bigint, "
    "`Executor Run Time`: bigint, `JVM GC Time`: bigint, `Result Serialization Time`: bigint, "
    "`Result Size`: bigint>"
)
_SPARK_PROPERTIES = "struct<`spark.app.name`: string, `spark.app.id`: string, `spark.executor.memory`: string>"
EVENT_SCHEMAS: dict[str, dict[str, str]] = {
    "LogStart": {"Spark Version": "string"},
    "EnvironmentUpdate": {
        "JVM Information": "struct<`Java Version`: string>",
        "Spark Properties": _SPARK_PROPERTIES,
        "System Properties": "struct<`sun.java.command`: string>",
    },
    "ApplicationStart": {"Timestamp": "bigint"},
    "ApplicationEnd": {"Timestamp": "bigint"},
    "JobStart": {"Job ID": "bigint", "Submission Time": "bigint", "Stage Infos": f"array<{_STAGE_INFO}>"},
    "JobEnd": {"Job ID": "bigint", "Completion Time": "bigint", "Job Result": "struct<`Result`: string>"},
    "StageSubmitted": {},
    "StageCompleted": {
        "Stage Info": "struct<`Stage ID`: bigint, `Submission Time`: bigint, `Completion Time`: bigint>"
    },
    "TaskStart": {"Stage ID": "bigint", "Task Info": _TASK_INFO},
    "TaskEnd": {
        "Task Type": "string",
        "Task End Reason": "struct<`Reason`: string>",
        "Task Info": _TASK_INFO,
        "Task Metrics": _TASK_METRICS,
    },
    "ExecutorAdded": {
        "Executor ID": "string",
        "Timestamp": "bigint",
        "Executor Info": "struct<`Host`: string, `Total Cores`: bigint>",
    },
    "ExecutorRemoved": {"Executor ID": "string", "Timestamp": "bigint", "Removed Reason": "string"},
    "BlockManagerAdded": {
        "Block Manager ID": "struct<`Executor ID`: string>",
        "Maximum Memory": "bigint",
        "Timestamp": "bigint",
    },
    "BlockManagerRemoved": {},
}
IGNORED_EVENTS = ("StageSubmitted", "BlockManagerRemoved")


# All keys that are read, of whatever kind; a key has one type in all kinds.
_ALL_FIELDS = {name: type_ for fields in EVENT_SCHEMAS.values() for name, type_ in fields.items()}
_EVENT_SCHEMA = ", ".join(f"`{name}` {type_}" for name, type_ in _ALL_FIELDS.items())


def tag_events(lines: DataFrame) -> DataFrame:
    """Add the event kind to (app_id, ord, value) lines.

    A line that opens with its kind is not decoded for it; any other line is, and a malformed one fails the job. A line
    of a kind that is read fails later if the rest of it is malformed; the rest of other kinds is never decoded.
    """
    opening = F.regexp_extract("value", r'^\{"Event":"([^"\\]+)"[,}]', 1)
    whole = F.from_json("value", "`Event` string", {"mode": "FAILFAST"})["Event"]
    return lines.select("app_id", "ord", F.when(opening != "", opening).otherwise(whole).alias("event"), "value")


def app_of(path: Column) -> Column:
    """Application key of a log path: the rolled or partitioned folder if there is one, else the file name without a
    compression suffix, after the configuration folder ``s<k>/`` where logs are kept by experiment."""
    folder = F.regexp_extract(path, r"/(?:eventlog_v2_|app_id=)([^/]+)/[^/]+$", 1)
    name = F.regexp_extract(path, r"/((?:s\d+/)?[^/]+?)(?:\.inprogress|\.zstd|\.zst|\.lz4|\.lzf|\.snappy|\.gz)*$", 1)
    return F.when(folder != "", folder).otherwise(name)


def read_event_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read any number of logs as (app_id, ord, event, value).

    Takes single files, directories and the rolled, compressed layout. ``ord`` reproduces the line order inside one
    application: rolled part number, file name, byte offset of the split, position in the split. All are the same on
    every attempt of a task.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    name = F.col("_metadata.file_name")
    lines = (
        raw.where(~name.startswith("appstatus_"))
        .where(F.trim("value") != "")
        .select(
            app_of(F.col("_metadata.file_path")).alias("app_id"),
            F.struct(
                F.coalesce(F.regexp_extract(name, r"^events_(\d+)_", 1).try_cast("bigint"), F.lit(0)).alias("part"),
                name.alias("name"),
                F.col("_metadata.file_block_start").alias("offset"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("ord"),
            "value",
        )
    )
    return tag_events(lines)


def latest_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Newest ``app*`` log under ``path`` by modification time, ties to the later name. Reads no file contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return newest_log(files.select("path", F.col("modificationTime").alias("modified")))


def newest_log(files: DataFrame) -> DataFrame:
    """(log, modified): the newest ``app*`` log of a listing (path, modified), ties to the later name."""
    log = F.regexp_extract("path", r"(?:^|[/=])(app[^/]*)(?:/[^/]*)?$", 1)
    return (
        files.select(log.alias("log"), "modified")
        .where(F.col("log") != "")
        .agg(F.max_by("log", F.struct("modified", "log")).alias("log"), F.max("modified").alias("modified"))
    )


def is_kind(*kinds: str) -> Column:
    return F.col("event").isin([PREFIX + kind for kind in kinds])


def parsed(log: DataFrame, *kinds: str) -> DataFrame:
    """(app_id, ord, kind, e) for the wanted kinds: of decoded events as they are, of lines by decoding only the keys those
    kinds carry."""
    kind = F.substring("event", len(PREFIX) + 1, 100).alias("kind")
    if "e" in log.columns:
        return log.where(is_kind(*kinds)).select("app_id", "ord", kind, "e")
    fields = {name: type_ for kind in kinds for name, type_ in EVENT_SCHEMAS[kind].items()}
    schema = ", ".join(f"`{name}` {type_}" for name, type_ in fields.items())
    return log.where(is_kind(*kinds)).select(
        "app_id",
        "ord",
        kind,
        F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e"),
    )


def route_events(log: DataFrame) -> dict[str, DataFrame]:
    """One DataFrame per known event kind; unknown kinds fall away, the two ignored kinds carry no fields."""
    routed = {}
    for kind in EVENT_SCHEMAS:
        if kind in IGNORED_EVENTS:
            routed[kind] = log.where(is_kind(kind)).select("app_id", "ord")
        else:
            fields = [F.col(f"e.`{name}`") for name in EVENT_SCHEMAS[kind]]
            routed[kind] = parsed(log, kind).select("app_id", "ord", *fields)
    return routed


def decoded(log: DataFrame) -> DataFrame:
    """(app_id, ord, event, e): the lines of all known kinds, each decoded once; other kinds fall away undecoded."""
    e = F.from_json("value", _EVENT_SCHEMA, {"mode": "FAILFAST"}).alias("e")
    return log.where(is_kind(*EVENT_SCHEMAS)).select("app_id", "ord", "event", e)


def store_events(log: DataFrame, path: str) -> None:
    """Lay the decoded events of a log out by kind, in one pass over its lines: each later table reads only its kinds, and
    of these only the keys it uses.

    A task keeps a file open for each of the few kinds and writes every event as it comes. Without that it would first sort
    all its events by kind, in memory that grows with its share of the log.
    """
    with configured(log.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": len(EVENT_SCHEMAS)}):
        writer = decoded(log).write.mode("error").partitionBy("event")
        writer.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)


def open_event_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("app_id", "ord", "event", "e")
