"""Fronts of three measures against brute force, and event logs that are decoded once."""

import json
import random

import pytest

from tunelens.operators import eventstats, eventtables, experiments
from tunelens.operators.report import event_report
from tunelens.plans import fixtures
from tunelens.sources.eventlog import decoded, newest_log, open_event_store, read_event_log, store_events, tag_events

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("shape", ["spread", "grid", "sphere", "one"])
def test_front_of_three(spark, shape):
    rng = random.Random(4)
    draw = {
        "spread": lambda: [rng.random() for _ in range(3)],
        "grid": lambda: [float(rng.randrange(5)) for _ in range(3)],  # many ties and repeated rows
        "sphere": lambda: (lambda v: [c / sum(x * x for x in v) ** 0.5 for c in v])([rng.random() + 0.01 for _ in range(3)]),
        "one": lambda: [1.0, 2.0, 3.0],
    }[shape]
    points = [draw() for _ in range(400)] + [[None, 9.0, 9.0]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id int, a double, b double, c double").repartition(7)
    got = {r.id for r in experiments.pareto_front_3(df, "a", "b", "c").collect()}
    known = [(i, p) for i, p in enumerate(points) if None not in p]

    def beats(p, q):
        return p != q and all(x >= y for x, y in zip(p, q))

    assert got == {i for i, q in known if not any(beats(p, q) for _, p in known)}
    assert experiments.pareto_front_3(df.where("false"), "a", "b", "c").count() == 0


def lines(spark, *texts):
    rows = [("app", {"part": 0, "name": "n", "offset": 0, "row": i}, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "app_id string, ord struct<part: bigint, name: string, offset: bigint, row: bigint>, value string")


def test_kinds_are_found_wherever_they_stand(spark):
    texts = ['{"Event":"SparkListenerJobEnd","Job ID":1}', '{"Job ID":2, "Event" : "SparkListenerJobEnd"}',
             '{"Event":"Spark\\u004cistenerJobEnd","Job ID":3}', '{"Event":"some.other.Kind","plan":"…']
    tagged = tag_events(lines(spark, *texts))
    assert [r.event for r in tagged.orderBy("ord").collect()] == ["SparkListenerJobEnd"] * 3 + ["some.other.Kind"]
    jobs = decoded(tagged).orderBy("ord").select("e.`Job ID`").collect()
    assert [r[0] for r in jobs] == [1, 2, 3]  # the unfinished line of another kind is never decoded


@pytest.mark.parametrize("text", ["not json", '{"Event":"SparkListenerJobEnd","Job ID":', '{"Event":'])
def test_malformed_lines_fail(spark, text):
    with pytest.raises(Exception, match="(?i)malformed"):
        decoded(tag_events(lines(spark, text))).collect()


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_text_is_decoded_once(spark, tmp_path):
    """Whatever is made of a log, its text is read once and each of its tables is built once."""
    log = fixtures.event_log(spark, SF)
    ordered = log.repartitionByRange("app_id", "ord").sortWithinPartitions("app_id", "ord")
    ordered.select("app_id", "value").write.partitionBy("app_id").text(str(tmp_path / "logs"))
    store_events(read_event_log(spark, str(tmp_path / "logs")), str(tmp_path / "store"))
    events = open_event_store(spark, str(tmp_path / "store"))
    kinds = {r.event for r in events.select("event").distinct().collect()}
    assert kinds == {json.loads(r.value)["Event"] for r in log.select("value").collect()}
    kept, plain = eventtables.EventTables(events), eventtables.of(log)
    for operator in (eventstats.cluster_times, eventstats.stage_summary, eventstats.executor_summary, event_report):
        both = [sorted(map(tuple, operator(t).collect()), key=repr) for t in (kept, plain)]
        assert both[0] == both[1] and both[0]
    built = [kept.jobs, kept.job_starts, kept.job_stages, kept.tasks, kept.executors, kept.block_managers, kept.applications]
    assert all(scans(t) == 1 for t in built)
    assert kept.jobs is kept.jobs


def test_newest_of_a_listing(spark):
    rows = [("/logs/app-1.zst", 5), ("/logs/app-2", 7), ("/logs/app-3/events_1", 7), ("/logs/other", 9), ("/logs/app-0", None)]
    assert tuple(newest_log(spark.createDataFrame(rows, "path string, modified int")).first()) == ("app-3", 7)
    assert newest_log(spark.createDataFrame([], "path string, modified int")).first().log is None
