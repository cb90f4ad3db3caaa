"""Trees over whole replays against the same trees stepped through the batches."""

import random

import pytest

from tunelens.sources import replay
from tunelens.streaming import treereplay
from tunelens.streaming.prequential import prequential
from tunelens.streaming.splits import best_tests
from tunelens.streaming.trees import Feature, Forest, OneVsRestTrees, TreeLearner, TreeOptions

FEATURES = [Feature("a"), Feature("b"), Feature("c", 3)]


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(3), []
    for i in range(650):
        a, b, c = rng.random(), rng.gauss(0, 1), float(rng.randrange(5) - 1)  # values beyond the domain, too
        y = int((a > 0.5) != (b > 0.7) != (rng.random() < 0.1))
        holes = [None if rng.random() < 0.05 else v for v in (a, b, c)]
        out.append((None if i % 97 == 5 else i, *holes, None if i % 31 == 0 or 180 <= i < 280 else y, int(c) % 3))
    table = spark.createDataFrame(out, "id bigint, a double, b double, c double, label int, label3 int")
    return table.repartition(4).cache()


GROWING = dict(grace=20, confidence=0.2, tie=0.3)
LEARNERS = {
    "kinds": lambda: TreeLearner(
        FEATURES, 2, {str(k): TreeOptions(leaf_kind=k, nb_threshold=5, **GROWING) for k in (0, 1, 2)}, {"1": ["a"]}),
    "poor": lambda: TreeLearner(FEATURES, 2, {"t": TreeOptions(remove_poor=True, binary_only=True, max_depth=3, **GROWING)}),
    "frozen": lambda: TreeLearner(FEATURES, 2, {str(k): TreeOptions(growth=False, leaf_kind=k) for k in (0, 1, 2)}),
    "forest": lambda: Forest(FEATURES, 2, TreeOptions(**GROWING), size=4, feature_mode=0, rate=1.0),
    "rest": lambda: OneVsRestTrees(FEATURES, 3, TreeOptions(**GROWING)),
}


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", LEARNERS)
def test_replay_equals_steps(spark, rows, name):
    table = rows.withColumn("label", rows.label3) if name == "rest" else rows
    parts = replay.replay_file(table, "id", 90, 620)
    stepped, whole = LEARNERS[name](), LEARNERS[name]()
    want = [(i, *r) for i, batch in parts for r in stepped.step(batch)]
    got = told(treereplay.run_replay(whole, parts).select("batch", "member", "label", "prediction", "n"))
    assert got == sorted(want, key=str)
    if name != "frozen":
        assert sum(len(t.leaves()) for t in whole.trees.values()) > len(whole.trees)
    # The same leaves: predictions, and what comes after, are the same.
    assert sorted(stepped.depths().items()) == sorted(whole.depths().items())
    assert told(stepped.predict(table)) == told(whole.predict(table))
    more = table.limit(200).cache()
    assert sorted(stepped.step(more), key=str) == sorted(whole.step(more), key=str)


def test_replay_goes_on(spark, rows):
    """A learner that has learnt before goes on from its leaves."""
    halves = [replay.replay_file(rows.where(c), "id", 200) for c in ("id < 400", "id >= 400")]
    stepped, whole = LEARNERS["kinds"](), LEARNERS["kinds"]()
    for parts in halves:
        want = [(i, *r) for i, batch in parts for r in stepped.step(batch)]
        got = told(treereplay.run_replay(whole, parts).select("batch", "member", "label", "prediction", "n"))
        assert got == sorted(want, key=str)


def test_jobs_do_not_grow_with_batches(spark, rows):
    """Ten times the batches, a few jobs more."""

    def jobs(chunk):
        group = f"replay-{chunk}"
        spark.sparkContext.setJobGroup(group, group)
        prequential(spark, replay.replay_file(rows, "id", chunk), LEARNERS["frozen"]()).collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(15) <= jobs(150) + 3 < 60


def test_trees_alike_grow_once(spark, rows, monkeypatch):
    """Trees that differ only in their greatest depth are grown once for all, until one of them may go no deeper."""
    options = {"9": 9, "never": 0, "2": 2, "30": 30, "other": 30}
    kinds = {k: TreeOptions(max_depth=d, **GROWING | {"tie": 0.3 + 0.1 * (k == "other")}) for k, d in options.items()}
    stepped, whole = TreeLearner(FEATURES, 2, kinds), TreeLearner(FEATURES, 2, kinds)
    parts = replay.replay_file(rows, "id", 60)
    grown: dict[int, int] = {}

    def seen(_, path):
        for r in spark.read.schema(treereplay._GROWN).parquet(path).where("what = 0").groupBy("m").count().collect():
            grown[r["m"]] = grown.get(r["m"], 0) + r["count"]

    monkeypatch.setattr(treereplay, "dropped", seen)
    got = told(treereplay.run_replay(whole, parts).select("batch", "member", "label", "prediction", "n"))
    want = [(i, *r) for i, batch in parts for r in stepped.step(batch)]
    assert got == sorted(want, key=str)
    assert 2 < whole.depths()["30"] < 9 and whole.depths() == stepped.depths()
    assert sorted(grown) == [1, 2, 3, 4]  # the first tree is the fourth one all the way
    for name in options:
        assert told(stepped.predict(rows, name)) == told(whole.predict(rows, name))
    more = rows.limit(200).cache()
    assert sorted(stepped.step(more), key=str) == sorted(whole.step(more), key=str)


def test_leaves_walk_together(spark, rows, monkeypatch):
    """A batch's split merits are taken for all due leaves of a task at once, in pieces of rows too."""
    import numpy as np

    learner = TreeLearner(FEATURES, 2, {str(i): TreeOptions(grace=20, confidence=0.2, tie=0.01 * i) for i in range(40)})
    rng, width = np.random.default_rng(1), learner.layout.width
    calls = []
    monkeypatch.setattr(treereplay, "best_tests", lambda *a: calls.append(len(a[1])) or best_tests(*a))

    def table(keys):
        import pyarrow as pa

        part = rng.integers(1, 9, (len(keys), width)).astype(float)
        part[:, 0] = 30.0
        columns = [pa.array([k[i] for k in keys], t) for i, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.int64()), (3, pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, treereplay._lists(part)], names=["m", "leaf", "batch", "y", "part"])

    tables = [table([(m, 0, b, y) for b in range(5) for y in (0, 1)]) for m in range(40)]

    def walked():
        calls.clear()
        out = [r for b in treereplay._walk_leaves(learner, [0.5, 0.0, 0.0])(iter(tables)) for r in b.to_pylist()]
        return sorted(map(str, out)), len(calls)

    whole, few = walked()
    assert few <= 5 * len(FEATURES)
    monkeypatch.setattr(treereplay, "WALKED", 7 * width)
    assert walked()[0] == whole
