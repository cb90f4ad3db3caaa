"""Trees that walk through a replay alone, against the same trees stepped through the batches."""

import random

import pytest

from tunelens.sources import replay
from tunelens.streaming import treewalk
from tunelens.streaming.prequential import prequential
from tunelens.streaming.trees import Feature, Forest, TreeLearner, TreeOptions

FEATURES = [Feature("a"), Feature("b"), Feature("c", 3)]
GROWING = dict(grace=20, confidence=0.2, tie=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(3), []
    for i in range(620):
        a, b, c = rng.random(), rng.gauss(0, 1), float(rng.randrange(5) - 1)  # values beyond the domain, too
        y = int((a > 0.5) != (b > 0.7) != (rng.random() < 0.1))
        holes = [None if rng.random() < 0.05 else v for v in (a, b, c)]
        out.append((None if i % 97 == 5 else i, *holes, None if i % 31 == 0 or i < 100 or 200 <= i < 300 else y))
    return spark.createDataFrame(out, "id bigint, a double, b double, c double, label int").repartition(4).cache()


def forest():
    return Forest(FEATURES, 2, TreeOptions(**GROWING), size=4, feature_mode=0, rate=1.0)


def grid():
    """Leaves of all kinds, attributes left out, poor ones removed, and trees that differ in their greatest depth alone."""
    options = {str(k): TreeOptions(leaf_kind=k, nb_threshold=5, **GROWING) for k in (0, 1, 2)}
    options |= {f"deep {d}": TreeOptions(max_depth=d, **GROWING | {"tie": 0.25}) for d in (30, 0, 2)}
    options["poor"] = TreeOptions(remove_poor=True, binary_only=True, **GROWING)
    options["frozen"] = TreeOptions(growth=False)
    return TreeLearner(FEATURES, 2, options, {"1": ["a"]})


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("make", [forest, grid])
def test_walk_equals_steps(spark, rows, monkeypatch, make):
    """leaves have the numbers, and so the attributes, that steps give them, and blocks follow one another."""
    monkeypatch.setattr(treewalk, "WALK_ROWS", 200)
    monkeypatch.setattr(treewalk, "MANY", 2)
    parts = replay.replay_file(rows, "id", 90)
    stepped, whole = make(), make()
    assert treewalk.in_tasks(whole, parts)
    want = [(i, *r) for i, batch in parts for r in stepped.step(batch)]
    got = told(treewalk.run(whole, parts).select("batch", "member", "label", "prediction", "n"))
    assert got == sorted(want, key=str)
    assert sum(len(t.leaves()) for t in whole.trees.values()) > 2 * len(whole.trees)
    tests = [[[(n.depth, n.attr, n.kind, n.children) for n in t.nodes] for t in x.trees.values()] for x in (whole, stepped)]
    assert tests[0] == tests[1]
    # The same leaves: predictions, and what comes after, are the same.
    for name in [None] if whole.votes else whole.trees:
        assert told(stepped.predict(rows, name)) == told(whole.predict(rows, name))
    more = replay.replay_file(rows.limit(200).cache(), "id", 100)
    want = [(i, *r) for i, batch in more for r in stepped.step(batch)]
    got = told(treewalk.run(whole, more).select("batch", "member", "label", "prediction", "n"))
    assert got == sorted(want, key=str)


def test_jobs_of_a_forest_do_not_grow_with_batches(spark, rows):
    """ten times the batches, a few jobs more."""

    def jobs(chunk):
        group = f"walk-{chunk}"
        spark.sparkContext.setJobGroup(group, group)
        prequential(spark, replay.replay_file(rows, "id", chunk), forest()).collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(15) <= jobs(150) + 3 < 40


def test_rows_without_labels(spark, rows):
    parts = replay.replay_file(rows.where("label IS NULL"), "id", 50)
    assert treewalk.run(forest(), parts).count() == 0


def test_who_walks_alone(spark, rows):
    parts = replay.replay_file(rows, "id", 90)
    assert treewalk.in_tasks(forest(), parts) and not treewalk.in_tasks(grid(), parts)
    many = TreeLearner(FEATURES, 2, {str(i): TreeOptions(tie=0.01 * i) for i in range(8)})
    assert treewalk.in_tasks(many, parts)
    assert not treewalk.in_tasks(many, replay.replay_file(rows, "id", treewalk.CHUNK_ROWS + 1))
