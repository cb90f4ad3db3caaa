"""Linear models over whole replays against the same models stepped through the batches."""

import random

import pytest

from tunelens.sources import replay
from tunelens.streaming import linearreplay
from tunelens.streaming.linear import LOSSES, REGULARIZERS, LinearLearner, LinearOptions
from tunelens.streaming.prequential import prequential, prequential_rows

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(5), []
    for i in range(650):
        a, b = rng.random(), rng.gauss(0, 1)
        y = int((a > 0.5) != (rng.random() < 0.1)) + int(b > 0.8)
        holes = [None if rng.random() < 0.05 else float("nan") if rng.random() < 0.01 else v for v in (a, b)]
        out.append((None if i % 97 == 5 else i // 2, *holes, None if i % 31 == 0 or 180 <= i < 280 else y))
    return spark.createDataFrame(out, "id bigint, a double, b double, label int").repartition(4).cache()


def learner(classes):
    settings = {f"{loss}-{reg}": LinearOptions(2, 0.3, loss, reg, 0.01) for loss in LOSSES for reg in REGULARIZERS}
    return LinearLearner(NAMES, settings, classes)


@pytest.mark.parametrize("classes", [None, 3])
def test_replay_equals_steps(spark, rows, classes, monkeypatch):
    monkeypatch.setattr(linearreplay, "BLOCK_ROWS", 200)  # several blocks
    table = rows if classes else rows.selectExpr("id", "a", "b", "CAST(label > 0 AS INT) AS label")
    parts = replay.replay_file(table, "id", 60, 620)
    stepped, whole = learner(classes), learner(classes)
    want, versions = [], {}
    for i, batch in parts:
        versions |= {(i, n): w for _, n, w in stepped.versions(i)}
        want += [(i, *r) for r in stepped.step(batch)]
    walked = linearreplay.walked(whole, parts)
    assert sorted(map(tuple, linearreplay.confusion_of(walked).collect())) == sorted(want)
    for r in walked.collect():
        for got, expected in zip(r["w"], versions[r["batch"], r["member"]]):
            assert got == pytest.approx(expected, rel=1e-9, abs=1e-12)
    for key, w in stepped.weights.items():
        assert whole.weights[key] == pytest.approx(w, rel=1e-9, abs=1e-12)


def test_jobs_do_not_grow_with_batches(spark, rows):
    """ten times the batches take no more jobs, with their rows' predictions, too."""
    table = rows.selectExpr("id", "a", "b", "CAST(label > 0 AS INT) AS label")

    def jobs(chunk, run):
        group = f"linear-{chunk}-{run.__name__}"
        spark.sparkContext.setJobGroup(group, group)
        run(spark, replay.replay_file(table, "id", chunk), learner(None)).collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    for run in (prequential, prequential_rows):
        assert jobs(15, run) <= jobs(150, run) + 3 < 40


def test_large_chunks_are_stepped(spark, rows):
    assert not linearreplay.in_blocks(learner(None), replay.replay_file(rows, "id", linearreplay.BLOCK_ROWS + 1))
