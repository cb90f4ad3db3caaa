"""Many chunks learnt in a few jobs against the same learners stepped through them one by one."""

import random
from math import ceil

import pytest

from tunelens.plans import fixtures
from tunelens.sources import replay
from tunelens.streaming import walks
from tunelens.streaming.clustering import StreamingKMeans
from tunelens.streaming.linear import LinearLearner, LinearOptions
from tunelens.streaming.outliers import OutlierDetector
from tunelens.streaming.prequential import prequential
from tunelens.streaming.stream import ModelStore, feed, run_paced, stream_prequential, train_batch, with_chunk
from tunelens.streaming.trees import Feature, TreeLearner, TreeOptions
from tunelens.streaming.tweets import TextLearner, TweetExtractor


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = random.Random(7), []
    for i in range(400):
        a, b = (None if rng.random() < 0.05 else v for v in (rng.random(), rng.gauss(0, 1)))
        if 30 <= i < 60 or i < 3:
            a = None  # a chunk of which no row belongs to a cluster
        rows.append((i // 2, a, b, None if i % 31 == 0 or 120 <= i < 150 else int((a or 0) > 0.4)))
    return spark.createDataFrame(rows, "id bigint, a double, b double, label int").repartition(3).cache()


LEARNERS = {
    "kmeans": lambda: StreamingKMeans(["a", "b"], 3, decay=0.5),
    "outliers": lambda: OutlierDetector(["a", "b"], limit=1.5),
    "linear": lambda: LinearLearner(["a", "b"], {"m": LinearOptions(2, 0.5), "n": LinearOptions(2, 0.1)}),
    "tree": lambda: TreeLearner([Feature("a"), Feature("b")], 2, {"t": TreeOptions(grace=20, confidence=0.3, tie=0.5)}),
}


def near(rows):
    """Rows in order, their doubles to nine digits."""
    def plain(v):
        if isinstance(v, list | tuple):
            return tuple(map(plain, v))
        return f"{v:.9g}" if isinstance(v, float) else v

    return sorted(map(plain, rows), key=str)


def told(df):
    return near([tuple(r) for r in df.select(*sorted(df.columns)).collect()])


def stepped(learner, parts):
    return [(i, *r) for i, batch in parts for r in learner.step(batch)]


@pytest.mark.parametrize("name", LEARNERS)
def test_walk_equals_steps(spark, data, name):
    parts = replay.replay_file(data, "id", 60, 390)
    one, whole = LEARNERS[name](), LEARNERS[name]()
    want = stepped(one, parts)
    got = walks.walk(whole, parts.numbered("row", "chunk").drop("row"), "chunk")
    assert near(got) == near(want) and len({r[0] for r in got}) > 4
    # What comes after is the same, too.
    assert near(whole.step(parts.batch(3))) == near(one.step(parts.batch(3)))


def test_kmeans_waits_for_its_first_centres(spark, data):
    """batches without a whole row have no centres, and the rows of all blocks follow one another."""
    parts = replay.replay_file(data.where("id >= 15"), "id", 10)
    one, whole = LEARNERS["kmeans"](), LEARNERS["kmeans"]()
    want = stepped(one, parts)
    assert want[0][1] is None
    assert near(r for rows in walks.walked(whole, parts) for r in rows) == near(want)
    assert near(whole.centres) == near(one.centres) and whole.weights == one.weights
    assert told(prequential(spark, parts, LEARNERS["kmeans"]()).drop("sse", "a", "b")) == near((r[0], r[1], r[2]) for r in want)


@pytest.mark.parametrize("name", ["kmeans", "outliers"])
def test_jobs_do_not_grow_with_batches(spark, data, name, monkeypatch):
    """ten times the batches take no more jobs; a chunk that is too large for a task is stepped through."""

    def jobs(chunk):
        group = f"walk-{name}-{chunk}"
        spark.sparkContext.setJobGroup(group, group)
        prequential(spark, replay.replay_file(data, "id", chunk), LEARNERS[name]()).collect()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(10) <= jobs(100) + 3 < 30
    monkeypatch.setattr(walks, "CHUNK_ROWS", 99)
    parts = replay.replay_file(data, "id", 100)
    assert not walks.in_blocks(LEARNERS[name](), parts)


@pytest.mark.parametrize("name", ["kmeans", "outliers", "linear"])
def test_micro_batches_of_several_chunks(spark, data, tmp_path, name):
    """a micro-batch takes several chunks and has the metrics of each, also after a restart."""
    parts = replay.replay_file(data, "id", 25)
    want = told(prequential(spark, parts, LEARNERS[name]()))
    folder, store = str(tmp_path / "in"), ModelStore(spark, str(tmp_path / "store"))
    n = ceil(feed(parts, folder) / 7)
    for stop in (2, n):
        source = with_chunk(replay.dir_stream(spark, data.schema, max_files=7).parquet(folder), "chunk")
        query = stream_prequential(
            source, LEARNERS[name](), store, str(tmp_path / "checkpoint"), interval="0 seconds", chunks="chunk")
        run_paced(query, store, stop)
    assert told(store.metrics()) == want
    assert n == 3 and not store.done(n)


def texts(spark):
    rng, rows = random.Random(4), []
    words = [f"w{chr(97 + k)}" for k in range(12)]
    for i in range(160):
        bad = rng.random() < 0.4
        body = rng.choices(words, k=8) + ["vile"] * (bad and rng.random() < 0.6) + ["Late"] * (i > 90 and bad)
        text = None if i % 40 == 0 else " ".join(body) + " http://x.y #tag"
        rows.append((i // 2, text, "abusive" if bad else None if i % 11 == 0 else "normal", i, 1, 2, 3, i))
    columns = "id bigint, text string, class string, cntPosts int, cntLists bigint, cntFollowers bigint, cntFriends bigint, accountAge bigint"
    return spark.createDataFrame(rows, columns)


def test_texts_of_several_chunks(spark):
    """words of a chunk count from the next one on, an id that two chunks hold counts in each, and totals go on."""
    from pyspark.sql import Row

    names = ["wordsPerSentence", "cntPosts", "sentimentScoreNeg", "bow"]
    head = [Row(name=n, type="numeric", min=0.0, max=9.0, mean=4.0, stdev=2.0, domain=None) for n in names]
    head.append(Row(name="class", type="nominal", min=None, max=None, mean=None, stdev=None, domain=["normal", "x"]))

    def make():
        extractor = TweetExtractor(
            head, fixtures.lexicon(spark), normalize=2, preprocess=True, adaptive=True, min_docs=2)
        return TextLearner(extractor, LinearLearner(names, {"m": LinearOptions(4, 0.5)}))

    parts = replay.replay_file(texts(spark), "id", 33)
    one, whole = make(), make()
    want = stepped(one, parts)
    table = parts.numbered("row", "chunk").drop("row")
    got = walks.walk(whole, table.where("chunk < 3"), "chunk") + walks.walk(whole, table.where("chunk >= 3"), "chunk")
    assert near(got) == near(want)
    assert near(whole.learner.weights.values()) == near(one.learner.weights.values())
    words = [x.extractor.vocabulary for x in (one, whole)]
    assert words[0].totals == words[1].totals and told(words[0].counts(spark)) == told(words[1].counts(spark))
    # Two chunks' words were counted, and the texts that hold them differ.
    assert {"vile", "late"} <= {r.token for r in words[1].listed(spark).collect()}
    assert len(words[1].tables) == 2 < len(words[0].tables)


def test_one_chunk_stays_one_step(spark, data, tmp_path):
    """A stored batch is skipped, whether its chunks are named or not."""
    store, learner = ModelStore(spark, str(tmp_path / "store")), LEARNERS["outliers"]()
    rows = data.selectExpr("*", "CAST(id div 100 AS BIGINT) AS chunk")
    train_batch(store, learner, rows, 0, chunks="chunk")
    before = told(store.metrics())
    train_batch(store, learner, rows.limit(3), 0, chunks="chunk")
    assert told(store.metrics()) == before and len(before) == 2
