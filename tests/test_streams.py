"""Running streams, state that grows with a run, and metrics along it, against replays and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tunelens.operators import bow
from tunelens.plans import fixtures
from tunelens.session import scratch_path
from tunelens.sources import replay, runs
from tunelens.streaming import evaluate, vocabulary
from tunelens.streaming.clustering import StreamingKMeans
from tunelens.streaming.linear import LinearLearner, LinearOptions
from tunelens.streaming.outliers import OutlierDetector, outlier_counts
from tunelens.streaming.prequential import StepLog, prequential, prequential_rows
from tunelens.streaming.stream import CsvSink, ModelStore, feed, run_paced, stream_prequential, train_batch
from tunelens.streaming.trees import Feature, Forest, TreeLearner, TreeOptions
from tunelens.streaming.tweets import TextLearner, TweetExtractor

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    rows = []
    for i in range(360):
        a, b = rng.random(), rng.gauss(0, 1)
        rows.append((i, a, b if i % 17 else None, int((a > 0.4) != (rng.random() < 0.1))))
    return spark.createDataFrame(rows, "id bigint, a double, b double, label int").repartition(3).cache()


def kmeans():
    return StreamingKMeans(["a", "b"], 3, decay=0.5)


def outliers():
    return OutlierDetector(["a", "b"], limit=1.5)


def linear():
    return LinearLearner(["a", "b"], {"m": LinearOptions(2, 0.5)})


def tree():
    return TreeLearner([Feature("a"), Feature("b")], 2, {"t": TreeOptions(grace=20, confidence=0.3, tie=0.5)})


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("make", [kmeans, outliers, linear, tree])
def test_one_running_query_takes_the_chunks_in_order(spark, data, tmp_path, make):
    """Twelve chunks in one run; a run that stops after five and starts again ends the same."""
    parts = replay.replay_file(data, "id", 30)
    want = rows_of(prequential(spark, parts, make()))
    folder, store = str(tmp_path / "in"), ModelStore(spark, str(tmp_path / "store"))
    n = feed(parts, folder)
    assert n == 12

    def start():
        source = replay.dir_stream(spark, data.schema, max_files=1).parquet(folder)
        return stream_prequential(source, make(), store, str(tmp_path / "checkpoint"), interval="0 seconds")

    run_paced(start(), store, 5)
    assert store.done(4)
    run_paced(start(), store, n)
    assert rows_of(store.metrics()) == want
    # Repeating the last batch changes nothing.
    train_batch(store, make(), parts.batch(n - 1), n - 1)
    assert rows_of(store.metrics()) == want


def test_stream_that_ends_early_is_reported(spark, data, tmp_path):
    folder, store = str(tmp_path / "in"), ModelStore(spark, str(tmp_path / "store"))
    feed(replay.replay_file(data, "id", 180), folder)
    source = replay.dir_stream(spark, data.schema, max_files=1).parquet(folder)
    query = stream_prequential(source, linear(), store, str(tmp_path / "checkpoint"))
    with pytest.raises(RuntimeError, match="ended before"):
        run_paced(query, store, 5)


def test_limits_of_a_watched_folder(spark, data, tmp_path):
    folder = str(tmp_path / "in")
    feed(replay.replay_file(data, "id", 30), folder)

    def batches(**limits):
        seen = []
        source = replay.dir_stream(spark, data.schema, **limits).parquet(folder)
        query = source.writeStream.foreachBatch(lambda b, i: seen.append(b.count())).trigger(availableNow=True).start()
        query.awaitTermination()
        return seen

    assert batches() == [360]
    assert batches(max_files=5) == [150, 150, 60]
    assert batches(max_bytes="1") == [30] * 12


def test_repeated_chunks_do_not_appear_twice(spark, data, tmp_path):
    folder, parts = str(tmp_path / "in"), replay.replay_file(data, "id", 90)
    feed(parts, folder)
    feed(parts, folder, first=2)
    assert spark.read.parquet(folder).count() == 360


@pytest.mark.parametrize("header", [True, False])
def test_csv_sink(spark, data, tmp_path, header):
    parts, sink = replay.replay_file(data, "id", 120), CsvSink(spark, str(tmp_path / "s2" / "run_l0.5"), header)
    learner = linear()
    for i, batch in parts:
        rows = [(i, *r) for r in learner.step(batch)]
        metrics = learner.report(spark.createDataFrame(rows, f"batch bigint, {learner.row_schema}"))
        sink.commit(metrics, i)
        sink.commit(metrics.withColumn("accuracy", F.lit(0.0)), i)  # the batch is repeated
    back = runs.read_metrics_csv(spark, sink.path, header)
    want = prequential(spark, parts, linear()).orderBy("batch").collect()
    got = back.orderBy("batch").collect()
    assert [(r.exp, r.hp, r.batch, r.instances) for r in got] == [(2, "run_l0.5", i, 120) for i in range(3)]
    assert [r.accuracy for r in got] == pytest.approx([r.accuracy * 100 for r in want])


def test_batch_csv_without_header(spark, tmp_path):
    rows = [("s1", "x", b, 10, 0.5, 0.25, 0.125, 1.0) for b in range(3)]
    table = spark.createDataFrame(
        rows, "exp string, hp string, batch bigint, instances bigint, accuracy double, recall double, precision double, f1 double")
    runs.write_metrics_csv(table, str(tmp_path / "out"), header=False)
    assert runs.read_metrics_csv(spark, str(tmp_path / "out"), header=False).count() == 3


def test_steps_are_written_before_they_fill_the_driver(spark, monkeypatch):
    from tunelens.streaming import prequential as module

    monkeypatch.setattr(module, "PENDING_ROWS", 4)
    log = StepLog(spark, "n bigint")
    for i in range(7):
        log.add(i, [(i * 10,), (i * 10 + 1,)])
        assert len(log.pending) < 4
    assert sorted(tuple(r) for r in log.table().collect()) == sorted((i, i * 10 + k) for i in range(7) for k in (0, 1))


def texts(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + k)}" for k in range(12)]
    rows = []
    for i in range(200):
        bad = rng.random() < 0.4
        body = rng.choices(words, k=8) + (["vile"] * (rng.random() < 0.6 and bad)) + (["late"] * (i > 120 and bad))
        rows.append((i, " ".join(body) if i % 40 else None, "abusive" if bad else "normal"))
    return spark.createDataFrame(rows, "id bigint, text string, class string")


@pytest.mark.parametrize("compact", [2, 100])
def test_vocabulary_as_state(spark, monkeypatch, compact):
    """The list before every batch is that of the whole replay, also across a restart; tables stay few."""
    monkeypatch.setattr(vocabulary, "COMPACT_EVERY", compact)
    parts = replay.replay_file(texts(spark), "id", 20)
    table = bow.adaptive_vocabulary(parts.table(), "normal").collect()
    marked = {r.id: r.bow for r in bow.adaptive_bow(parts.table(), "normal").collect()}
    words, listed = vocabulary.Vocabulary("normal"), set()
    for i, batch in parts:
        if i == 5:
            again = vocabulary.Vocabulary("normal")
            again.load(words.state())
            words = again
        now = {r.token for r in words.listed(spark).collect()}
        assert now == {r.token for r in table if r.chunk_id == i}
        assert {r.id: r.bow for r in words.mark(batch).collect()} == {r.id: marked[r.id] for r in batch.collect()}
        words.learn(batch)
        listed |= now
        assert len(words.tables) <= compact + 1
    assert {"vile", "late"} <= listed and words.counts(spark).count() == words.counts(spark).select("token").distinct().count()


def test_met_words_are_the_listed_ones(spark):
    table = replay.replay_file(texts(spark), "id", 20).table()
    listed = {tuple(r) for r in bow.adaptive_vocabulary(table, "normal").select("chunk_id", "token").collect()}
    met = {tuple(r) for r in bow.listed_where_met(table, "normal").select("chunk_id", "token").collect()}
    held = {tuple(r) for r in bow.token_counts(table, "normal").select("chunk_id", "token").collect()}
    assert met == listed & held


def head(names, scale=2.0):
    from pyspark.sql import Row

    numeric = [Row(name=n, type="numeric", min=0.0, max=scale, mean=scale / 2, stdev=scale, domain=None) for n in names]
    return [*numeric, Row(name="class", type="nominal", min=None, max=None, mean=None, stdev=None, domain=["normal", "x"])]


def tweets_table(spark):
    return fixtures.tweets(spark, SF).where("class IS NOT NULL")


def test_extractor_follows_its_head_file(spark):
    rows, lexicon = tweets_table(spark), fixtures.lexicon(spark)
    names = ["numUrls", "wordsPerSentence", "cntSwearWords"]
    plain = TweetExtractor(head(names), lexicon).rows(rows)
    assert plain.columns == ["id", *names, "label"] and plain.count() == rows.count()
    scaled = TweetExtractor(head(names), lexicon, normalize=1).rows(rows)
    one, two = (r for r in (plain.orderBy("id").first(), scaled.orderBy("id").first()))
    assert [two[n] for n in names] == pytest.approx([one[n] / 2 for n in names])
    cleaned = TweetExtractor(head(names), lexicon, preprocess=True).rows(rows)
    assert rows_of(cleaned.select("id", "wordsPerSentence")) != rows_of(plain.select("id", "wordsPerSentence"))
    with pytest.raises(ValueError, match="no such features"):
        TweetExtractor(head(["bow"]), lexicon)
    with pytest.raises(ValueError, match="no such features"):
        TweetExtractor(head(["colour"]), lexicon, adaptive=True)


def test_texts_stream_into_a_tree(spark, tmp_path):
    """The words of the run and the leaves of the tree are both state: a stream equals the replay."""
    names = ["numUpperCases", "cntSwearWords", "bow"]

    def make():
        extractor = TweetExtractor(head(names), fixtures.lexicon(spark), adaptive=True, min_docs=2)
        return TextLearner(extractor, TreeLearner([Feature(n) for n in names], 2, {"t": TreeOptions(grace=10, tie=0.9)}))

    parts = replay.replay_file(tweets_table(spark), "id", 25)
    want = rows_of(prequential(spark, parts, make()))
    folder, store = str(tmp_path / "in"), ModelStore(spark, str(tmp_path / "store"))
    n = feed(parts, folder, "json")
    for stop in (2, n):
        source = replay.dir_stream(spark, parts.batch(0).schema, max_files=1).json(folder)
        query = stream_prequential(source, make(), store, str(tmp_path / "checkpoint"), interval="0 seconds")
        run_paced(query, store, stop)
    assert rows_of(store.metrics()) == want and n > 2


def test_rows_by_model_version(spark, data):
    """Row predictions add up to the counts of the run; versions may be kept for some batches only."""
    parts = replay.replay_file(data, "id", 60)
    rows = prequential_rows(spark, parts, linear()).cache()
    assert rows.count() == 360
    got = evaluate.classification_metrics(
        evaluate.confusion(rows.withColumnRenamed("chunk_id", "batch"), ["member", "batch"]), ["member", "batch"])
    assert rows_of(got) == rows_of(prequential(spark, parts, linear()))
    learner = linear()
    few, models = [], []
    for i, batch in parts:
        if i % 4 == 0:
            few += learner.versions(i)
            models.append(dict(learner.weights))
        learner.step(batch)
    table = spark.createDataFrame(few, "batch bigint, member string, w array<array<double>>")
    for r in learner.predict_by_version(parts.table(), table).collect():
        w = models[r.chunk_id // 4]["m", 0]
        assert r.prediction == int(w[0] * r.a + w[1] * (r.b or 0.0) + w[2] > 0)


@pytest.mark.parametrize("frequency,width", [(499, 200), (200, 499), (7, 3), (5, 50), (1000, 10)])
def test_samples_of_any_two_lengths(spark, frequency, width):
    rng = random.Random(frequency)
    pairs = [(i, rng.randrange(2), rng.randrange(2)) for i in range(1200)]
    df = spark.createDataFrame(pairs, "id bigint, label int, prediction int")
    got = {r.rows: (r.instances_all, r.accuracy_all, r.instances_last, r.accuracy_last)
           for r in evaluate.sampled_metrics(df, [], "id", frequency, width).collect()}
    want = {}
    for at in range(frequency, 1201, frequency):
        seen, last = pairs[:at], pairs[max(at - width, 0) : at]
        share = lambda v: pytest.approx(sum(p[1] == p[2] for p in v) / len(v), abs=1e-6)
        want[at] = (len(seen), share(seen), len(last), share(last))
    assert got == want


def test_outliers_equal_in_both_forms(spark, data):
    parts = replay.replay_file(data, "id", 40)
    assert rows_of(prequential(spark, parts, outliers())) == rows_of(outlier_counts(parts.table(), ["a", "b"], limit=1.5))


def test_forest_votes_alike_for_small_and_large_models(spark, data, monkeypatch):
    from tunelens.streaming import trees

    features = [Feature("a"), Feature("b")]
    runs_of = []
    for limit in (trees.BROADCAST_LEAVES, 0):
        monkeypatch.setattr(trees, "BROADCAST_LEAVES", limit)
        forest = Forest(features, 2, TreeOptions(grace=20, confidence=0.3, tie=0.5), size=3)
        runs_of.append(rows_of(prequential(spark, replay.replay_file(data, "id", 90), forest)))
    assert runs_of[0] == runs_of[1]


def test_chunks_and_models_are_laid_down_without_a_job_each(spark, data, tmp_path):
    """Feeding takes as many jobs for many chunks as for few, and storing a model or metrics takes none."""

    def jobs(group, act):
        spark.sparkContext.setJobGroup(group, group)
        act()
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = (replay.replay_file(data, "id", size) for size in (200, 10))
    n = [jobs(f"feed-{k}", lambda: feed(parts, str(tmp_path / f"to-{k}"))) for k, parts in enumerate((few, many))]
    assert n[0] == n[1] <= 4  # 2 chunks, and 40
    assert [len(list((tmp_path / f"to-{k}").glob("chunk-*.parquet"))) for k in (0, 1)] == [len(few), len(many)]
    last = spark.read.parquet(str(tmp_path / "to-1" / f"chunk-{len(many) - 1:09d}.parquet"))
    assert rows_of(last) == rows_of(many.batch(len(many) - 1)) and last.columns == data.columns

    store, learner = ModelStore(spark, str(tmp_path / "store")), outliers()
    learner.step(few.batch(0))

    def keep():
        store.save_model(learner, 0)
        store.load_model(learner, 0)

    assert jobs("models", keep) == 0
