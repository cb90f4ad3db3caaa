"""ARFF, profiles, features and texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelens.functions import text as t
from tunelens.operators import bow, features, profile
from tunelens.sources import arff, replay
from tunelens.sources.tweets import read_tweets

RELATION = """% a comment
@relation demo
@attribute width numeric
@attribute colour {red,green,blue}
@attribute class {yes,no}

@data
1.5,red,yes
% between

-2,green,no
4,red,no
"""


@pytest.fixture
def relation(spark, tmp_path):
    path = tmp_path / "a.arff"
    path.write_text(RELATION)
    return arff.read_arff(spark, str(path))


def test_read(relation):
    assert [tuple(r) for r in relation.collect()] == [(1.5, "red", "yes"), (-2.0, "green", "no"), (4.0, "red", "no")]
    assert relation.schema["colour"].metadata["domain"] == ["red", "green", "blue"]


def test_one_header_for_all_files(spark, tmp_path):
    """Files without a header are rows, a repeated header is checked, another one fails."""
    (tmp_path / "a.arff").write_text(RELATION)
    (tmp_path / "b.arff").write_text("9,blue,yes\n")
    (tmp_path / "c.arff").write_text(RELATION.replace("%", "@relation again\n%", 1).replace("-2,green,no\n", ""))
    df = arff.read_arff(spark, str(tmp_path))
    assert df.columns == ["width", "colour", "class"] and df.count() == 6
    (tmp_path / "d.arff").write_text(RELATION.replace("blue", "pink"))
    with pytest.raises(ValueError, match="declare different attributes"):
        arff.read_arff(spark, str(tmp_path))
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.arff").write_text("1,2\n")
    with pytest.raises(ValueError, match="no @data"):
        arff.read_arff(spark, str(tmp_path / "e"))


def test_lookup_with_frequent_keys(spark):
    from tunelens.operators.ordering import lookup

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 9}") for i in range(300)], "id int, token string")
    table = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3)], "token string, score int")
    want = sorted(map(tuple, rows.join(table, "token").collect()))
    for limit in (10, 0):
        assert sorted(map(tuple, lookup(rows, table, "token", "id", limit).collect())) == want


def test_scratch_tables_have_an_owner(spark, tmp_path):
    import os

    from tunelens.session import scratch_scope, shared_dir, stored

    root = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with pytest.raises(RuntimeError), scratch_scope(spark):
        outer = stored(spark.range(3), "outer")
        with scratch_scope(spark):
            inner = stored(spark.range(4), "inner")
            assert inner.count() == 4
        assert {n.split("-")[0] for n in set(os.listdir(root)) - before} == {"outer"} and outer.count() == 3
        raise RuntimeError
    assert set(os.listdir(root)) == before


def test_bad_number_fails(spark, tmp_path):
    (tmp_path / "a.arff").write_text(RELATION + "wide,red,yes\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        arff.read_arff(spark, str(tmp_path)).collect()


def test_profile(relation):
    rows = {r.name: r for r in profile.profile(relation).collect()}
    width = [1.5, -2.0, 4.0]
    assert (rows["width"].min, rows["width"].max) == (-2.0, 4.0)
    assert rows["width"].mean == pytest.approx(np.mean(width)) and rows["width"].stdev == pytest.approx(np.std(width))
    assert rows["colour"].counts == {"red": 2, "green": 1, "blue": 0} and rows["colour"].domain == ["red", "green", "blue"]
    assert profile.feature_count(profile.profile(relation)).first().features == 2


def test_undeclared_value_fails(spark, tmp_path):
    (tmp_path / "a.arff").write_text(RELATION + "1,pink,yes\n")
    with pytest.raises(Exception, match="undeclared value of colour: pink"):
        profile.profile_nominal(arff.read_arff(spark, str(tmp_path))).collect()


def test_round_trips(spark, relation, tmp_path):
    arff.write_arff(relation, str(tmp_path / "out"))
    back = arff.read_arff(spark, str(tmp_path / "out"))
    assert back.schema == relation.schema and sorted(back.collect()) == sorted(relation.collect())
    stats = profile.profile(relation)
    arff.write_arff_head(stats, str(tmp_path / "head"))
    want = {r.name: (r.type, r.min, r.max, r.mean, r.stdev, r.domain, r.counts) for r in stats.collect()}
    head = arff.read_arff_head(spark, str(tmp_path / "head")).collect()
    assert {r.name: (r.type, r.min, r.max, r.mean, r.stdev, r.domain, r.counts) for r in head} == want


def test_trailing_comma(spark):
    lines = spark.createDataFrame([("% a,",), ("@attribute x numeric,",), ("1,2,",), ("3,4",)], "value string")
    assert [r.value for r in arff.clean_trailing(lines).collect()] == ["% a,", "@attribute x numeric,", "1,2", "3,4"]


@pytest.mark.parametrize("mode", [0, 1, 2, 3])
def test_normalisation(spark, relation, mode):
    stats = profile.profile(relation).collect()
    got = [r.width for r in features.normalize_features(relation, stats, mode).collect()]
    w = np.array([1.5, -2.0, 4.0])
    low, high = (max(w.min(), w.mean() - 3 * w.std()), min(w.max(), w.mean() + 3 * w.std())) if mode == 2 else (w.min(), w.max())
    want = {0: w, 1: (w - w.min()) / 6, 2: (np.clip(w, low, high) - low) / (high - low), 3: (w - w.mean()) / w.std()}[mode]
    assert got == pytest.approx(list(want))
    colours = [r.colour for r in features.normalize_features(relation, stats, mode).collect()]
    assert colours == [0.0, 1.0, 0.0]


def test_flat_column_becomes_zero(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    stats = profile.profile(df).collect()
    assert [r.x for m in (1, 2, 3) for r in features.normalize_features(df, stats, m).collect()] == [0.0] * 6


def test_variants_in_one_scan(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    got = {r.variant: (r.a, r.b) for r in features.drop_variants(df, {"x": ["a"], "y": ["a", "b"]}).collect()}
    assert got == {"all": (2.0, 3.0), "no_x": (None, 3.0), "no_y": (None, None)}
    with pytest.raises(ValueError):
        features.drop_features(df, ["zz"])


TEXT = "RT @bob: LOOK at THIS https://x.org/a?b=1 #Wow 42 times! It's fine. A... #two"


def test_text(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "")], "id int, text string")
    got = features.text_features(df).orderBy("id").collect()
    assert (got[0].numHashtags, got[0].numUrls, got[0].numUpperCases) == (2, 1, 3)
    assert (got[1].wordsPerSentence, got[1].meanWordLength) == (0.0, 0.0)
    clean = df.select(t.preprocess_text(F.col("text")).alias("c")).first().c
    assert clean == "LOOK at THIS Wow times! It s fine. A... two"
    cleaned = features.text_features(df, preprocess=True).orderBy("id").first()
    assert cleaned.wordsPerSentence == pytest.approx(10 / 4)


def test_words_of_any_script(spark):
    row = spark.createDataFrame([("einütz Ñga ÄÖ @jürgen #größe",)], "text string").select(
        t.words(F.col("text")).alias("w"), t.tokens(F.col("text")).alias("k"), t.upper_words(F.col("text")).alias("u"),
        t.letters(F.col("text")).alias("n"), t.preprocess_text(F.col("text")).alias("c")).first()
    assert row.w == ["einütz", "Ñga", "ÄÖ", "jürgen", "größe"] and row.k[1] == "ñga" and row.u == 1 and row.n == 22
    assert row.c == "einütz Ñga ÄÖ größe"


@pytest.mark.parametrize("broadcast", [0, 100])
def test_lexicon(spark, monkeypatch, broadcast):
    monkeypatch.setattr(features, "LEXICON_BROADCAST", broadcast)
    df = spark.createDataFrame(
        [(1, "Bad bad good run, quickly"), (2, "none"), (3, "good"), (4, None), (5, "like")], "id int, text string")
    lexicon = spark.createDataFrame(
        [("bad", "swear", -2.0), ("good", "adjective", 1.5), ("run", "verb", None), ("quickly", "adverb", 0.5),
         ("like", "adjective", 1.0), ("like", "verb", 2.0)],
        "token string, tag string, score double")
    rows = features.lexicon_features(df, lexicon).orderBy("id").collect()
    first = rows[0]
    assert (rows[3].cntVerbs, rows[3].sentimentScorePos) == (0, 0.0)
    assert (rows[4].cntAdjective, rows[4].cntVerbs, rows[4].sentimentScorePos) == (1, 1, 3.0)
    assert (first.cntSwearWords, first.cntAdjective, first.cntVerbs, first.cntAdverbs) == (2, 1, 1, 1)
    assert (first.sentimentScorePos, first.sentimentScoreNeg) == (2.0, -4.0)


def test_user_features(spark):
    df = spark.createDataFrame([(1, 5, None, 7, 8, "2024-01-01")], "id int, cntLists int, cntPosts int, cntFollowers int, cntFriends int, createdAt string")
    row = features.user_features(df, F.lit("2024-01-31").cast("date")).first()
    assert (row.accountAge, row.cntPosts, row.cntLists) == (30, 0, 5)


def test_tweets(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "text": "x", "class": "normal", "cntPosts": 3}\n')
    row = read_tweets(spark, str(tmp_path)).first()
    assert (row.id, row["class"], row.cntPosts, row.accountAge) == (1, "normal", 3, None)


def test_adaptive_bag_of_words_against_a_loop(spark):
    import random

    rng = random.Random(4)
    docs = []
    for i in range(300):
        cls = "normal" if rng.random() < 0.6 else "abusive"
        words = [rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(4)] + (["bad"] if cls == "abusive" and i < 200 else ["bad"] if i >= 200 and cls == "normal" else [])
        docs.append((i, " ".join(words), cls, i // 30))
    df = spark.createDataFrame(docs, "id bigint, text string, class string, chunk_id bigint")
    listed, seen, total, want = set(), {}, {"normal": 0, "abusive": 0}, {}
    for b in range(10):
        for i, text, cls, chunk in docs:
            if chunk == b:
                want[i] = sum(w in listed for w in text.split())
        for i, text, cls, chunk in docs:
            if chunk == b:
                total[cls] += 1
                for w in set(text.split()):
                    seen.setdefault(w, {"normal": 0, "abusive": 0})[cls] += 1
        listed = {w for w, n in seen.items() if sum(n.values()) >= 10 and n["abusive"] / total["abusive"] > 2 * n["normal"] / total["normal"]}
    got = {r.id: r.bow for r in bow.adaptive_bow(df, "normal").collect()}
    assert got == want and any(want.values())


def test_replay_and_partitions(spark):
    df = spark.range(95).repartition(4)
    r = replay.replay_file(df, "id", chunk=10, limit=42)
    assert [[x.id for x in sorted(b.collect())] for _, b in r] == [list(range(i, min(i + 10, 42))) for i in range(0, 42, 10)]
    assert {(x.id, x.chunk_id) for x in r.table().collect()} == {(i, i // 10) for i in range(42)}
    assert replay.replay_file(df, "id", chunk=10).rows == 95  # all rows unless a limit is set
    parts = replay.dir_partitions(df, "id", max_count=20).collect()
    assert {(x.id, x.partition_id) for x in parts} == {(i, i // 20) for i in range(95)}
