"""Toxicity and language models: exactness of the search, calibration, and accuracy on held-out rows."""

import os
import pickle
import zlib

import numpy as np
import pytest

from tunelens.llm import langid, toxicity

SF = "/root/testdata/sf0.1"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def held_out(doc_id, parts, held):
    return zlib.crc32(str(doc_id).encode()) % parts == held


@pytest.mark.parametrize(("terms", "rows"), [(40, 40), (40, 7), (400, 0), (400, 9)])
def test_nearest_is_exact(monkeypatch, terms, rows):
    """With all terms common, some, or none."""
    monkeypatch.setattr(toxicity, "COMMON", 900)
    monkeypatch.setattr(toxicity, "MOST_COMMON", rows)
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(900):
        at = np.sort(rng.choice(terms, int(rng.integers(1, 6)), replace=False))
        x = rng.random(len(at))
        vectors.append((at, x / np.linalg.norm(x)))
    vectors += vectors[:50]
    index = toxicity.BlockMaxIndex.of(vectors, terms)
    assert len(index.rows) == rows
    dense = np.zeros((len(vectors), terms))
    for i, (at, x) in enumerate(vectors):
        dense[i, at] = x
    for i in range(0, 900, 7):
        cos = dense @ dense[i]
        cos[i] = 0
        order = [j for j in np.lexsort((np.arange(len(cos)), -np.round(cos, 12))) if cos[j] > 0][:15]
        found, score = index.nearest(*vectors[i], 15, without=i)
        assert found.tolist() == order and np.allclose(score, cos[order])


def test_logistic_recovers_a_curve():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000) * 2
    y = rng.random(20_000) < 1 / (1 + np.exp(-(1.7 * x - 0.6)))
    slope, offset = toxicity.logistic(x, y.astype(float), np.ones(20_000))
    assert abs(slope - 1.7) < 0.1 and abs(offset + 0.6) < 0.1
    assert toxicity.logistic(x, 1.0 - y, np.ones(20_000))[0] == 0


@given
def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    caught = sum(p for p, y in judged if y) / sum(y for _, y in judged)
    wrong = sum(p for p, y in judged if not y) / sum(1 - y for _, y in judged)
    assert caught >= 0.85 and wrong <= 0.015
    shown = next(r for r in rows if r.predicted)
    assert shown.evidence and shown.similarity == sorted(shown.similarity, reverse=True)


def test_toxicity_odd(spark, odd_docs, no_docs):
    words = [f"w{i:03d}x".replace("0", "o").replace("1", "i") for i in range(200)]
    rng = np.random.default_rng(1)
    made = []
    for i in range(400):
        text = " ".join(rng.choice(words, 30))
        made.append((1000 + i, text + (" vileword" if i % 4 == 0 else ""), int(i % 4 == 0)))
    table = spark.createDataFrame(made, "doc_id bigint, text string, toxic int")
    labels = table.select("doc_id", "toxic").unionByName(
        spark.createDataFrame([(None, 1), (1001, None), (4, 0), (5, 0)], "doc_id bigint, toxic int"))
    docs = odd_docs.unionByName(table.drop("toxic"), allowMissingColumns=True)
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == docs.count()
    assert all(r.predicted == (r.doc_id is not None and r.doc_id >= 1000 and r.doc_id % 4 == 0) for r in rows)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 100
    nothing = toxicity.train(no_docs, labels.where("false"))
    assert toxicity.scored(no_docs, nothing).count() == 0
    assert {r.score for r in toxicity.scored(odd_docs, nothing).collect()} == {0.5}


def test_toxicity_of_weaker_words(spark):
    """Toxic texts hold five of 20 words that clean ones have too, a tenth as often, and no word or beginning marks them."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    plain = ["".join(rng.choice(letters, 7)) for _ in range(300)]
    weak = ["".join(rng.choice(letters, 7)) for _ in range(20)]
    made = []
    for i in range(900):
        toxic = i % 3 == 0
        words = [*rng.choice(plain, 25), *rng.choice(weak, 5 if toxic else int(rng.integers(2)), replace=False)]
        made.append((i, " ".join(rng.permutation(words)), int(toxic)))
    table = spark.createDataFrame(made, "doc_id bigint, text string, toxic int")
    docs = table.drop("toxic")
    rows = toxicity.scored(docs, toxicity.train(docs, table.drop("text"))).collect()
    judged = [r for r in rows if r.held_out]
    assert all(r.evidence for r in judged)
    assert sum(r.predicted for r in judged if r.doc_id % 3 == 0) >= 0.9 * sum(r.doc_id % 3 == 0 for r in judged)
    assert sum(r.predicted for r in judged if r.doc_id % 3) <= 0.02 * sum(r.doc_id % 3 > 0 for r in judged)


def test_features():
    at, counts = langid.features("Aé! aé")
    assert counts.sum() == 7 + 6 + 5 and (at < langid.DIMENSIONS).all()
    for text in (None, "", "12 !?", " \n"):
        assert len(langid.features(text)[0]) == 0
    assert langid.features("AB, 3 cd")[0].tolist() == langid.features("ab cd")[0].tolist()


def test_leader_is_sparse_and_right():
    rng = np.random.default_rng(3)
    leader = langid.Leader(50, 3)
    for _ in range(3000):
        y = int(rng.integers(3))
        at = np.unique(np.append(rng.integers(10, 50, 6), y))
        leader.learn(at, np.full(len(at), len(at) ** -0.5), y)
    w = leader.weights(np.arange(50))
    assert (w[:3].argmax(1) == [0, 1, 2]).all() and np.diag(w[:3]).min() > np.abs(w[10:]).max()
    assert (leader.weights(np.arange(3, 10)) == 0).all()


def test_temperature():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(20_000, 4))
    labels = np.array([rng.choice(4, p=p) for p in langid.softmax(z)])
    assert abs(langid.best_temperature(3 * z, labels) - 3) < 0.2


@given
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.language_id(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and truth[r.doc_id] is not None]
    right = np.array([r.lang_pred == truth[r.doc_id] for r in judged])
    assert right.mean() >= 0.97
    assert abs(right.mean() - np.mean([r.score for r in judged])) < 0.03


def test_language_odd(odd_docs, no_docs):
    rows = {r.doc_id: r for r in langid.language_id(odd_docs).collect() if r.doc_id is not None}
    for i in (0, 1, 2, 3):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert {r.lang_pred for r in rows.values()} <= {"und", "en", "de"}
    assert langid.language_id(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.train(no_docs)).collect()} == {"und"}


def test_terms_keep_nothing_of_the_texts():
    """Words and their beginnings are counted as one by one, and a worker's table does not grow with the words it meets."""
    from collections import Counter

    known = toxicity.Terms(["idiot", "idio~", "idiots~", "a", "street", "stre~"])
    size = lambda: len(pickle.dumps(known))
    before, rng = size(), np.random.default_rng(4)
    vocabulary = ["idiot", "idiots", "idiotic", "a", "street", "streets", "strong", *[f"w{chr(97 + i % 26)}{i}" for i in range(5_000)]]
    texts = [Counter(rng.choice(vocabulary, int(rng.integers(0, 400))).tolist()) for _ in range(40)] + [Counter(["idiots", "idiot"])]
    text, term, times = known.counts(texts)
    want = {}
    for i, words in enumerate(texts):
        for word, n in words.items():
            for t in toxicity.word_terms(word):
                if t in known.number:
                    want[i, known.number[t]] = want.get((i, known.number[t]), 0) + n
    assert list(zip(text.tolist(), term.tolist())) == sorted(want)
    assert dict(zip(zip(text.tolist(), term.tolist()), times.tolist())) == want
    assert size() == before
