"""Repeated passages against a plain count of all runs of words."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tunelens.llm import substring


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    runs = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if runs[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)

    def fresh(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    shared = [fresh(n) for n in (34, 35, 36, 60, 90, 200)]
    texts = []
    for _ in range(40):
        parts = fresh(rng.randrange(5, 60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(0, len(p) - 30)
            parts += p[a : a + rng.randrange(30, len(p) + 1)] + fresh(rng.randrange(0, 40))
        texts.append(rng.choice([" ", "  ", "\n"]).join(parts))
    texts += [texts[3], texts[3], texts[4].replace(" ", "\t"), " ".join(shared[5] + shared[5]), "a b " * 60, "a b " * 40, "z " * 36, "y " * 35]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_parse(spark, odd_docs, seed):
    texts = corpus(seed)
    made = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs = odd_docs.unionByName(made, allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows], 35))]
    got = [tuple(r)[:4] for r in substring.parse(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(0 < w[2] < w[1] for w in want) > 10


def test_runs_and_anchors():
    words = [f"{i % 7}".encode() for i in range(90)]
    rolling = substring.Rolling(words)
    for length in (1, 2, 8, 35):
        hashes = rolling.runs(length).tolist()
        runs = [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]
        assert len(hashes) == len(runs) and len(set(hashes)) == len(set(runs)) == len(set(zip(hashes, runs)))
    grams = rolling.runs(8)
    picked = {int(min(grams[i : i + 28])) for i in range(90 - 34)}
    found, at = substring.anchors(words, 35, 8)
    assert set(found.tolist()) == picked
    assert at.tolist() == [p for p in range(83) if any(grams[p] == grams[i : i + 28].min() for i in range(max(0, p - 27), min(p, 55) + 1))]


def test_factors():
    first, end, source = substring.factors(np.array([3, 4, 5, 6, 20, 21]), np.array([100, 101, 50, 51, 52, 53]), 35)
    assert (first.tolist(), end.tolist(), source.tolist()) == ([3, 5, 20], [39, 41, 56], [100, 50, 52])


def test_empty(no_docs):
    assert substring.parse(no_docs).count() == 0
