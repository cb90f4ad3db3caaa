"""Ranked search against a plain loop over all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tunelens.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c + 32 for c in range(0x41, 0x5B)})


def plain_words(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_search(docs, items, k):
    counts = [(d, Counter(plain_words(t))) for d, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        found = []
        for doc, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_words if n_words else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t in set(plain_words(text)) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [
    (1, "One two THREE"), (2, "wörd5 tail3 tail4 six"), (3, None), (4, " .,; "), (None, "one 12345 日本語"), (1, "One two THREE"),
    (5, " ".join(f"tail{i} wörd{i}" for i in range(31))), (6, "nowhere"), (7, "ÜBER über Über"),
]


def test_odd_documents(spark, odd_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 AS score", "2 AS rank")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(ranked.search(odd_docs, items)) == plain_search(docs, ITEMS, 10)
    assert rows_of(ranked.search(odd_docs, items, k=2)) == plain_search(docs, ITEMS, 2)


@pytest.mark.parametrize("block,bucket,focus", [(2048, 1024, 8), (7, 16, 2)])
def test_given_documents(spark, monkeypatch, block, bucket, focus):
    """Whole result, also where many blocks, small buckets and few exact terms make every bound work."""
    for name, value in (("QUERY_BLOCK", block), ("BUCKET", bucket), ("FOCUS", focus)):
        monkeypatch.setattr(ranked, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()],
                        [tuple(r) for r in items.select("item_id", "text").collect()], 10)
    assert rows_of(ranked.search(docs, items)) == want


def test_bounds_never_lose_a_vector():
    rng = np.random.default_rng(7)
    for _ in range(50):
        lists = [np.sort(rng.choice(40, rng.integers(1, 25), replace=False)) for _ in range(60)]
        ends = np.append(0, np.cumsum([len(t) for t in lists]))
        terms = np.concatenate(lists)
        impacts = rng.integers(1, 10**9, len(terms))
        norms = np.array([math.sqrt(sum(float(v) ** 2 for v in impacts[a:b])) for a, b in zip(ends, ends[1:])])
        bucket = ranked.Bucket(terms, impacts, ends, norms, 40)
        query = rng.permutation(40)[: rng.integers(1, 30)]
        exact = np.array([impacts[a:b][np.isin(terms[a:b], query)].sum() for a, b in zip(ends, ends[1:])])
        assert (bucket.scores(query, np.arange(60)) == exact).all()
        kth = int(np.sort(exact)[-5])
        left = bucket.survivors(query, kth)
        assert set(np.flatnonzero((exact >= kth) & (exact > 0))) <= set(left.tolist())
        assert math.sqrt(len(query)) * bucket.longest * ranked.SLACK >= exact.max()


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert rows_of(ranked.search(no_docs, items)) == []
    assert rows_of(ranked.search(odd_docs, items.where("false"))) == []
    assert rows_of(ranked.search(odd_docs.where("text IS NULL"), items)) == []
