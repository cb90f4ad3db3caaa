"""SimHash links and components against plain loops over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tunelens.llm import simhash
from tunelens.llm.components import components


def plain_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius", [2, 3, 4])
def test_near_finds_every_pair(spark, radius):
    rng = random.Random(radius)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.choice([0, 1, 2, 20, 21, 40, 41, 42, 62, 63, rng.randrange(64)])
            prints.add(x)
    table = spark.createDataFrame([(signed(x),) for x in prints], "fp bigint")
    got = {tuple(r) for r in simhash.near(table, radius).collect()}
    want = {(max(signed(a), signed(b)), min(signed(a), signed(b)))
            for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius}
    assert got == want and len(want) > 50


def test_components(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert got == groups(nodes, [p for p in links if p[0] != p[1]])


def variants(rng):
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = [" ".join(base)]
    for _ in range(8):
        copy = list(base)
        for _ in range(rng.randrange(1, 3)):
            copy[rng.randrange(120)] = f"x{rng.randrange(99)}"
        out.append((" " * rng.randrange(1, 3)).join(copy).upper())
    return out


def test_digest(spark, odd_docs):
    rng = random.Random(4)
    made = [t for _ in range(6) for t in variants(rng)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(made)], "doc_id bigint, text string")
    docs = odd_docs.where("doc_id IS NOT NULL").unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, plain_fingerprint(r.text, 3)) for r in docs.collect()]
    links = [(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 2]
    want = groups({a for a, _ in rows}, links)
    got = sorted(tuple(r) for r in simhash.digest(docs).collect())
    assert got == sorted((d, f"{fp:016x}", want[d]) for d, fp in rows)
    assert sum(want[a] != a for a, _ in rows) >= 10


def test_null_ids_and_empty(odd_docs, no_docs):
    assert simhash.digest(odd_docs).count() == odd_docs.count()
    assert simhash.digest(no_docs).count() == 0
    assert simhash.drop_near(no_docs).count() == 0


def test_estimate():
    rng = random.Random(2)
    for size, tolerance in ((60, 0.08), (3000, 0.09)):
        base = [str(rng.random()).encode() for _ in range(size)]
        for keep in (1.0, 0.9, 0.5, 0.0):
            n = int(size * keep)
            other = base[:n] + [str(rng.random()).encode() for _ in range(size - n)]
            pair = [np.frombuffer(simhash.sketch(simhash.hashed(set(x))), np.uint8)[None] for x in (base, other)]
            assert abs(float(simhash.estimated(*pair)[0]) - n / (2 * size - n)) < tolerance
    empty = np.frombuffer(simhash.sketch(simhash.hashed(set())), np.uint8)[None]
    assert float(simhash.estimated(empty, empty)[0]) == 1.0


def jaccard(a, b):
    x, y = (set(zip(*[t.lower().split()[i:] for i in range(5)])) for t in (a, b))
    return len(x & y) / len(x | y)


def test_drop_near(spark, odd_docs):
    rng = random.Random(6)
    families = [variants(rng) for _ in range(12)]
    unrelated = [" ".join(f"u{rng.randrange(4000)}" for _ in range(150)) for _ in range(60)]
    texts = [t for f in families for t in f] + unrelated
    made = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.drop_near(made).collect()}
    assert {1000 + 9 * i for i in range(12)} <= kept
    assert {1000 + 108 + i for i in range(60)} <= kept
    near = [(9 * f + i, j) for f, family in enumerate(families) for i in range(1, 9) for j in [jaccard(family[0], family[i])]]
    close = [1000 + d for d, j in near if j >= 0.8]
    assert len(close) > 50 and sum(d not in kept for d in close) >= 0.9 * len(close)
    odd = simhash.drop_near(odd_docs)
    assert odd.columns == odd_docs.columns
    left = odd.collect()
    assert sum(r.text is None or not r.text.split() for r in left if r.doc_id is not None) == 1
    assert sum(r.doc_id is None for r in left) == 2


def chained(rng):
    """Texts H, X, Y: X has the words of H in another order of passages, so the same search fingerprints, and Y is nearer to X
    than to H. Passages are moved until X is like H and like Y, but H is not like Y."""
    while True:
        words = [f"v{rng.randrange(10**6)}" for _ in range(240)]
        parts = [words[i : i + 20] for i in range(0, 240, 20)]
        other = [parts[i] for i in (1, 0, 3, 2, *range(4, 12))]
        last = [parts[i] for i in (1, 0, 3, 2, 4, 5, 7, 6, 9, 8, 10, 11)]
        h, x, y = (" ".join(w for p in q for w in p) for q in (parts, other, last))
        if jaccard(h, x) >= 0.8 and jaccard(x, y) >= 0.8 > jaccard(h, y) + 0.02:
            return h, x, y


def test_drop_near_through_other_members(spark):
    """The copy that joins Y to the group is not the one that stands for its fingerprint."""
    rng = random.Random(12)
    texts = [t for _ in range(20) for t in chained(rng)]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    pairs = [(a, b) for a in range(60) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8]
    want = groups(range(60), pairs)
    kept = {r.doc_id - 100 for r in simhash.drop_near(docs).collect()}
    assert kept == {i for i in range(60) if want[i] == i} == set(range(0, 60, 3))


def test_drop_near_is_exact_at_the_threshold(spark):
    """Reordered copies just above and just below 0.8, with the same search fingerprints and more shingles than buckets."""
    rng = random.Random(13)
    texts = []
    for f in range(40):
        parts = [[f"v{rng.randrange(10**6)}" for _ in range(10)] for _ in range(120)]
        cuts = 33 if f % 2 else 34  # passages that follow another than before: 132 or 136 shingles of 1,196 change
        moved = parts[: 120 - cuts] + parts[: 119 - cuts : -1]
        texts += [" ".join(w for p in q for w in p) for q in (parts, moved)]
    like = [jaccard(texts[2 * f], texts[2 * f + 1]) for f in range(40)]
    assert min(like) > 0.78 and max(like) < 0.82 and 10 < sum(j >= 0.8 for j in like) < 30
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    kept = {r.doc_id - 100 for r in simhash.drop_near(docs).collect()}
    assert kept == {2 * f for f in range(40)} | {2 * f + 1 for f in range(40) if like[f] < 0.8}
