"""Prefix tries against a plain loop over all prefixes."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tunelens.llm import prefixtrie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0], t[1] or 0, hashlib.sha256(
            f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    built = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 9
        turns = own.get(conv - conv % 5, [])[:h] + own[conv][h:]
        built[conv] = tuple(t[2:] for t in turns)
    members = defaultdict(list)
    for conv in sorted(built):
        for d in range(len(built[conv]) + 1):
            members[built[conv][:d]].append(conv)
    children = defaultdict(set)
    for path in members:
        if path:
            children[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        gain = (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += gain
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.append((convs[0], len(path), parent, len(convs), len(children[path]), leaves[path], saved[path],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows():
    rows = []
    for c in [0, 1, 2, 3, 4, 5, 6, 8, 9, 12, 13, 14, 30, 33, 34, 70001, 70002, 140000, 140003]:
        for t in range(c * 7 % 13):
            text = [None, "", "hi", "é日本", "x" * (t + 1)][(t * 3 + (c > 8)) % 5]
            rows.append((c, None if t == 1 else t, [None, "user", "assistant"][t % 3], text))
    rows += [(20, t, "user", "the same") for t in range(12)] * 2  # repeated rows
    rows += [(21 + i, t, "user", "the same") for i in range(4) for t in range(12)]
    rows += [(40, t, "user", f"turn {t}") for t in range(600)]  # a long conversation, and one that borrows from it
    rows += [(41, t, "user", f"turn {t}") for t in range(600)]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None), (-3, 1, "user", "below zero")]
    rows += [(50, 5, "a", "b"), (50, 5, "ab", ""), (50, 5, "", "ab"), (55, 5, "ab", "")]
    return rows


@pytest.fixture(scope="module")
def odd_turns(spark):
    wide = [(*r, 7, "k") for r in odd_rows()]
    return spark.createDataFrame(
        wide, "conv_id bigint, turn bigint, role string, text string, depth int, key string").repartition(5)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("shard,turns", [(4096, 200_000), (3, 200_000), (4096, 10), (1, 1)])
def test_against_plain_loop(monkeypatch, odd_turns, shard, turns):
    """Whole result, also where every node of the trie lies in many shards."""
    monkeypatch.setattr(prefixtrie, "SHARD", shard)
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", turns)
    monkeypatch.setattr(prefixtrie, "RUN_BITS", 2 if shard < 10 else 16)
    assert rows_of(prefixtrie.prefix_trie(odd_turns)) == plain_trie(odd_rows())


def test_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    want = plain_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert rows_of(prefixtrie.prefix_trie(table)) == want


def test_bitsets():
    convs = [(7, [(b"a", 1), (b"b", 2)]), (3, [(b"a", 1)]), (9, []), (5, [(b"a", 1), (b"b", 2), (b"c", 3)])]
    trie = prefixtrie.Trie(convs)
    assert trie.n == [4, 3, 2, 1] and trie.least == [3, 3, 5, 5] and trie.parent == [-1, 0, 1, 2]
    assert trie.ends == [[9], [3], [7], [5]] and trie.bytes == [0, 1, 2, 3]


def test_no_conversations(odd_turns):
    assert prefixtrie.prefix_trie(odd_turns.where("false")).count() == 0
    assert prefixtrie.prefix_trie(odd_turns.where("conv_id IS NULL")).count() == 0
