"""Encoding, packing, token files and attribution against the tokenizers library and plain loops."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tunelens.llm import huffman, idfile, packing, tokencount
from tunelens.llm.encoding import Encoder

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PLAIN = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}
BY_CHUNK = {n: Encoder(n) for n in NAMES}
BY_CHUNK_SPANS = {n: Encoder(n, spans=True) for n in NAMES}
PIECES = st.sampled_from(
    ["a", "B", " ", "  ", "\n", "\t", "\r\n", "word", "é", "é", "́", "\xa0", chr(0x2003), chr(0x85), "\x1c", "1", "23",
     "!", "|", " | ", "'s", "<|endoftext|>", "Σ", "ς", "日本", "_", "\x00", "\x0b", "\x0c", "İ"])


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=4))
def test_chunks_give_the_ids_of_the_whole_text(name, texts):
    ids, ends, _, _ = BY_CHUNK[name].encode(texts)
    got = [p.tolist() for p in np.split(ids, ends[:-1])]
    assert got == [PLAIN[name].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=200, deadline=None)
@given(text=st.lists(PIECES.filter(lambda p: p not in ("é", "́", "İ", "Σ")), max_size=12).map("".join))
def test_chunks_give_the_spans_of_the_whole_text(name, text):
    ids, _, first, last = BY_CHUNK_SPANS[name].encode([text])
    whole = PLAIN[name].encode(text, add_special_tokens=False)
    assert ids.tolist() == whole.ids
    assert list(zip(first.tolist(), last.tolist())) == whole.offsets


@given(counts=st.lists(st.integers(0, 10**9), min_size=1, max_size=300), limit=st.integers(9, 16))
@settings(max_examples=100, deadline=None)
def test_lengths_form_a_code(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = lengths[lengths > 0].astype(float)
    assert (np.array(counts) > 0).tolist() == (lengths > 0).tolist() and lengths.max(initial=0) <= limit
    assert len(used) < 2 or sum(2.0 ** -used) == 1


def test_lengths_are_best():
    """Against unlimited Huffman coding where the limit does not bind."""
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap = [(int(c), i, 0) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    total, n = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], n, 0))
        n += 1
    assert int((huffman.code_lengths(counts, 16) * counts).sum()) == total


@given(st.lists(st.lists(st.integers(0, 40), max_size=400), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_blocks_decode(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    counts = np.bincount(np.concatenate(blocks).astype(int), minlength=41)
    lengths = huffman.code_lengths(counts)
    codes, table = huffman.canonical_codes(lengths), huffman.decode_table(lengths)
    pairs = [huffman.encode_block(b, codes, lengths) for b in blocks]
    got = huffman.decode_blocks([p[0] for p in pairs], [p[1] for p in pairs], [len(b) for b in blocks], table)
    assert [g.tolist() for g in got] == [b.tolist() for b in blocks]


def plain_ids(name, text, end):
    return PLAIN[name].encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_round_trip(odd_docs):
    got = idfile.round_trip(odd_docs, keep_ids=True).collect()
    rows = [(r.doc_id, plain_ids(NAMES[0], r.text, 0)) for r in odd_docs.collect()]
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((repr(d), len(i), crc(i)) for d, i in rows)
    at = 0
    got.sort(key=lambda r: r.start)
    for r in got:
        assert r.start == at and zlib.crc32(r.token_ids) == r.ids_crc32
        at += r.n_tokens
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known) and got[0].doc_id is None


def check_pieces(pieces, docs, window, end=1):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    want = sorted(i for _, ids in docs for i in ids)
    assert sorted(i for p in pieces for i in np.frombuffer(p.token_ids, "<u4").tolist()) == want
    for doc, ids in docs:
        own = sorted((p for p in by_doc[doc]), key=lambda p: p.start)
        if len({x for x, _ in docs if x == doc}) == sum(x == doc for x, _ in docs):
            assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
            assert b"".join(p.token_ids for p in own) == np.array(ids, "<u4").tobytes()
            assert {p.doc_tokens for p in own} == {len(ids)}
            assert all(p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for p in own)
    fills = []
    for held in by_sequence.values():
        held.sort(key=lambda p: p.offset)
        assert [p.offset for p in held] == np.cumsum([0] + [p.length for p in held])[:-1].tolist()
        fills.append(sum(p.length for p in held))
    assert max(fills) <= window
    return fills


@pytest.mark.parametrize("window", [2048, 64, 1])
def test_pack(odd_docs, window):
    pieces = packing.pack(odd_docs, window=window).collect()
    docs = [(r.doc_id, plain_ids(NAMES[1], r.text, 1)) for r in odd_docs.collect()]
    fills = check_pieces(pieces, docs, window)
    assert all(f & (f - 1) == 0 for f in fills)


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 8)
    packer, windows = packing.SumOfSquares(64, 0), []
    sizes = np.random.default_rng(3).integers(33, 64, 500).tolist()  # no two fit together
    for i, n in enumerate(sizes):
        windows += packer.place(packing.Piece(i, 0, np.full(n, i, "<u4"), n))
        assert packer.n_open < 8 and packer.levels.sum() == packer.n_open
    windows += packer.pour(True)
    assert sum(len(p.ids) for w in windows for p in w) == sum(sizes)
    assert sum(sum(len(p.ids) for p in w) != 64 for w in windows) <= 6


def test_level_minimises_squares():
    rng = np.random.default_rng(5)
    packer = packing.SumOfSquares(32, 0)
    for _ in range(300):
        packer.levels[1:32] = rng.integers(0, 4, 31)
        size = int(rng.integers(1, 32))
        cost = {}
        for h in range(0, 33 - size):
            if h and not packer.levels[h]:
                continue
            after = packer.levels.copy()
            after[h] -= h > 0
            after[h + size] += 1
            cost[h] = int((after[1:32] ** 2).sum())
        assert cost[packer.level(size)] == min(cost.values())


@pytest.mark.parametrize("rule", tokencount.RULES)
@pytest.mark.parametrize("sections", [tokencount.LINES, r"[\s\S]{1,7}"])
def test_sections(odd_docs, rule, sections):
    got = sorted((tuple(r) for r in tokencount.section_counts(odd_docs, rule=rule, sections=sections).collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        text = r.text or ""
        spans = [m.span() for m in re.finditer(sections, text)] or [(0, 0)]
        counts, crossing = [0] * len(spans), [0] * len(spans)
        owner = [i for i, (s, e) in enumerate(spans) for _ in range(s, e)]
        for a, b in PLAIN[NAMES[0]].encode(text, add_special_tokens=False).offsets:
            met = owner[a:b]
            i = {"start": met[0], "end": met[-1], "most": max(met, key=lambda j: (met.count(j), -j))}[rule]
            counts[i] += 1
            crossing[i] += len(set(met)) > 1
        want += [(r.doc_id, i, s, e, counts[i], crossing[i]) for i, (s, e) in enumerate(spans)]
    assert got == sorted(want, key=repr)


def test_fields(spark):
    rows = [(1, "a title", "body\nof text"), (2, None, "x"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, title string, body string")
    got = sorted(tuple(r)[:5] for r in tokencount.field_counts(docs, ["title", "body"]).collect())
    assert [g[:4] for g in got] == [(1, 0, 0, 8), (1, 1, 8, 20), (2, 0, 0, 1), (2, 1, 1, 2), (3, 0, 0, 1), (3, 1, 1, 1)]
    for doc, title, body in rows:
        whole = PLAIN[NAMES[0]].encode("\n".join([title or "", body or ""]), add_special_tokens=False).ids
        assert sum(g[4] for g in got if g[0] == doc) == len(whole)


def test_empty_tables(no_docs):
    assert idfile.round_trip(no_docs).count() == 0
    assert packing.pack(no_docs).count() == 0
    assert tokencount.section_counts(no_docs).count() == 0
