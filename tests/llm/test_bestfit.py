"""Best-fit packing against a plain loop over all open bins."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tunelens.llm import bestfit

PLAIN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_loop(sizes, window, limit):
    """Bins as [free, turn of its last change, number]; the smallest that fits, the latest of equals."""
    open_bins, out, made = [], [], 0
    for turn, size in enumerate(sizes):
        fitting = [b for b in open_bins if b[0] >= size]
        if fitting:
            best = min(fitting, key=lambda b: (b[0], -b[1]))
        else:
            if size < window and len(open_bins) == limit:
                open_bins.remove(min(open_bins, key=lambda b: (b[0], -b[1])))
            best = [window, turn, made]
            made += 1
            open_bins.append(best)
        out.append((best[2], window - best[0]))
        best[0], best[1] = best[0] - size, turn
        if not best[0]:
            open_bins.remove(best)
    return out


@settings(max_examples=300, deadline=None)
@given(sizes=st.lists(st.integers(1, 20), max_size=120), limit=st.integers(1, 6))
def test_places(sizes, limit):
    bins = bestfit.OpenBins(20, limit, 0)
    got = []
    for size in sizes:
        got.append(bins.place(size))
        assert bins.n_open <= limit and bins.n_open == sum(map(len, bins.bins))
        assert bins.free == sum(1 << f for f, held in enumerate(bins.bins) if held)
    assert got == plain_loop(sizes, 20, limit)


@pytest.mark.parametrize("window,limit", [(2048, 4096), (64, 3), (1, 1)])
def test_pack(odd_docs, window, limit):
    docs = [(r.doc_id, PLAIN.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in odd_docs.collect()]
    pieces = bestfit.pack(odd_docs, window=window, open_bins=limit).collect()
    want = sorted(
        (repr(doc), k, s, np.array(ids[s : s + window], "<u4").tobytes())
        for doc, ids in docs for k, s in enumerate(range(0, len(ids), window)))
    assert sorted((repr(p.doc_id), p.piece, p.start, bytes(p.token_ids)) for p in pieces) == want
    by_sequence = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(p.token_ids) == p.ids_crc32 and len(p.token_ids) == 4 * p.length
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for held in by_sequence.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0] + [n for _, n in held])[:-1].tolist()
        assert sum(n for _, n in held) <= window


def test_few_sequences(spark):
    """All given documents: hardly more sequences than their tokens need."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = bestfit.pack(docs, keep_ids=False).toPandas()
    least = -(-int(pieces["length"].sum()) // 2048)
    assert pieces["sequence_id"].nunique() <= 1.02 * least + 1


def test_no_docs(no_docs):
    assert bestfit.pack(no_docs).count() == 0


def test_bad_options(odd_docs):
    with pytest.raises(ValueError):
        bestfit.OpenBins(8, 0, 0)
    with pytest.raises(ValueError):
        bestfit.pack(odd_docs, window=0)
