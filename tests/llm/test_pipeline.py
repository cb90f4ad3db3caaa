"""The pipeline's stages one by one, each judged on its own input, and the registered queries."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tunelens.llm import exact, mixing, packing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        rows = stage(spark, kept[-1], SF)
        assert rows.columns == docs.columns
        kept.append(spark.createDataFrame(rows.collect(), docs.schema))
    original = {tuple(r) for r in docs.collect()}
    sets = [[tuple(r) for r in k.collect()] for k in kept]
    for before, after in zip(sets, sets[1:]):
        assert set(after) <= set(before) <= original and len(after) == len(set(after))
    texts = [" ".join((t[1] or "").split()) for t in sets[2]]
    assert len(texts) == len(set(texts)) and set(texts) == {" ".join((t[1] or "").split()) for t in sets[1]}
    ids = [t[0] for t in sets[4]]
    taken = mixing.selection(kept[3], corpus_pipeline.MIXTURE)
    assert sorted(ids) == sorted(r.doc_id for r in taken.collect())
    pieces = corpus_pipeline.STAGES[4][1](spark, kept[4], SF).collect()
    assert {p.doc_id for p in pieces} == set(ids)


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    rows = pieces.collect()
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert rows and max(fills.values()) <= 2048
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills.values())


def test_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in queries and corpus_pipeline.ORACLE_SQL is None
    assert {"op8_exact_dedup", "op9_mixing", "op11_prefix_trie", "op12_ranked_search"} <= set(sql)


@pytest.mark.parametrize("name", ["op8_exact_dedup", "op9_mixing"])
def test_sql(spark, name):
    from oracle import connect, difference

    assert difference(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def plain_groups(rows):
    groups = {}
    for r in rows:
        text = (r.text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "})
        while "  " in text:
            text = text.replace("  ", " ")
        groups.setdefault(text, []).append(r)
    return groups


def test_exact_odd(odd_docs, no_docs):
    rows = odd_docs.collect()
    want = []
    for own in plain_groups(rows).values():
        keep = min((r.doc_id for r in own if r.doc_id is not None), default=None)
        want += [(r.doc_id, keep, len(own), r.doc_id == keep) for r in own]
    got = [tuple(r)[:4] for r in exact.exact_groups(odd_docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = exact.drop_exact(odd_docs)
    assert kept.columns == odd_docs.columns
    assert len(kept.collect()) == len(plain_groups(rows))
    assert exact.exact_groups(no_docs).count() == 0 and exact.drop_exact(no_docs).count() == 0


def test_filter_is_only_a_filter(spark, odd_docs, monkeypatch):
    """A filter of a handful of positions lets everything through; the result is the same."""
    want = sorted((tuple(r) for r in exact.exact_groups(odd_docs).collect()), key=repr)
    monkeypatch.setattr(exact, "MIN_BITS", 8)
    monkeypatch.setattr(exact, "MAX_BITS", 8)
    assert sorted((tuple(r) for r in exact.exact_groups(odd_docs).collect()), key=repr) == want


def test_mixing_budgets(spark):
    """Shortages go to siblings before they leave the branch."""
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 5), ("d1", "en", "d", 30)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    mixture = mixing.Mixture(share=0.2, epochs=1)  # 209 of 1045 tokens, all weights alike
    got = {r.source: r.budget for r in mixing.leaf_budgets(table, mixture).collect()}
    # d1 takes its 30; d0 gets 179; de takes its 5; en gets 174; a takes its 10.
    assert got == {"a": 10, "b": 164, "c": 5, "d": 30}


def test_mixing_odd(spark, odd_docs, no_docs, monkeypatch):
    mixture = mixing.Mixture(share=0.5, epochs=3, languages={"en": 3.0})
    rows = mixing.selection(odd_docs, mixture).collect()
    leaves = {}
    for r in rows:
        leaves.setdefault((r.lang, r.source), []).append(r)
    assert {k[0] for k in leaves} <= {"en", "de", "unknown"}
    mixed = mixing.mix(odd_docs, mixture)
    assert mixed.columns == odd_docs.columns and mixed.count() == len(rows)
    broad = sorted((tuple(r) for r in rows), key=repr)
    monkeypatch.setattr(mixing, "SLICES", 4)
    assert sorted((tuple(r) for r in mixing.selection(odd_docs, mixture).collect()), key=repr) == broad
    monkeypatch.setattr(mixing, "LEAVES_BROADCAST", 0)
    assert sorted((tuple(r) for r in mixing.selection(odd_docs, mixture).collect()), key=repr) == broad
    assert mixing.selection(no_docs, mixture).count() == 0 and mixing.mix(no_docs, mixture).count() == 0


def test_packing_is_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, keep_ids=False).collect()
    fills = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    padding = sum(2048 - n for n in fills.values() if n & (n - 1))
    assert padding == 0


def test_stages_send_few_texts_to_python_together(spark):
    """A batch of 10,000 texts takes tens of MB, several times over, in an executor and its workers."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for name, set_to, want in (("near_dedup", "10000", corpus_pipeline.BATCH_ROWS), ("near_dedup", "0", corpus_pipeline.BATCH_ROWS), ("packing", "100", 100)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", set_to)
            docs = spark.createDataFrame([(i, f"text number {i} of some") for i in range(5)], "doc_id bigint, text string")
            dict(corpus_pipeline.STAGES)[name](spark, docs, "")
            assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
