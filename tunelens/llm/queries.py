"""The registered queries of the numbered operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunelens.llm import (
    bestfit, embedding, exact, idfile, langid, mixing, packing, prefixtrie, ranked, simhash, substring, tokencount,
    toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.section_counts(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(_table(spark, sf_dir, "documents")).drop("token_ids")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.parse(_table(spark, sf_dir, "documents")).drop("first_words", "end_words", "sources")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False).drop("token_ids")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("key")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bestfit.pack(_table(spark, sf_dir, "documents"), keep_ids=False)
    return packed.selectExpr("doc_id", "CAST(piece AS INT) AS piece", "start", "length", "ids_crc32", "sequence_id", "offset")


_QUERIES = (
    op1_toxicity, op2_token_counts, op3_language_id, op4_token_ids, op5_simhash, op6_embedding_dedup,
    op7_substring_dedup, op8_exact_dedup, op9_mixing, op10_packing, op11_prefix_trie, op12_ranked_search, op13_best_fit)


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    return {
        "op8_exact_dedup": exact.ORACLE,
        "op9_mixing": mixing.ORACLE,
        "op11_prefix_trie": prefixtrie.ORACLE,
        "op12_ranked_search": ranked.ORACLE,
    }
