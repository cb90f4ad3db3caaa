"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and is written as Parquet before the next one
reads it. The last stage returns packed pieces, all others the columns of ``docs``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tunelens.llm import exact, mixing, packing, simhash, toxicity
from tunelens.llm.tables import written

#: No document appears twice after deduplication, so each source gives one epoch at most.
MIXTURE = replace(mixing.PRODUCTION, epochs=1)
#: Rows that travel between Spark and Python together, at most. Spark's 10,000 texts of some 3 kB take 30 MB or more, several
#: times over, in the executor and in each of its workers, which keep that memory. The same groups of texts are scored
#: together with a multiple of ``toxicity.TOGETHER``.
BATCH_ROWS = 16 * toxicity.TOGETHER
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends ``BATCH_ROWS`` rows to Python together, or fewer if it was set so. It stays set: a stage's
    rows are made when the caller writes them."""
    now = int(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model, trained on the corpus and its labels, rejects."""
    small_batches(spark)
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(corpus, labels))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_exact(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return simhash.drop_near(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the budgets of the target weights."""
    return mixing.mix(docs, MIXTURE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens, with their ids."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity scores and token ids come from trained models and a tokenizer, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
