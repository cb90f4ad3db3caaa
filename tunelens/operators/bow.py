"""A bag of words that grows and shrinks with the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.functions.text import tokens
from tunelens.operators.ordering import bounded


def token_counts(docs: DataFrame, normal: str, batch: str = "chunk_id", text: str = "text", label: str = "class"):
    """(batch, token, normal_docs, other_docs): documents holding each token."""
    held = docs.select(
        batch, (F.col(label) == normal).alias("is_normal"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")
    )
    return held.groupBy(batch, "token").agg(
        F.count_if("is_normal").alias("normal_docs"), F.count_if(~F.col("is_normal")).alias("other_docs")
    )


def doc_counts(docs: DataFrame, normal: str, batch: str = "chunk_id", label: str = "class") -> DataFrame:
    """(batch, normal_total, other_total) with running totals: one row per batch."""
    per_batch = docs.groupBy(batch).agg(
        F.count_if(F.col(label) == normal).alias("n"), F.count_if(F.col(label) != normal).alias("o")
    )
    so_far = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)  # one row per batch
    return per_batch.select(
        batch, F.sum("n").over(so_far).alias("normal_total"), F.sum("o").over(so_far).alias("other_total")
    )


def adaptive_vocabulary(
    docs: DataFrame, normal: str, ratio: float = 2.0, min_docs: int = 10, batch: str = "chunk_id"
) -> DataFrame:
    """(batch, token) pairs of the list in force while ``batch`` is scored: learnt from all earlier batches.

    A token is listed while at least ``min_docs`` documents held it and its document rate in the other classes
    exceeds ``ratio`` times its rate in the normal class. Running counts are per token, over at most one row per
    batch.
    """
    totals = bounded(doc_counts(docs, normal, batch))
    last = totals.agg(F.max(batch)).scalar()
    counts = token_counts(docs, normal, batch)
    along = Window.partitionBy("token").orderBy(batch)
    running = along.rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.select(
        "token",
        F.col(batch).alias("since"),
        F.sum("normal_docs").over(running).alias("normal_docs"),
        F.sum("other_docs").over(running).alias("other_docs"),
        (F.coalesce(F.lead(batch).over(along), last + 1) - 1).alias("until"),
    )
    # The counts of a token hold from one of its batches to the next; the class totals move in every batch.
    dense = steps.where(F.col("normal_docs") + F.col("other_docs") >= min_docs).select(
        "token", "normal_docs", "other_docs", F.explode(F.sequence("since", "until")).alias(batch)
    )
    return dense.join(totals, batch).where(stands_out(ratio, min_docs)).select((F.col(batch) + 1).alias(batch), "token")


def listed_where_met(
    docs: DataFrame, normal: str, ratio: float = 2.0, min_docs: int = 10, batch: str = "chunk_id"
) -> DataFrame:
    """The part of :func:`adaptive_vocabulary` that documents can meet: pairs whose token occurs in the batch.

    A token's counts before a batch are the running sums over its earlier batches, so no row is made for a batch that
    does not hold the token.
    """
    earlier = Window.partitionBy("token").orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    before = token_counts(docs, normal, batch).select(
        batch, "token", F.sum("normal_docs").over(earlier).alias("normal_docs"),
        F.sum("other_docs").over(earlier).alias("other_docs"))
    totals = bounded(doc_counts(docs, normal, batch).withColumn(batch, F.col(batch) + 1))
    return before.join(totals, batch).where(stands_out(ratio, min_docs)).select(batch, "token")


def listed_after(
    docs: DataFrame, normal: str, counts: DataFrame, totals: DataFrame, ratio: float = 2.0, min_docs: int = 10,
    batch: str = "chunk_id", label: str = "class",
) -> DataFrame:
    """:func:`listed_where_met` for batches that come after others: ``counts`` are those of the tokens seen before ``docs``,
    ``totals`` the documents by class before each batch."""
    earlier = Window.partitionBy("token").orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    own = token_counts(docs, normal, batch, label=label).select(
        batch, "token", F.sum("normal_docs").over(earlier).alias("n"), F.sum("other_docs").over(earlier).alias("o"))
    sums = {c: F.coalesce(k, F.lit(0)) + F.coalesce(c, F.lit(0)) for c, k in (("normal_docs", "n"), ("other_docs", "o"))}
    rows = own.join(counts, "token", "left").withColumns(sums)
    return rows.join(F.broadcast(totals), batch).where(stands_out(ratio, min_docs)).select(batch, "token")


def stands_out(ratio: float, min_docs: int) -> Column:
    """Whether counts of a token put it on the list; products instead of quotients: rate_other > ratio * rate_normal."""
    seen = F.col("normal_docs") + F.col("other_docs") >= min_docs
    return seen & (F.col("other_docs") * F.col("normal_total") > F.lit(ratio) * F.col("normal_docs") * F.col("other_total"))


def bow_counts(docs: DataFrame, listed: DataFrame, on: list[str], key: str = "id") -> DataFrame:
    """``docs`` with ``bow``: how many of its tokens are ``listed``."""
    return with_hits(docs, bow_hits(docs, listed, on, key), key)


def bow_hits(docs: DataFrame, listed: DataFrame, on: list[str], key: str = "id") -> DataFrame:
    """(key, bow) of the documents that hold ``listed`` tokens."""
    # Counting tokens inside each document first leaves one row per (document, token) to join.
    held = docs.select(*on[:-1], key, F.explode(tokens(F.col("text"))).alias("token")).groupBy(*on[:-1], key, "token").agg(
        F.count("*").alias("n")
    )
    return held.join(listed, on).groupBy(key).agg(F.sum("n").alias("bow"))


def with_hits(docs: DataFrame, hits: DataFrame, key: str = "id") -> DataFrame:
    return docs.join(hits, key, "left").withColumn("bow", F.coalesce("bow", F.lit(0)))


def adaptive_bow(
    docs: DataFrame, normal: str, ratio: float = 2.0, min_docs: int = 10, batch: str = "chunk_id", key: str = "id"
) -> DataFrame:
    """``docs`` with ``bow``: how many of its tokens are on the list in force. A word meets the list batch by batch, so
    it gathers the documents of one batch at the most."""
    return bow_counts(docs, listed_where_met(docs, normal, ratio, min_docs, batch), [batch, "token"], key)
