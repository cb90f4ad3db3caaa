"""The growing bag of words as state of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelens.operators import bow
from tunelens.session import dropped, scratch_path

#: Batches whose counts are kept apart before they are added up into one table.
COMPACT_EVERY = 16
COUNTS = "token string, normal_docs bigint, other_docs bigint"


class Vocabulary:
    """Documents holding each token by class, for all batches so far, and the list that follows from them.

    The counts are a base table and a table per batch since; after ``COMPACT_EVERY`` batches they become the next base.
    What is kept is proportional to the tokens, whatever the number of batches. The driver holds two totals and the
    places of the tables. ``home`` is the folder they are in, by default the shared scratch folder.
    """

    def __init__(self, normal: str, ratio: float = 2.0, min_docs: int = 10, label: str = "class"):
        self.normal, self.ratio, self.min_docs, self.label = normal, ratio, min_docs, label
        self.tables: list[str] = []  # a base first, if there is one, then one table per batch
        self.totals = [0, 0]  # documents of the normal class, and of the others
        self.home: str | None = None
        self.retired: list[str] = []

    def state(self) -> dict:
        return {"tables": self.tables, "totals": self.totals}

    def load(self, state: dict) -> None:
        self.tables, self.totals = list(state["tables"]), list(state["totals"])
        self.retired = [t for t in self.retired if t not in self.tables]

    def counts(self, spark: SparkSession) -> DataFrame:
        """One row per token seen."""
        if not self.tables:
            return spark.createDataFrame([], COUNTS)
        rows = spark.read.schema(COUNTS).parquet(*self.tables)
        return rows.groupBy("token").agg(F.sum("normal_docs").alias("normal_docs"), F.sum("other_docs").alias("other_docs"))

    def listed(self, spark: SparkSession) -> DataFrame:
        """The tokens on the list: those of all earlier batches that stand out."""
        normal, other = (F.lit(t).cast("bigint") for t in self.totals)
        rows = self.counts(spark).withColumns({"normal_total": normal, "other_total": other})
        return rows.where(bow.stands_out(self.ratio, self.min_docs)).select("token")

    def mark(self, docs: DataFrame, key: str = "id") -> DataFrame:
        """``docs`` with ``bow``, by the list in force."""
        return bow.bow_counts(docs, self.listed(docs.sparkSession), ["token"], key)

    def chunk_hits(self, docs: DataFrame, chunk: str, key: str) -> DataFrame:
        """(key, bow) of documents of many chunks that hold words of the list in force before their chunk, all chunks before
        it learnt."""
        spark = docs.sparkSession
        known = docs.where(F.col(self.label).isNotNull())
        is_normal = F.col(self.label) == self.normal
        seen = known.groupBy(chunk).agg(F.count_if(is_normal), F.count_if(~is_normal)).collect()  # a row per chunk
        totals, before = list(self.totals), []
        for number, n, o in sorted(tuple(r) for r in seen):
            before.append((number, *totals))
            totals = [totals[0] + n, totals[1] + o]
        totals = spark.createDataFrame(before, f"`{chunk}` bigint, normal_total bigint, other_total bigint")
        listed = bow.listed_after(known, self.normal, self.counts(spark), totals, self.ratio, self.min_docs, chunk, self.label)
        return bow.bow_hits(docs, listed, [chunk, "token"], key)

    def learn(self, docs: DataFrame) -> None:
        """Add the counts of a batch of labelled documents."""
        spark = docs.sparkSession
        known = docs.where(F.col(self.label).isNotNull())
        one = known.withColumn("_batch", F.lit(0))
        for path in self.retired:  # what the batch before last replaced
            dropped(spark, path)
        self.retired = []
        self._write(bow.token_counts(one, self.normal, "_batch", label=self.label).drop("_batch"))
        is_normal = F.col(self.label) == self.normal
        n, o = known.agg(F.count_if(is_normal), F.count_if(~is_normal)).first()
        self.totals = [self.totals[0] + n, self.totals[1] + o]
        if len(self.tables) > COMPACT_EVERY:
            old = self.tables
            self._write(self.counts(spark))
            self.tables, self.retired = self.tables[-1:], old[:]

    def _write(self, counts: DataFrame) -> None:
        spark = counts.sparkSession
        path = scratch_path(spark, "words", self.home)
        counts.select("token", "normal_docs", "other_docs").write.parquet(path)
        self.tables = [*self.tables, path]
