"""From labelled short texts to a learner's rows, as a run describes it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tunelens.operators import bow
from tunelens.operators import features as feats
from tunelens.streaming.vocabulary import Vocabulary


class TweetExtractor:
    """Features of texts as a head file lists them.

    ``head`` are the rows of a head file that was read: its attributes are the features, in its order, the last one is the
    class, and its statistics scale them. ``normalize`` is the mode of :func:`features.normalize_features`,
    ``preprocess`` cleans texts before words are counted, ``adaptive`` adds the feature ``bow``, whose list of words is
    state of the run. Rows without a class are left out; a class other than ``normal`` is label 1.
    """

    def __init__(
        self, head: list[Row], lexicon: DataFrame, normal: str = "normal", normalize: int = 0, preprocess: bool = False,
        adaptive: bool = False, ratio: float = 2.0, min_docs: int = 10,
    ):
        self.head, self.lexicon, self.normal = head[:-1], lexicon, normal
        self.normalize, self.preprocess = normalize, preprocess
        self.features = [r["name"] for r in self.head]
        self.vocabulary = Vocabulary(normal, ratio, min_docs) if adaptive else None
        made = {n for group in feats.FEATURE_GROUPS.values() for n in group} | ({"bow"} if adaptive else set())
        if unknown := [n for n in self.features if n not in made]:
            raise ValueError(f"no such features: {unknown}")

    def raw(self, texts: DataFrame) -> DataFrame:
        """id, the features as counted, and the label."""
        rows = feats.text_features(texts.where("class IS NOT NULL"), self.preprocess)
        rows = feats.lexicon_features(feats.user_features(rows), self.lexicon)
        if self.vocabulary:
            rows = self.vocabulary.mark(rows)
        return rows.select("id", *[F.col(n).cast("double").alias(n) for n in self.features], self._label())

    def chunk_rows(self, texts: DataFrame, chunk: str, row: str) -> DataFrame:
        """:meth:`rows` of many chunks, with the chunk and the place of each row. An id belongs to its chunk."""
        known = texts.where("class IS NOT NULL").withColumn("_key", F.when(F.col("id").isNotNull(), F.struct(chunk, "id")))
        rows = feats.text_features(known, self.preprocess)
        rows = feats.lexicon_features(feats.user_features(rows), self.lexicon, "_key")
        if self.vocabulary:
            rows = bow.with_hits(rows, self.vocabulary.chunk_hits(known, chunk, "_key"), "_key")
        rows = rows.select(chunk, row, "id", *[F.col(n).cast("double").alias(n) for n in self.features], self._label())
        return feats.normalize_features(rows, self.head, self.normalize)

    def _label(self):
        return (feats.to_binary(F.col("class"), self.normal) != self.normal).cast("int").alias("label")

    def rows(self, texts: DataFrame) -> DataFrame:
        return feats.normalize_features(self.raw(texts), self.head, self.normalize)


class TextLearner:
    """A learner behind an extractor: texts come in, and the words of a batch are learnt after it was judged."""

    def __init__(self, extractor: TweetExtractor, learner: Any):
        self.extractor, self.learner = extractor, learner
        self.row_schema = learner.row_schema
        self.home: str | None = None

    def state(self) -> dict:
        words = self.extractor.vocabulary
        return {"learner": self.learner.state(), "words": words.state() if words else None}

    def load(self, state: dict) -> None:
        self.learner.load(state["learner"])
        if state["words"]:
            self.extractor.vocabulary.load(state["words"])

    def step(self, batch: DataFrame) -> list[tuple]:
        self._settle()
        return self._with_words(batch, self.learner.step(self.extractor.rows(batch)))

    def walk(self, rows: DataFrame, chunk: str, row: str) -> list[tuple]:
        """The steps of many batches: their features are taken together, each by the words before it."""
        self._settle()
        return self._with_words(rows, self.learner.walk(self.extractor.chunk_rows(rows, chunk, row), chunk, row))

    def _settle(self) -> None:
        for part in (self.learner, self.extractor.vocabulary):
            if getattr(part, "home", "") is None:
                part.home = self.home

    def _with_words(self, texts: DataFrame, seen: list[tuple]) -> list[tuple]:
        if self.extractor.vocabulary:
            self.extractor.vocabulary.learn(texts)
        return seen

    def report(self, rows: DataFrame, **options: Any) -> DataFrame:
        return self.learner.report(rows, **options)
