"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every row the model may learn from. The weights are trained with follow-the-regularised-
leader and elastic-net penalties on a bounded sample, and a temperature fitted on a part of the sample that the weights
never saw calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.llm.tables import learning_row

DIMENSIONS = 1 << 15
GRAMS = (1, 2, 3)
#: Documents the weights are trained on, dealt evenly to the languages; a bound of the fitting sample only.
SAMPLE = 4_000
EPOCHS = 3
#: Part of the sample kept for the temperature.
CALIBRATION = 0.2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-4
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets, counts) of the lower-cased letters; everything between two runs of letters is one space."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(letter, codes, 32)
    codes = codes[letter | np.append(True, letter[:-1])]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    found = []
    for n in GRAMS:
        h = np.full(max(0, len(codes) - n + 1), n, np.uint32)
        for i in range(n):
            h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        found.append(h & np.uint32(DIMENSIONS - 1))
    counts = np.bincount(np.concatenate(found), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = features(text)
    x = np.log1p(counts) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, x = vector(text, self.idf)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, x) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader: per-coordinate sums of gradients ``z`` and of their squares ``n``; weights are
    zero until a sum outgrows the L1 penalty."""

    def __init__(self, dimensions: int, classes: int):
        self.z = np.zeros((dimensions + 1, classes))  # the last row is the bias, free of penalties
        self.n = np.zeros((dimensions + 1, classes))
        self.free = dimensions

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        bias = (at == self.free)[:, None]
        l1, l2 = np.where(bias, 0.0, L1), np.where(bias, 0.0, L2)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, self.free), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(labels)), labels]).mean())

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _learning(docs: DataFrame) -> DataFrame:
    return docs.where(learning_row(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull())


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Documents per bucket, over all rows of ``docs``; the last entry is their number."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in rows:
            for t in batch.column("text"):
                at, _ = features(t.as_py())
                total[at] += 1
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in counted.collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """About ``size`` rows, as many of each language as there are up to an even share, drawn by a hash of the id."""
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"))
    languages = max(1, counts.count())
    share = F.least(F.lit(1.0), F.lit(max(1, size // languages)) / F.col("n"))
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.join(F.broadcast(counts.select("lang", share.alias("_share"))), "lang").where(draw < F.col("_share"))


def train(docs: DataFrame) -> Model:
    """The model from ``docs`` (doc_id, text, lang): only learning rows are read."""
    rows = _learning(docs.select("doc_id", "text", "lang"))
    frequencies = document_frequencies(rows)
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [vector(t.as_py(), idf) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("lang"),
                 pa.array([a.astype("<i4").tobytes() for a, _ in pairs]), pa.array([x.astype("<f4").tobytes() for _, x in pairs])],
                ["doc_id", "lang", "at", "x"])

    drawn = sample(rows).mapInArrow(run, "doc_id bigint, lang string, at binary, x binary")
    held = drawn.collect()  # SAMPLE rows or few more
    held = [r for r in sorted(held, key=lambda r: (r["doc_id"], r["lang"])) if len(r["at"])]
    languages = sorted({r["lang"] for r in held})
    data = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float),
             languages.index(r["lang"])) for r in held]
    order = np.random.default_rng(4).permutation(len(data))
    kept = int(len(data) * CALIBRATION) if len(data) >= 50 else 0
    leader = Leader(DIMENSIONS, max(1, len(languages)))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(order[kept:]).tolist():
            leader.learn(*data[i])
    w = leader.weights(np.arange(DIMENSIONS + 1))
    model = Model(languages, idf, w[:-1].astype(np.float32), w[-1], 1.0)
    if kept:
        logits = np.array([model.logits(data[i][0], data[i][1]) for i in order[:kept].tolist()])
        model.temperature = best_temperature(logits, np.array([data[i][2] for i in order[:kept].tolist()]))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (the model must not learn from it), lang_pred, score.

    A text that is null or has no letter is ``und`` with score 0. Rows that repeat a doc_id are predicted one by one; a
    null doc_id stays null and is not held out. Without any learning row everything is ``und``. Columns other than
    doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"),
                 pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(~learning_row(F.col("doc_id"), 4, 2), F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(
        run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
