"""Ranked lexical search: the highest-scoring documents of every query, by norm buckets.

A document becomes a vector with one integer impact per query term it holds, so that a query's score is the sum of the
impacts of its terms: the product of the vector with a vector of ones. The vectors are ordered by length and searched
from the longest down, in buckets of ``BUCKET`` neighbours:

1. a bucket whose longest vector times the query's length stays below the query's k-th best score is skipped whole
   (Cauchy-Schwarz);
2. inside a bucket, the sums over the query's heaviest terms are exact; the rest of a vector is bounded by its remaining
   length and by the largest impacts of the bucket on the other coordinates; vectors below the k-th best score go;
3. what survives is scored exactly in 64-bit integers.

The longest vectors of all are searched first. The k-th best scores found there start the search of the others, which
runs in parallel; vectors too short for any query are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunelens.llm.tables import written

K = 10
#: Queries searched together; their terms are what a task holds.
QUERY_BLOCK = 2048
BUCKET = 1024
#: Terms of a query, heaviest first, whose sums are exact before survivors are chosen.
FOCUS = 8
#: The share of longest vectors that sets the first k-th best scores.
FIRST_SHARE = 0.02
#: Room for rounding in bounds computed in doubles.
SLACK = 1 + 1e-9
#: Text, and rows, that a task holds as words at a time.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 512

# Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z is lower-cased.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

POSTINGS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
IMPACTS = "doc_id bigint, norm double, terms array<int>, impacts array<bigint>"
FOUND = "item int, item_id bigint, doc_id bigint, score bigint"


def words(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_LETTERS).split()


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of each item (item_id, text), scores above 0.

    Equal scores rank by doc_id, null ids last. Every row of ``docs`` is a document of its own, also if it repeats
    another; rows of ``items`` that are equal count once, rows of one item_id with other texts are ranked each on their
    own. A null or empty text has no terms. Empty tables give no rows; columns other than these are not read.

    Queries are taken in blocks of about ``QUERY_BLOCK``, each block against all documents.
    """
    asked = items.select("item_id", "text").distinct()
    blocks = -(-asked.count() // QUERY_BLOCK)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    results = []
    for b in range(blocks):
        rows = asked.where(part == b).collect()  # about QUERY_BLOCK rows
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text or ""))
        if (found := _search_block(docs, [(r.item_id, words(r.text)) for r in rows], k)) is not None:
            results.append(found)
    if not results:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _search_block(docs: DataFrame, asked: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame | None:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in asked for t in ts}))}
    held = written(postings(docs, vocabulary), "postings")
    n_docs, n_words = held.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not vocabulary:
        return None
    df = dict(held.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # at most one row a term
    weights = np.zeros(len(vocabulary), np.int64)
    for term, n in df.items():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    vectors = impact_vectors(held, weights, n_docs, n_words)
    # Ordered by length; equal lengths, as copies have them, are dealt by doc_id.
    vectors = written(
        vectors.repartitionByRange(F.desc("norm"), "doc_id").sortWithinPartitions(F.desc("norm"), "doc_id"), "vectors")

    queries = [
        (number, item_id, np.array(sorted({vocabulary[t] for t in ts}, key=lambda c: (-weights[c], c)), np.int64))
        for number, (item_id, ts) in enumerate(asked)
    ]
    queries = [q for q in queries if len(q[2])]
    cut = vectors.agg(F.percentile_approx("norm", 1 - FIRST_SHARE)).first()[0]
    if cut is None:
        return None
    none = np.zeros(len(asked), np.int64)
    first = written(_best(vectors.where(F.col("norm") >= cut), queries, none, k), "found")
    kth = none.copy()
    ranked = _ranked(first, k).where(F.col("rank") == k)
    for number, score in ranked.select("item", "score").collect():  # at most one row a query
        kth[number] = score
    # No query can take a vector shorter than its k-th best score over its own length.
    least = min(kth[number] / math.sqrt(len(terms)) for number, _, terms in queries) / SLACK
    rest = vectors.where((F.col("norm") < cut) & (F.col("norm") >= float(least)))
    found = first.unionByName(_best(rest, queries, kth, k))
    return _ranked(found, k).select("item_id", "rank", "doc_id", "score")


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): number of words of each text, and its terms of the vocabulary with their occurrences."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(len(vocabulary), 1)
        for ids, texts in _slices(rows):
            split = [words(t) for t in texts]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            codes = np.fromiter((vocabulary.get(w, -1) for ws in split for w in ws), np.int64, int(counts.sum()))
            keys = (np.repeat(np.arange(len(split)), counts) * size + codes)[codes >= 0]
            pairs, tfs = np.unique(keys, return_counts=True)
            ends = np.searchsorted(pairs // size, np.arange(len(split) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts), _lists(ends, pairs % size, pa.int32()), _lists(ends, tfs, pa.int64())],
                ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, POSTINGS)


def _slices(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    for batch in rows:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        start = held = 0
        for i, t in enumerate(texts):
            held += len(t or b"")
            if held >= BATCH_BYTES or i + 1 - start >= BATCH_ROWS or i + 1 == len(texts):
                yield batch.column("doc_id").slice(start, i + 1 - start), texts[start : i + 1]
                start, held = i + 1, 0


def _lists(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(kind.to_pandas_dtype())))


def impact_vectors(held: DataFrame, weights: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """(doc_id, norm, terms, impacts) of the rows of :func:`postings` that hold a term of some weight."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n = batch.column("n").to_numpy()
            terms, ends = _flat(batch.column("terms"))
            tfs, _ = _flat(batch.column("tfs"))
            owner = np.repeat(np.arange(len(n)), np.diff(ends))
            m = 10 + (90 * n * n_docs) // n_words
            impacts = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[owner]))
            kept = impacts > 0
            squares = np.bincount(owner[kept], impacts[kept].astype(float) ** 2, len(n))
            some = np.flatnonzero(squares > 0)
            ends = np.append(0, np.cumsum(np.bincount(owner[kept], minlength=len(n))[some])).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(some)), pa.array(np.sqrt(squares[some])),
                 _lists(ends, terms[kept], pa.int32()), _lists(ends, impacts[kept], pa.int64())],
                ["doc_id", "norm", "terms", "impacts"])

    return held.where("size(terms) > 0").mapInArrow(run, IMPACTS)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists in a row, and where each list starts, with the end of the last."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


class Bucket:
    """Vectors of about equal length, by row and by term. ``ends`` has one entry more than there are rows."""

    def __init__(self, terms: np.ndarray, impacts: np.ndarray, ends: np.ndarray, norms: np.ndarray, n_terms: int):
        self.terms, self.impacts, self.ends, self.norms = terms, impacts, ends, norms
        self.longest = float(norms.max())
        rows = np.repeat(np.arange(len(norms)), np.diff(ends))
        order = np.argsort(terms, kind="stable")
        self.rows, self.column = rows[order], impacts[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, np.int64)  # largest impact of each term in the bucket
        np.maximum.at(self.most, terms, impacts)

    def survivors(self, query: np.ndarray, kth: int) -> np.ndarray:
        """Rows whose score may reach ``kth``, by exact sums over the first terms and bounds for the others."""
        sums, squares = np.zeros(len(self.norms)), np.zeros(len(self.norms))
        for t in query[:FOCUS]:
            at = slice(self.first[t], self.first[t + 1])
            sums[self.rows[at]] += self.column[at]
            squares[self.rows[at]] += self.column[at].astype(float) ** 2
        others = query[FOCUS:]
        if len(others):
            room = math.sqrt(len(others)) * np.sqrt(np.maximum(self.norms**2 * SLACK - squares, 0.0))
            sums += np.minimum(room, float(self.most[others].sum()))
        return np.flatnonzero((sums * SLACK >= kth) & (sums > 0))

    def scores(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of ``rows``."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        stops = np.cumsum(sizes)
        at = np.arange(stops[-1]) + np.repeat(self.ends[rows] - (stops - sizes), sizes)
        asked = np.zeros(len(self.most), bool)
        asked[query] = True
        total = np.append(0, np.cumsum(np.where(asked[self.terms[at]], self.impacts[at], 0)))
        return total[stops] - total[stops - sizes]


class Best:
    """The k best (score, doc_id) of one query so far."""

    def __init__(self, k: int, kth: int):
        self.k, self.kth = k, kth
        self.scores, self.docs, self.nameless = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, docs: np.ndarray, nameless: np.ndarray) -> None:
        scores = np.append(self.scores, scores)
        docs, nameless = np.append(self.docs, docs), np.append(self.nameless, nameless)
        order = np.lexsort((docs, nameless, -scores))[: self.k]
        self.scores, self.docs, self.nameless = scores[order], docs[order], nameless[order]
        if len(order) == self.k:
            self.kth = max(self.kth, int(self.scores[-1]))


def _best(vectors: DataFrame, queries: list, kth: np.ndarray, k: int) -> DataFrame:
    """Each task's k best of every query among its vectors, which reach the query's ``kth``."""
    n_terms = 1 + max(int(t.max()) for _, _, t in queries)
    lengths = np.sqrt([len(t) for _, _, t in queries])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, int(kth[number])) for number, _, _ in queries]
        for batch in rows:
            norms = batch.column("norm").to_numpy()
            terms, ends = _flat(batch.column("terms"))
            impacts, _ = _flat(batch.column("impacts"))
            nameless = np.array(batch.column("doc_id").is_null())
            docs = batch.column("doc_id").fill_null(0).to_numpy()
            for lo in range(0, len(norms), BUCKET):
                own = slice(lo, min(lo + BUCKET, len(norms)))
                at = slice(ends[own.start], ends[own.stop])
                inside = ends[own.start : own.stop + 1] - ends[own.start]
                bucket = Bucket(terms[at], impacts[at], inside, norms[own], n_terms)
                reach = lengths * bucket.longest * SLACK
                for q in np.flatnonzero(reach >= [b.kth for b in best]).tolist():
                    query = queries[q][2]
                    rows_left = bucket.survivors(query, best[q].kth)
                    if not len(rows_left):
                        continue
                    scores = bucket.scores(query, rows_left)
                    good = scores >= max(best[q].kth, 1)
                    if good.any():
                        chosen = lo + rows_left[good]
                        best[q].add(scores[good], docs[chosen], nameless[chosen])
        for (number, item_id, _), b in zip(queries, best):
            if n := len(b.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * n, pa.int32()), pa.array([item_id] * n, pa.int64()),
                     pa.array(b.docs, pa.int64(), mask=b.nameless), pa.array(b.scores, pa.int64())],
                    ["item", "item_id", "doc_id", "score"])

    return vectors.select("doc_id", "norm", "terms", "impacts").mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every item, ranked; a first round by salt keeps one item's rows of many tasks apart."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order)))
    every = some.where(F.col("rank") <= k).drop("salt")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(
        F.col("rank") <= k)


#: The same ranking for DuckDB.
ORACLE = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM held, totals GROUP BY term, docs),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
scores AS (
    SELECT item_id, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
    FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
    GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""
