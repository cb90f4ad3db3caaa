"""Toxicity from the nearest labelled examples.

Documents are TF-IDF vectors over all words of the examples, and over beginnings of words that are far likelier in toxic
ones. Each term's idf, from the whole corpus, is multiplied by how far the term tells toxic from clean examples; no word
has a weight of zero.
The examples, a bounded sample of labelled rows, form an inverted index in blocks that know the largest weight of each
term. A query adds up these maxima to bound every block, visits the highest bounds first and stops when no other
block can hold a nearer example, so its neighbours by cosine are exact. They vote by distance; a logistic curve fitted
to leave-one-out votes makes the vote a probability. The neighbours are returned as evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.llm.tables import learning_row, written

#: Labelled rows of each class that become examples; a bound of the fitting sample only.
PER_CLASS = 3_000
#: Beginnings of words that are terms beside the words: at most so many, in so many toxic examples at least and such a share
#: of them (the words of a few near copies stay out), so many times likelier in toxic examples, and with such a chi-square
#: statistic.
TERMS, LEAST_DOCS, LEAST_SHARE, LIKELIER, CHI2 = 2_048, 5, 0.015, 30.0, 15.0
#: Relevance of a term: its log odds, after ``SMOOTH`` examples of average classes and shrunk where ``DOUBT`` exceeds their
#: squared z-score, and ``LEAST`` for every term.
SMOOTH, DOUBT, LEAST = 10.0, 9.0, 0.05
PREFIXES = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
#: Blocks visited before the others are held against the nearest examples found so far.
FIRST = 4
#: Added to a neighbour's distance, and weight of the prior in a vote.
SOFTEN, PRIOR = 0.05, 1.0
REJECT = 0.7
#: Texts scored together.
TOGETHER = 64
#: Terms that more than one in so many examples holds are common; the commonest, so many at most (the others have lists).
COMMON, MOST_COMMON = 16, 1_024
_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = "".join(chr(i) if chr(i).isalpha() else " " for i in range(128))  # what an ASCII character is to words


def word_terms(word: str) -> list[str]:
    """The word, and its beginnings with a mark."""
    return [word, *[word[:n] + "~" for n in PREFIXES if len(word) >= n]]


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return text.lower().translate(_LETTERS).split()
    return _WORDS.findall(text.lower())


class Terms:
    """Terms of texts as vectors. It holds what the terms say about words, nothing about the texts seen."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.marks = {t[:-1]: i for i, t in enumerate(terms) if t.endswith("~")}
        # The marks that each term begins with, if it is a word, and where they lie in a row of all.
        found = [self._begin(t) if not t.endswith("~") else [] for t in terms]
        self.size = np.fromiter(map(len, found), np.int64, len(found))
        self.begin = np.cumsum(self.size) - self.size
        self.row = np.fromiter(chain.from_iterable(found), np.int64, int(self.size.sum()))

    def _begin(self, word: str) -> list[int]:
        """The terms that are beginnings of the word."""
        return [self.marks[b] for n in PREFIXES if len(word) >= n and (b := word[:n]) in self.marks]

    def counts(self, texts: list[Counter[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times) of the terms of the texts, given as their words; by text, then by term."""
        sizes, flat = list(map(len, texts)), list(chain.from_iterable(texts))
        codes = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        words_at, new = np.flatnonzero(codes >= 0), np.flatnonzero(codes < 0)
        own = codes[words_at]
        n = self.size[own]
        # Words are terms, words of the examples have known marks, and other words may begin with one.
        begun = [(i, self._begin(flat[i])) for i in new.tolist()] if self.marks else []
        begun = [(i, t) for i, found in begun for t in found]
        at = np.concatenate([words_at, np.repeat(words_at, n), np.array([i for i, _ in begun], np.int64)])
        found = np.concatenate([own, self.row[_ranges(self.begin[own], n)], np.array([t for _, t in begun], np.int64)])
        times = np.fromiter(chain.from_iterable(t.values() for t in texts), np.int64, len(codes))
        terms = max(1, len(self.number))
        key, back = np.unique(np.repeat(np.arange(len(texts)), sizes)[at] * terms + found, return_inverse=True)
        return key // terms, key % terms, np.bincount(back, weights=times[at], minlength=len(key))

    def vectors(self, texts: list[Counter[str]], weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each text, of length 1."""
        text, at, times = self.counts(texts)
        x = (1 + np.log(times)) * weight[at]
        length = np.sqrt(np.bincount(text, x * x, len(texts)))
        x = x / np.maximum(length, 1e-12)[text]
        ends = np.searchsorted(text, np.arange(1, len(texts) + 1)).tolist()
        return [(at[i:j], x[i:j]) for i, j in zip([0, *ends], ends)]

    def batches(self, texts: Iterator[str | None]) -> Iterator[list[Counter[str]]]:
        """The words of the texts, some texts at a time."""
        held: list[Counter[str]] = []
        size = 0
        for t in texts:
            held.append(Counter(words(t)))
            size += len(held[-1])
            if len(held) == TOGETHER or size > 500_000:
                yield held
                held, size = [], 0
        if held:
            yield held


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, size), one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


@dataclass
class BlockMaxIndex:
    """Postings (example, weight) by term, cut at multiples of ``BLOCK`` examples, with each cut's largest weight.

    Terms that many examples hold have a row with a place for every example instead of a list. Their share of all
    cosines is added up first, for many texts at once; a block is then bounded by its largest share and the
    largest weights of the other terms.
    """

    size: int
    examples: np.ndarray  # of the postings, by term
    weights: np.ndarray
    begins: np.ndarray  # first cut of each term, and the end; common terms have none
    blocks: np.ndarray  # of the cuts
    cuts: np.ndarray  # first posting of each cut, and the end
    largest: np.ndarray
    common: np.ndarray  # row of each term among the common ones, or -1
    rows: np.ndarray  # weight by common term and example; as many examples as blocks hold

    @staticmethod
    def of(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int) -> BlockMaxIndex:
        sizes = [len(at) for at, _ in vectors]
        term = np.concatenate([at for at, _ in vectors]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([x for _, x in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(len(vectors), dtype=np.int64), sizes)
        holders = np.bincount(term, minlength=terms)
        often = np.sort(np.argsort(-holders, kind="stable")[: min(MOST_COMMON, int((holders * COMMON > len(vectors)).sum()))])
        common = np.full(terms, -1)
        common[often] = np.arange(len(often))
        rows = np.zeros((len(often), -(-len(vectors) // BLOCK) * BLOCK))
        own = common[term]
        rows[own[own >= 0], example[own >= 0]] = weight[own >= 0]
        term, example, weight = term[own < 0], example[own < 0], weight[own < 0]
        order = np.argsort(term, kind="stable")
        term, example, weight = term[order], example[order], weight[order]
        block = example // BLOCK
        first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        return BlockMaxIndex(
            len(vectors), example, weight, np.searchsorted(term[first], np.arange(terms + 1)), block[first],
            np.append(first, len(term)), np.maximum.reduceat(weight, first) if len(first) else np.zeros(0), common, rows)

    def shares(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the common terms add to the cosine of each vector with each example."""
        x = np.zeros((len(vectors), len(self.rows)))
        for i, (at, v) in enumerate(vectors):
            own = self.common[at]
            x[i, own[own >= 0]] = v[own >= 0]
        return x @ self.rows

    def nearest(self, at: np.ndarray, x: np.ndarray, k: int, without: int = -1,
                share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the ``k`` nearest with a cosine above 0, nearest first, equal ones by number.
        ``share``: the vector's row of ``shares``."""
        if share is None:
            share = self.shares([(at, x)])[0]
        sizes = self.begins[at + 1] - self.begins[at]
        cut, q = _ranges(self.begins[at], sizes), np.repeat(x, sizes)
        block = self.blocks[cut]
        shares = share.reshape(-1, BLOCK)
        bound = shares.max(1) + np.bincount(block, q * self.largest[cut], len(shares))
        order = np.argsort(-bound, kind="stable")
        found_at, found = np.zeros(0, np.int64), np.zeros(0)
        least, seen = 0.0, 0
        while seen < len(order):
            # The highest bounds first, then all blocks that may still hold a nearer example.
            upper = order[seen:] if seen else order[:FIRST]
            visited = upper[(bound[upper] > 0) & (bound[upper] >= least - 1e-9)]
            seen += len(upper)
            if not len(visited):
                break
            chosen = np.zeros(len(bound), bool)
            chosen[visited] = True
            own = chosen[block]
            starts = self.cuts[cut[own]]
            n = self.cuts[cut[own] + 1] - starts
            posting = _ranges(starts, n)
            score = share + np.bincount(self.examples[posting], np.repeat(q[own], n) * self.weights[posting], len(share))
            if len(visited) < len(bound):
                score.reshape(-1, BLOCK)[~chosen] = 0
            if without >= 0:
                score[without] = 0
            hit = np.flatnonzero(score > max(0.0, least - 1e-9))
            if len(hit) > 4 * k:  # those that may be among the nearest, ties included
                hit = hit[score[hit] >= np.partition(score[hit], -k)[-k] - 1e-9]
            found_at, found = np.append(found_at, hit), np.append(found, score[hit])
            top = np.lexsort((found_at, -np.round(found, 12)))[:k]
            found_at, found = found_at[top], found[top]
            if len(found) == k:
                least = float(found.min())
        return found_at, found


@dataclass
class Model:
    terms: list[str]
    weight: np.ndarray
    index: BlockMaxIndex
    ids: np.ndarray
    labels: np.ndarray
    prior: float
    slope: float
    offset: float
    unknown: float  # score of a text that shares no term with any example

    def vote(self, at: np.ndarray, x: np.ndarray, without: int = -1,
             share: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        near, cos = self.index.nearest(at, x, NEIGHBOURS, without, share)
        w = 1 / (SOFTEN + 1 - np.minimum(cos, 1))
        toxic = (w @ self.labels[near] + PRIOR * self.prior) / (w.sum() + PRIOR)
        return float(np.log(toxic / (1 - toxic))), near, cos

    def scores(self, texts: Iterator[str | None], terms: Terms) -> Iterator[tuple[float, list[int], list[float]]]:
        """(score, evidence, similarity) of every text, in order."""
        for batch in terms.batches(texts):
            vectors = terms.vectors(batch, self.weight)
            for (at, x), share in zip(vectors, self.index.shares(vectors)):
                if not len(at):
                    yield self.unknown, [], []
                    continue
                v, near, cos = self.vote(at, x, share=share)
                yield float(1 / (1 + np.exp(-(self.slope * v + self.offset)))), self.ids[near].tolist(), cos.round(6).tolist()


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (0 at least) and offset of the weighted logistic fit, with a light penalty that keeps them finite."""
    if not len(x):
        return 1.0, 0.0
    a = np.stack([x, np.ones(len(x))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + 1e-2 * (beta - [1, 0])
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of the sampled labelled rows, one per text, and how many rows each stands for by class."""
    known = labels.where(F.col("toxic").isin(0, 1) & learning_row(F.col("doc_id"), 3, 1))
    known = written(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("toxic") == 1, PER_CLASS / max(1, counts.get(1, 0))).otherwise(PER_CLASS / max(1, counts.get(0, 0)))
    drawn = known.where(draw < share)  # PER_CLASS rows of a class, or few more
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = rows.groupBy(F.xxhash64("text").alias("_t")).agg(F.min_by(F.struct("doc_id", "text", "toxic"), "doc_id").alias("r"))
    rows = written(rows.select("r.*"), "examples")
    held = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return rows, {c: counts[c] / max(1, held.get(c, 0)) for c in counts}


def example_terms(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The terms of the examples, in order, and how far each tells toxic from clean examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, toxic = [], []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                own = {x for w in set(words(t)) for x in word_terms(w)}
                found += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int32())], ["term", "toxic"])

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.select("text", "toxic").mapInArrow(run, "term string, toxic int").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b, n = F.col("a").cast("double"), F.col("b").cast("double"), float(n1 + n0)
    chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2)) / ((a + b) * (n - a - b) * float(max(1, n1 * n0)) + 1e-9)
    likelier = (a + 0.5) / (n1 + 1) >= LIKELIER * (b + 0.5) / (n0 + 1)
    counted = written(counted.withColumn("chi2", chi2), "terms")
    begins = F.col("term").endswith("~")
    marking = counted.where(begins & (a >= max(LEAST_DOCS, LEAST_SHARE * n1)) & likelier & (F.col("chi2") >= CHI2))
    marking = marking.orderBy(F.desc("chi2"), "term").limit(TERMS)
    # Bounded by the examples. The order makes sums of weights, and so ties, the same in every run.
    chosen = counted.where(~begins).unionByName(marking).orderBy("term").toArrow()
    share = n1 / max(1, n1 + n0)
    x = chosen.column("a").to_numpy().astype(float) + SMOOTH * share
    y = chosen.column("b").to_numpy().astype(float) + SMOOTH * (1 - share)
    if not n1 or not n0:
        return chosen.column("term").to_pylist(), np.full(len(x), LEAST)
    odds = np.log(x / n1) - np.log(y / n0)
    z2 = odds**2 / (1 / x + 1 / y)
    return chosen.column("term").to_pylist(), LEAST + np.abs(odds) * z2 / (z2 + DOUBT)


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and documents in all, over the whole of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by PER_CLASS

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.number) + 1, np.int64)
        for batch in rows:
            total[-1] += batch.num_rows
            for texts in own.batches(t.as_py() for t in batch.column("text")):
                total[:-1] += np.bincount(own.counts(texts)[1], minlength=len(total) - 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    out = np.zeros(len(terms.number) + 1, np.int64)
    counted = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()  # one row per term of the examples
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from documents and labels: labels of held-out rows are not read."""
    rows, stands_for = examples(docs, labels)
    terms, relevance = example_terms(rows)
    own = Terms(terms)
    frequencies, n = document_frequencies(docs, own)
    weigh = (np.log((1 + n) / (1 + frequencies)) + 1) * relevance
    held, bare = [], {0: 0, 1: 0}
    for r in rows.toLocalIterator():  # at most about two times PER_CLASS rows
        at, x = own.vectors([Counter(words(r["text"]))], weigh)[0]
        if len(at):
            held.append((r["doc_id"], r["toxic"], at, x))
        else:
            bare[r["toxic"]] += 1
    held.sort(key=lambda h: h[0])
    labels_of = np.array([h[1] for h in held], float)
    weight = np.array([stands_for.get(h[1], 1.0) for h in held])
    known = weight.sum()
    prior = float((weight @ labels_of + 0.5) / (known + 1)) if len(held) else 0.5
    toxic, clean = (bare[c] * stands_for.get(c, 1.0) for c in (1, 0))
    model = Model(terms, weigh, BlockMaxIndex.of([(h[2], h[3]) for h in held], len(terms)),
                  np.array([h[0] for h in held], np.int64), labels_of, min(prior, 0.5), 1.0, 0.0,
                  float((toxic + min(prior, 0.5)) / (toxic + clean + 1)))
    votes = np.array([model.vote(h[2], h[3], i)[0] for i, h in enumerate(held)])
    model.slope, model.offset = logistic(votes, labels_of, weight / max(weight.mean(), 1e-12) if len(held) else weight)
    return model


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, evidence array<bigint>, similarity array<double>"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out (no label was learned from it), score, predicted, evidence (doc_ids
    of the nearest examples, nearest first) and similarity (their cosines).

    A text that shares no term with any example, also a null or empty one, has the toxic share of examples without words,
    drawn to that of all examples, as its score and no evidence. Rows that repeat a doc_id are scored one by one; a null doc_id stays null and is not held out. Without any
    example every score is 0.5. Columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((replace(model, terms=[]), Terms(model.terms)))  # bounded by PER_CLASS

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms = shared.value
        for batch in rows:
            found = list(known.scores((t.as_py() for t in batch.column("text")), terms))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"),
                 pa.array([f[0] for f in found], pa.float64()),
                 pa.array([int(f[0] >= REJECT) for f in found], pa.int32()),
                 pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence", "similarity"])

    held = F.coalesce(~learning_row(F.col("doc_id"), 3, 1), F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose text scores ``REJECT`` or more; all columns kept, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast((replace(model, terms=[]), Terms(model.terms)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, terms = shared.value
        for batch in rows:
            keep = [f[0] < REJECT for f in known.scores((t.as_py() for t in batch.column("text")), terms)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
