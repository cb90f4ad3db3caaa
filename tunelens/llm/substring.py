"""Removal of repeated passages by an index of the whole corpus, with the factors of a relative Lempel-Ziv parse as output.

The reference of a document is the corpus itself. Its index is dealt in blocks over the cluster by phrase hash: a phrase
is a run of ``window`` words, its entry names two places where the phrase starts. All phrases that may repeat are joined
with the index; the hits alone decide which words go. Hits in a row with places in a row are then joined to factors,
each with its source; they describe the result and decide nothing.

Only phrases that may repeat are indexed. Every phrase picks an anchor, the smallest hash of ``GRAM`` consecutive words
in it. Equal phrases pick equal anchors, so a phrase whose anchor starts at one place only is unique. Anchors are about
a fourteenth of the phrases; those with two places or more go into a bit filter that tasks test their phrases against.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelens.llm.tables import written

WINDOW = 35
GRAM = 8
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Low bits of a place hold the word's number, the others come from the hash of the document's words.
PLACE_BITS = 20
#: Bits of the largest filter that is broadcast, 64 MiB. A corpus that outgrows it has more phrases indexed for nothing;
#: results stay the same.
MAX_BITS = 1 << 29
EMPTY = hashlib.sha256(b"").hexdigest()


class Rolling:
    """Hashes of all runs of words of one document."""

    def __init__(self, words: list[bytes]):
        self.powers = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))]

    def runs(self, length: int) -> np.ndarray:
        """One hash per run of ``length`` words, from runs of a power of two of words."""
        total, covered = None, 0
        n = len(self.powers[0]) - length + 1
        for level in range(length.bit_length() - 1, -1, -1):
            if not length >> level & 1:
                continue
            while len(self.powers) <= level:
                half = self.powers[-1]
                step = 1 << len(self.powers) - 1
                self.powers.append(half[:-step] * np.uint64(pow(_BASE, step, 1 << 64)) + half[step:])
            part = self.powers[level][covered : covered + n]
            total = part if total is None else total * np.uint64(pow(_BASE, 1 << level, 1 << 64)) + part
            covered += 1 << level
        x = total ^ (total >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``width`` consecutive values."""
    reach = 1
    while reach * 2 <= width:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    return best(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the grams that some phrase picks."""
    grams = Rolling(words).runs(gram)
    picked = _sliding(grams, window - gram + 1, np.minimum)
    margin = np.zeros(window - gram, np.uint64)
    most = _sliding(np.concatenate([margin, picked, margin]), window - gram + 1, np.maximum)
    at = np.flatnonzero(most == grams)
    return grams[at], at


def phrases(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase hash, anchor hash) for every phrase."""
    rolling = Rolling(words)
    return rolling.runs(window), _sliding(rolling.runs(gram), window - gram + 1, np.minimum)


class Filter:
    """Bits set by a column of 64-bit hashes: a hash that is absent from the filter is absent from the column."""

    def __init__(self, hashes: DataFrame, column: str):
        bits = 1 << 20
        while bits < 16 * hashes.count() and bits < MAX_BITS:
            bits *= 2
        both = F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit(bits - 1).cast("bigint")) for s in (0, 32)])
        at = hashes.select(F.explode(both).alias("at"))
        rows = at.groupBy(F.floor(F.col("at") / 32768).cast("bigint").alias("bucket")).agg(
            F.bitmap_construct_agg(F.pmod("at", F.lit(32768).cast("bigint"))).alias("bitmap"))
        table = np.zeros((bits // 32768, 4096), np.uint8)
        for r in rows.toLocalIterator():  # at most MAX_BITS / 8 bytes in all
            table[r["bucket"]] = np.frombuffer(r["bitmap"], np.uint8)
        self.bits = bits
        self.table = hashes.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        table, mask = self.table.value, np.uint64(self.bits - 1)
        found = np.ones(len(hashes), bool)
        for shift in (0, 32):
            at = (hashes >> np.uint64(shift)) & mask
            found &= (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def _words(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for t in batch.column("text"):
        yield (t.as_py() or b"").split()


def _sequence(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), 7)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def outlines(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Per row: doc_id, n_words, seq (hash of the words), sha (of all words), anchors and their places."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n, seqs, shas, found, places = [], [], [], [], []
            for words in _words(batch):
                joined = b" ".join(words)
                n.append(len(words))
                seqs.append(xxhash.xxh64_intdigest(joined, 7))
                shas.append(hashlib.sha256(joined).hexdigest())
                h, at = anchors(words, window, gram) if len(words) >= window else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                found.append(h.view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), _signed(seqs), pa.array(shas),
                 pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                ["doc_id", "n_words", "seq", "sha", "anchors", "places"])

    return _texts(docs).mapInArrow(
        run, "doc_id bigint, n_words bigint, seq bigint, sha string, anchors array<bigint>, places array<int>")


def _place(seq: str, at: str):
    high = F.col(seq).bitwiseAND(F.lit(-(1 << PLACE_BITS)).cast("bigint"))
    return high.bitwiseOR(F.col(at).cast("bigint").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("bigint")))


def _at_two_places(rows: DataFrame, key: str) -> DataFrame:
    """(key, first, last) of the keys of ``rows`` (key, place) with different places. Copies of one text share places."""
    ends = rows.groupBy(key).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    return ends.where("first != last")


def indexed_phrases(docs: DataFrame, repeated: Filter, window: int, gram: int) -> DataFrame:
    """Per row with phrases that may repeat: seq, their hashes and where they start."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            seqs, found, places = [], [], []
            for words in _words(batch):
                if len(words) < window:
                    continue
                phrase, anchor = phrases(words, window, gram)
                at = np.flatnonzero(repeated.may_hold(anchor))
                if len(at):
                    seqs.append(_sequence(words))
                    found.append(phrase[at].view(np.int64))
                    places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [_signed(seqs), pa.array(found, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                ["seq", "phrases", "places"])

    return _texts(docs).mapInArrow(run, "seq bigint, phrases array<bigint>, places array<int>")


def factors(places: np.ndarray, sources: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, source) of the factors for phrases that repeat: sorted ``places`` and, for each, its source."""
    starts = np.flatnonzero((np.diff(places, prepend=-2) != 1) | (np.diff(sources, prepend=sources[:1] - 2) != 1))
    stops = np.append(starts[1:], len(places)) - 1
    return places[starts], places[stops] + window, sources[starts]


def parse(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and the factors as arrays first_words,
    end_words, sources (a place: hash bits of the source's words and a word number; empty for whole copies).

    Words are runs of anything but ASCII white space. A word is removed if a run of ``window`` words that covers it also
    starts elsewhere, in another document or in the same one; rows that repeat a text, with or without the same doc_id, repeat all its
    runs. Texts with fewer words, empty and null ones lose nothing. A null doc_id stays null. An empty table gives no
    rows; columns other than doc_id and text are not read.
    """
    gram = min(gram, window)
    outline = written(outlines(docs, window, gram), "outlines")
    at = outline.select("seq", F.explode(F.arrays_zip("anchors", "places")).alias("z"))
    at = at.select("z.anchors", _place("seq", "z.places").alias("place"))
    repeated = Filter(written(_at_two_places(at, "anchors").select("anchors"), "anchors"), "anchors")
    listed = written(indexed_phrases(docs, repeated, window, gram), "phrases")
    at = listed.select("seq", F.explode(F.arrays_zip("phrases", "places")).alias("z"))
    at = at.select("seq", F.col("z.phrases").alias("phrase"), F.col("z.places").alias("at"), _place("seq", "z.places").alias("place"))
    index = _at_two_places(at.select("phrase", "place"), "phrase")
    source = F.when(F.col("place") == F.col("first"), F.col("last")).otherwise(F.col("first"))
    hits = at.join(index, "phrase").select("seq", "at", source.alias("source")).distinct()
    # A document's own phrases: no more than it has words.
    spans = hits.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("at", "source"))).alias("hits"))
    spans = written(spans.select("seq", "hits.at", "hits.source"), "spans")
    copies = outline.groupBy("seq").agg(F.count("*").alias("copies")).where("copies > 1")
    copies = copies.select("seq", F.lit(True).alias("copied"))
    known = outline.drop("anchors", "places").join(copies, "seq", "left")
    marks = known.join(spans.select("seq", F.lit(True).alias("cut")).distinct(), "seq", "left")
    long = F.col("n_words") >= window
    whole = marks.where(long & F.col("copied").isNotNull()).select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(EMPTY).alias("kept_sha256"))
    plain = marks.where(F.col("cut").isNull() & ~(long & F.col("copied").isNotNull())).select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    none = [F.array().cast(f"array<{t}>").alias(n) for n, t in _FACTORS]
    partly = spans.join(copies.join(outline.where(long).select("seq").distinct(), "seq"), "seq", "left_anti")
    partly = written(partly, "partly")
    return whole.unionByName(plain).select("*", *none).unionByName(_cut(docs, partly, window))


_FACTORS = (("first_words", "bigint"), ("end_words", "bigint"), ("sources", "bigint"))


def _cut(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The documents that lose some of their words. Only their texts are shuffled: a filter picks them in the scan."""
    affected = Filter(spans.select("seq"), "seq")

    def pick(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            seqs = np.array([_sequence(w) for w in _words(batch)], np.uint64)
            keep = pa.array(affected.may_hold(seqs))
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text"), _signed(seqs)], ["doc_id", "text", "seq"])
            yield out.filter(keep)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            columns: list[list] = [[] for _ in range(6)]
            places, sources = batch.column("at"), batch.column("source")
            for i, words in enumerate(_words(batch)):
                first, end, source = factors(
                    np.array(places[i].as_py(), np.int64), np.array(sources[i].as_py(), np.int64), window)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, first, 1)
                np.add.at(gone, end, -1)
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                sha = hashlib.sha256(b" ".join([words[j] for j in left])).hexdigest()
                row = (len(words), len(words) - len(left), sha, first, end, source)
                for c, v in zip(columns, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.string()), *[pa.array(c, pa.list_(pa.int64())) for c in columns[3:]]],
                ["doc_id", "n_words", "n_removed", "kept_sha256", *[n for n, _ in _FACTORS]])

    picked = _texts(docs).mapInArrow(pick, "doc_id bigint, text binary, seq bigint")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, " + ", ".join(
        f"{n} array<{t}>" for n, t in _FACTORS)
    return picked.join(spans, "seq").drop("seq").mapInArrow(cut, schema)
