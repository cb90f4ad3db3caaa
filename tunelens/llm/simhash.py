"""SimHash fingerprints and their near-duplicates by multi-index hashing.

For a radius of r a fingerprint is cut into r + 1 segments, arranged in a cycle, and there is one table per segment, keyed
by that segment and the next one. A query keeps the first exact, enumerates the Hamming ball of radius one within the
second, fetches the table's entries and verifies the distance over all 64 bits. No pair is missed: see ``near``. A key
fixes two segments, so groups of near copies stay apart in small buckets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.llm.components import components
from tunelens.llm.tables import salted_lookup, written

SEED = 42
RADIUS = 2
_CHUNK = 1 << 16  # shingles whose bits are spread out at a time


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Rows of bytes to the bits that over half of the rows have, as bytes."""
    ones = np.zeros(8 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little")


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """``width`` consecutive words joined by a space, repeats included; a shorter text is one shingle."""
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    starts = np.append(0, ends[:-1])[:n].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    return [joined[a:b] for a, b in zip(starts, stops)]


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the shingles of ``text``: a bit is set if over half of their hashes have it."""
    # On bytes, lower() changes A-Z only and split() knows the six ASCII white-space characters only.
    parts = shingles(text.lower().split(), width)
    if not parts:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(p, SEED) for p in parts], "<u8")
    return int(_majority(hashes.view(np.uint8).reshape(-1, 8)).view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): 64 bits as a signed integer. A null text counts as empty; its fingerprint is zero."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = [fingerprint(t.as_py() or b"", width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


def _segments(radius: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of ``radius`` + 1 segments."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment(fp: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1).cast("bigint"))


def _key(table: int, exact: Column, probed: Column) -> Column:
    return F.shiftleft(F.lit(table).cast("bigint"), 50).bitwiseOR(F.shiftleft(exact, 25)).bitwiseOR(probed)


def near(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of different fingerprints in ``nodes`` (fp, distinct) that differ in at most ``radius`` bits (2 to 8).

    No pair is missed. Suppose every segment without differing bits is followed, in the cycle, by one with two or more.
    With z such segments of m, at least 2 z + (m - 2 z) = m bits differ, but only ``radius`` = m - 1 may. So some segment
    is equal and the next one differs in at most one bit. Of two segments that differ in one bit, one has the bit set:
    clearing set bits is all of the ball that has to be enumerated.
    """
    tables, probes = _keys(radius)
    table = nodes.select(F.col("fp").alias("other"), F.explode(tables).alias("key"))
    probe = nodes.select("fp", F.explode(probes).alias("key"))
    met = probe.join(table, "key").where(F.col("fp") != F.col("other"))
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    return met.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct()


def _across(entries: DataFrame, radius: int) -> DataFrame:
    """(a, b, fa, fb, ca, cb): pairs of nodes, fingerprints and components for entries (node, fp, component) of different
    components whose fingerprints differ in at most ``radius`` bits."""
    tables, probes = _keys(radius)
    table = entries.select(
        F.col("node").alias("other_node"), F.col("fp").alias("other"), F.col("component").alias("others"), F.explode(tables).alias("key"))
    probe = entries.select("node", "fp", "component", F.explode(probes).alias("key"))
    met = probe.join(table, "key").where("component != others")
    met = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    here, there = F.struct("component", "fp", "node"), F.struct("others", "other", "other_node")
    # A struct takes its field names from the first of the two.
    there = there.cast("struct<component: bigint, fp: bigint, node: bigint>")
    met = met.select(F.least(here, there).alias("x"), F.greatest(here, there).alias("y")).distinct()
    return met.select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.fp").alias("fa"), F.col("y.fp").alias("fb"),
        F.col("x.component").alias("ca"), F.col("y.component").alias("cb"))


def _keys(radius: int) -> tuple[Column, Column]:
    """The keys under which ``fp`` stands in the tables, and those it looks up."""
    segments = _segments(radius)
    tables, probes = [], []
    for i, exact in enumerate(segments):
        probed = segments[(i + 1) % len(segments)]
        fixed, ball = _segment(F.col("fp"), exact), _segment(F.col("fp"), probed)
        tables.append(_key(i, fixed, ball))
        probes.append(_key(i, fixed, ball))
        for bit in range(probed[1]):
            one = F.lit(1 << bit).cast("bigint")
            probes.append(F.when(ball.bitwiseAND(one) != 0, _key(i, fixed, ball.bitwiseXOR(one))))
    return F.array(*tables), F.array_compact(F.array(*probes))


def clusters(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links, itself included).

    Equal fingerprints are linked and stand for one node from the start, so a group of copies is one row in every search.
    Rows that share a doc_id are one document: all their fingerprints are linked. A null doc_id counts as larger than
    every id, and all of them as one document. An empty table gives no rows; columns other than doc_id and text are not read.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    whole = prints.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc"), "fp")
    nodes = written(whole.groupBy("fp").agg(F.min("doc").alias("first"), F.count("*").alias("docs")), "nodes")
    links = written(near(nodes.select("fp")), "near")
    name = nodes.select("fp", "first")
    by_a = links.join(name.withColumnRenamed("fp", "a").withColumnRenamed("first", "fa"), "a")
    named = by_a.join(name.withColumnRenamed("fp", "b").withColumnRenamed("first", "fb"), "b").select("fa", "fb")
    repeated = whole.groupBy("doc").agg(F.countDistinct("fp").alias("n")).where("n > 1").select("doc")
    same = whole.join(repeated, "doc").distinct().join(name, "fp").select(F.col("doc").alias("fa"), F.col("first").alias("fb"))
    labels = components(named.unionByName(same).toDF("a", "b"))
    placed = nodes.join(labels, F.col("first") == F.col("node"), "left")
    placed = placed.select("fp", F.coalesce("component", "first").alias("component_id"), "docs", "first")
    moved = placed.where("docs > 1 OR component_id != first").select("fp", "component_id")
    found = salted_lookup(prints, moved, "fp", "doc_id")
    return found.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def digest(docs: DataFrame, width: int = 3) -> DataFrame:
    return clusters(docs, width).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Search fingerprints of near copies are SimHashes of words weighted by the root of their count, so that an edited word
#: changes one hash and not ``width``, and frequent words do not make strangers alike. One in three or four of the pairs
#: right at a similarity of 0.8 differs in more than four bits; three independent fingerprints miss few of them.
SEARCH_PRINTS, SEARCH_RADIUS = 3, 4
#: Shingles of a document are dealt into so many buckets, each of which keeps a byte of its smallest hash.
BUCKETS = 256
#: Hashes of shingle sets that a task holds before it gives them away.
SET_HASHES = 500_000
#: Pairs whose estimated similarity is this much below the threshold are not held against each other exactly: six standard
#: errors of the estimate.
SLACK = 0.15


def sketch(h: np.ndarray) -> bytes:
    """One byte per bucket: 0 if none of the shingle hashes falls there, else 1 to 255 from the smallest."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (h % np.uint64(BUCKETS)).astype(np.int64), h // np.uint64(BUCKETS))
    empty = least == np.iinfo(np.uint64).max
    return np.where(empty, 0, 1 + least % np.uint64(255)).astype(np.uint8).tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of the shingle sets behind rows of sketches: buckets that agree among those not empty in both,
    less what bytes agree by chance. Close to exact for documents with fewer shingles than buckets."""
    used = ((a > 0) | (b > 0)).sum(1)
    raw = ((a == b) & (a > 0)).sum(1) / np.maximum(used, 1)
    return np.where(used == 0, 1.0, (raw - 1 / 255) / (1 - 1 / 255))


def word_prints(words: list[bytes]) -> np.ndarray:
    """``SEARCH_PRINTS`` SimHashes of the words, each weighted by the root of its count (in whole 16ths, so that sums
    are exact)."""
    if not words:
        return np.zeros(SEARCH_PRINTS, np.int64)
    counts = Counter(words)
    weights = np.sqrt(np.fromiter(counts.values(), np.int64, len(counts)) * 256).astype(np.int64)
    raw = b"".join([xxhash.xxh3_128_digest(w, 1) + xxhash.xxh3_64_digest(w, 2) for w in counts])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(counts), -1), axis=1)
    ones = weights @ bits.astype(np.int64)
    return np.packbits(2 * ones > weights.sum()).view(">u8").astype(np.uint64).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, f0, f1, f2, wide, parts): the search fingerprints, the sketch of the set of ``width``-word shingles, and a
    hash of that set."""
    names = [f"f{i}" for i in range(SEARCH_PRINTS)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            prints, wide, parts = np.zeros((len(batch), SEARCH_PRINTS), np.int64), [], []
            for i, t in enumerate(batch.column("text")):  # the words and shingles of one text at a time
                words = (t.as_py() or b"").lower().split()
                prints[i] = word_prints(words)
                own = hashed(set(shingles(words, width)))
                wide.append(sketch(own))
                parts.append(xxhash.xxh64_intdigest(own.tobytes(), 3) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(np.ascontiguousarray(c)) for c in prints.T],
                 pa.array(wide, pa.binary()), pa.array(parts, pa.int64())],
                ["doc_id", *names, "wide", "parts"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", wide binary, parts bigint")


def hashed(parts: set[bytes]) -> np.ndarray:
    """The hashes of a set of shingles, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, 1) for p in parts), np.uint64, len(parts)))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sets, given as ascending arrays; 1 for two empty ones."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int, limit: int = 1_000_000) -> DataFrame:
    """(node, parts) for the rows of ``docs`` whose doc_id is in ``ids`` (node): the hashes of the ``width``-word shingles."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts, node, first, size, held = batch.column("text"), batch.column("node"), 0, 0, []
            for i, t in enumerate(texts):
                held.append(hashed(set(shingles((t.as_py() or b"").lower().split(), width))).view(np.int64))
                size += len(held[-1])
                if size >= SET_HASHES or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [node.slice(first, len(held)), pa.array(held, pa.list_(pa.int64()))], ["node", "parts"])
                    first, size, held = i + 1, 0, []

    if ids.count() <= limit:
        ids = F.broadcast(ids)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("binary").alias("text"))
    return rows.join(ids, "node", "left_semi").mapInArrow(run, "node bigint, parts array<bigint>")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of ``nodes`` (node, wide) whose shingle sets have ``similarity`` or more, exactly. The
    sketches only spare pairs that are far off the reading of their sets."""

    def loose(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("wa", "wb"))
            yield batch.select(["a", "b"]).filter(pa.array(estimated(x, y) >= similarity - SLACK))

    def exact(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            like = [jaccard(x.values.to_numpy(), y.values.to_numpy()) >= similarity for x, y in zip(batch.column("pa"), batch.column("pb"))]
            yield batch.select(["a", "b"]).filter(pa.array(like, pa.bool_()))

    def sided(rows: DataFrame, table: DataFrame, value: str, short: str) -> DataFrame:
        for c in "ab":
            rows = rows.join(table.select(F.col("node").alias(c), F.col(value).alias(short + c)), c)
        return rows.select("a", "b", short + "a", short + "b")

    close = written(sided(pairs, nodes, "wide", "w").mapInArrow(loose, "a bigint, b bigint").distinct(), "close")
    ids = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(shingle_sets(docs, written(ids, "ids"), width), "sets")
    return written(sided(close, sets, "parts", "p").mapInArrow(exact, "a bigint, b bigint").distinct(), "alike")


def without(docs: DataFrame, gone: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone`` (_gone). Up to ``limit`` ids, counted, are broadcast, so that
    no text moves; beyond it both sides are shuffled by id."""
    carried = docs.select("doc_id", F.struct("*").alias("_row"))
    if gone.count() <= limit:
        gone = F.broadcast(gone)
    return carried.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select("_row.*")


def _crowds(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of each of ``nodes`` (node, fp) with the smallest one that has the same fingerprint."""
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    crowd = salted_lookup(nodes, written(heads, "heads").where("n > 1").select("fp", "head"), "fp", "node", "inner")
    return crowd.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))


def _members(met: DataFrame, known: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of all of ``known`` (node, fp, component) on either side of the met entries (a, b, fa, fb, ca, cb) whose
    components are still two by ``labels``."""
    for c in "ab":
        now = labels.select(F.col("node").alias(f"c{c}"), F.col("component").alias(f"now{c}"))
        met = met.join(now, f"c{c}", "left").withColumn(f"now{c}", F.coalesce(f"now{c}", f"c{c}"))
    apart = met.where("nowa != nowb").select("fa", "ca", "fb", "cb")
    for c in "ab":
        own = known.select(F.col("node").alias(c), F.col("fp").alias(f"f{c}"), F.col("component").alias(f"c{c}"))
        apart = apart.join(own, [f"f{c}", f"c{c}"])
    return apart.select("a", "b")


def drop_near(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each group of near copies; all columns kept.

    Documents are near copies if one of their search fingerprints differs in at most ``SEARCH_RADIUS`` bits and their
    sets of ``width``-word shingles have ``similarity`` or more; groups are the connected components. First, documents
    with an equal fingerprint are held against the smallest of them, so that a large family of near copies is one
    component before the search. The search only looks for pairs of different components. It holds one document of each
    fingerprint and component against another; where that leaves two components apart, all their documents with the
    fingerprints that met are held against each other, so no pair of near copies stays in two groups. Null and empty
    texts form one group. Rows that share a doc_id stay or go together; rows with a null doc_id stay. An empty table
    gives no rows.
    """
    names = [f"f{i}" for i in range(SEARCH_PRINTS)]
    rows = written(sketches(docs, width).where("doc_id IS NOT NULL"), "sketches")
    whole = F.xxhash64(*names, "parts").alias("whole")
    nodes = written(rows.groupBy(whole).agg(
        F.min_by(F.struct(*names, "wide"), "doc_id").alias("s"), F.min("doc_id").alias("node"), F.count("*").alias("n")), "nodes")
    twins = salted_lookup(rows.select("doc_id", whole), nodes.where("n > 1").select("whole", "node"), "whole", "doc_id", "inner")
    links = twins.where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    nodes = nodes.select("node", "s.*")
    prints = [nodes.select("node", F.col(name).alias("fp")) for name in names]
    crowds = None
    for own in prints:
        crowds = _crowds(own) if crowds is None else crowds.unionByName(_crowds(own))
    links = written(links.unionByName(_verified(crowds.distinct(), nodes, docs, width, similarity)), "links")
    labels = written(components(links), "labels")
    found, first = [], None
    for own in prints:
        known = own.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        known = written(known, "known")
        met = written(_across(known.groupBy("fp", "component").agg(F.min("node").alias("node")), SEARCH_RADIUS), "met")
        found.append((known, met))
        first = met.select("a", "b") if first is None else first.unionByName(met.select("a", "b"))
    joined = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(
        _verified(first.distinct(), nodes, docs, width, similarity))
    labels, rest = written(components(joined), "labels"), None
    for known, met in found:
        pairs = _members(met, known, labels)
        rest = pairs if rest is None else rest.unionByName(pairs)
    rest = written(rest.distinct(), "rest")
    joined = joined.unionByName(_verified(rest, nodes, docs, width, similarity))
    gone = components(joined).where("node != component").select(F.col("node").alias("_gone"))
    return without(docs, written(gone, "gone"))
