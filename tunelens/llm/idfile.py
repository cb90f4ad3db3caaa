"""Token-id files: canonical length-limited Huffman codes from global counts, in blocks that decode independently.

A file set is a folder with two Parquet tables, so that any store Spark reaches can hold it:

``codes``: (id, bits) - code lengths by id; the canonical codes follow from them.
``blocks``: (part, block, before, doc_ids, counts, bits, checkpoints) - whole documents in ascending doc_id order; parts
are ranges of doc_id, blocks count up inside a part, ``before`` is the ids of earlier blocks of the part. ``checkpoints``
holds the bits of every 64 ids; their running sum is the bit offset at which decoding can start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelens.llm.encoding import batches, encoder
from tunelens.llm.huffman import canonical_codes, code_lengths, decode_blocks, decode_table, encode_block
from tunelens.llm.tables import new_path, written

#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 16
#: Blocks of about this many ids are decoded together.
DECODE_IDS = 1 << 20
_BLOCKS = (
    "part int, block int, before bigint, doc_ids array<bigint>, counts array<bigint>, bits binary, checkpoints binary")


def encoded(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """(doc_id, n, ids): the ids of every whole text and an end id, little-endian, 16 bits wide if all ids fit."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        wide = _width(coder.tokenizer.get_vocab_size())
        for batch, texts in batches(rows):
            ids, ends, _, _ = coder.encode(texts)
            ids = ids.astype(wide)
            stop = np.array([end_id], wide)
            cut = [0, *ends.tolist()]
            raw = [np.concatenate([ids[a:b], stop]).tobytes() for a, b in zip(cut, cut[1:])]
            n = [b - a + 1 for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())],
                ["doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, ids binary")


def _width(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def _ids(n: int, raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def id_counts(table: DataFrame) -> DataFrame:
    """(id, n) over all documents: one count array per task, then a sum per id."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in rows:
            for n, raw in zip(batch.column("n").to_pylist(), batch.column("ids").to_pylist()):
                own = np.bincount(_ids(n, raw))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return table.select("n", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode ``docs`` and write the file set to ``path``.

    Null texts are empty, rows that repeat a doc_id follow one another, null ids come first. An empty table gives a file
    set without blocks. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    table = written(encoded(docs, vocabulary, end_id), "ids")
    found = id_counts(table).collect()  # at most one row per id of the vocabulary
    counts = np.zeros(max([end_id, *(r["id"] for r in found)]) + 1, np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    pairs = [(i, int(lengths[i])) for i in np.flatnonzero(lengths).tolist()]
    spark.createDataFrame(pairs, "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codes")
    codes = canonical_codes(lengths)  # as long as the vocabulary

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs_in, parts, held = [], [], 0
        for batch in rows:
            triples = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids")))
            for doc, n, raw in triples:
                if held and held + n > BLOCK_IDS:
                    yield _block(part, block, before, docs_in, parts, codes, lengths)
                    block, before = block + 1, before + held
                    docs_in, parts, held = [], [], 0
                docs_in.append(doc)
                parts.append(_ids(n, raw))
                held += n
        if held:
            yield _block(part, block, before, docs_in, parts, codes, lengths)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = table.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _block(part: int, block: int, before: int, docs: list, parts: list[np.ndarray], codes, lengths) -> pa.RecordBatch:
    bits, marks = encode_block(np.concatenate(parts), codes, lengths)
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
         pa.array([docs], pa.list_(pa.int64())), pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
         pa.array([bits], pa.binary()), pa.array([marks], pa.binary())],
        ["part", "block", "before", "doc_ids", "counts", "bits", "checkpoints"])


def read_ids(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """One row per document of a file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the
    ids as little-endian unsigned 32-bit integers (null without ``keep_ids``)."""
    lengths = np.zeros(1, np.uint8)
    pairs = spark.read.parquet(f"{path}/codes").collect()  # at most one row per id of the vocabulary
    if pairs:
        lengths = np.zeros(max(r["id"] for r in pairs) + 1, np.uint8)
        for r in pairs:
            lengths[r["id"]] = r["bits"]
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    ends = blocks.select("part", "before", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    totals = ends.groupBy("part").agg(F.sum("n").alias("n"))  # one row per range partition of the writer
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in rows:
            held, size = [], 0
            for row in batch.to_pylist():
                held.append(row)
                size += sum(row["counts"])
                if size >= DECODE_IDS:
                    yield _documents(held, table, keep_ids)
                    held, size = [], 0
            if held:
                yield _documents(held, table, keep_ids)

    # At most a few rows per partition of the writer, and no more partitions than the writer was given.
    placed = blocks.join(F.broadcast(bases), "part").withColumn("before", F.col("before") + F.col("base"))
    return placed.drop("base", "part", "block").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, token_ids binary")


def _documents(blocks: list[dict], table, keep_ids: bool) -> pa.RecordBatch:
    sizes = [sum(b["counts"]) for b in blocks]
    ids = decode_blocks([b["bits"] for b in blocks], [b["checkpoints"] for b in blocks], sizes, table)
    columns: list[list] = [[] for _ in range(5)]
    for b, own in zip(blocks, ids):
        at = 0
        for doc, n in zip(b["doc_ids"], b["counts"]):
            raw = own[at : at + n].astype("<u4").tobytes()
            for c, v in zip(columns, (doc, b["before"] + at, n, zlib.crc32(raw), raw if keep_ids else None)):
                c.append(v)
            at += n
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())],
        ["doc_id", "start", "n_tokens", "ids_crc32", "token_ids"])


def round_trip(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", keep_ids: bool = False) -> DataFrame:
    """Write ``docs`` to a new folder of the shared store and read the files back."""
    path = new_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary)
    return read_ids(docs.sparkSession, path, keep_ids)
