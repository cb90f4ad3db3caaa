"""Exact deduplication with a two-pass Bloom filter; DataFrame functions only.

Pass one hashes every normalised text once and builds a filter of the positions that two or more texts hit. Pass two
tests each row against it: a row with a position nobody else hit is unique and passes straight through; only possibly
repeated rows are shuffled, by the full SHA-256 of the text, so that false positives of the filter change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelens.llm.tables import SPACE, salted_lookup, written

BITS_PER_ROW = 16
PROBES = 3
MIN_BITS = 1 << 18
#: 2^30 positions are 128 MiB, the largest filter that is ever broadcast. Beyond that many rows the filter lets more
#: rows through to the shuffle; results stay the same.
MAX_BITS = 1 << 30
_BUCKET = 32768  # positions of one bitmap of bitmap_construct_agg


def normalised(text: Column) -> Column:
    """Null as empty; every run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def _positions(sha: str, bits: int) -> list[Column]:
    size = F.lit(bits).cast("bigint")
    first, second = F.pmod(F.xxhash64(F.col(sha)), size), F.pmod(F.xxhash64(F.col(sha), F.lit(1)), size)
    return [F.pmod(first + F.lit(i) * second, size) for i in range(PROBES)]


def repeated_filter(hashed: DataFrame, bits: int) -> DataFrame:
    """(bucket, bitmap): bits of the positions that at least two rows hit. At most ``bits`` / 8 bytes in all."""
    hits = hashed.select(F.explode(F.array(*_positions("text_sha256", bits))).alias("pos"))
    twice = hits.groupBy("pos").agg(F.count("*").alias("n")).where("n >= 2")
    bucket, at = F.floor(F.col("pos") / _BUCKET), F.pmod("pos", F.lit(_BUCKET).cast("bigint"))
    return twice.groupBy(bucket.cast("bigint").alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bitmap"))


def possibly_repeated(rows: DataFrame, filter_table: DataFrame, bits: int) -> DataFrame:
    """``rows`` with a boolean ``maybe``: all positions of the row's text_sha256 are set in the filter."""
    small = F.broadcast(filter_table)  # bounded by MAX_BITS / 8 bytes
    names, maybe = rows.columns, F.lit(True)
    for i, pos in enumerate(_positions("text_sha256", bits)):
        rows = rows.withColumn(f"_p{i}", pos).withColumn(f"_b{i}", F.floor(F.col(f"_p{i}") / _BUCKET).cast("bigint"))
        rows = rows.join(small.select(F.col("bucket").alias(f"_b{i}"), F.col("bitmap").alias(f"_m{i}")), f"_b{i}", "left")
        at = F.pmod(F.col(f"_p{i}"), F.lit(_BUCKET).cast("bigint")).cast("int")
        byte = F.substring(F.col(f"_m{i}"), F.floor(at / 8).cast("int") + 1, F.lit(1))
        bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), at % 8)
        maybe = maybe & F.coalesce(bit == 1, F.lit(False))
    return rows.select(*names, maybe.alias("maybe"))


def filter_bits(rows: int) -> int:
    bits = MIN_BITS
    while bits < rows * BITS_PER_ROW and bits < MAX_BITS:
        bits *= 2
    return bits


def _hash() -> Column:
    return F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("text_sha256")


def _two_passes(hashed: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with text_sha256) as those that are unique in ``hashed`` for certain, and the others with keep_id and
    group_size."""
    bits = filter_bits(hashed.count())
    doubles = written(repeated_filter(hashed, bits), "filter")
    again = possibly_repeated(hashed, doubles, bits).where("maybe")
    groups = again.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    tested = possibly_repeated(rows, doubles, bits)
    repeated = salted_lookup(tested.where("maybe").drop("maybe"), groups, "text_sha256", "doc_id", "inner")
    return tested.where(~F.col("maybe")).drop("maybe"), repeated


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, so null and empty texts form one group. Rows that repeat a doc_id with the same text
    share one decision. A null doc_id never wins against an id; if no row of the group has an id, keep_id is null and
    the rows are kept. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    hashed = written(docs.select("doc_id", _hash()), "hashes")
    unique, repeated = _two_passes(hashed, hashed)
    unique = unique.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("bigint"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return unique.unionByName(repeated).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without copies, all columns kept, whatever their names.

    Of each group of equal texts the row that ``exact_groups`` keeps stays; where several rows repeat that doc_id, one
    of them does. Texts of rows that the filter finds unique are never shuffled.
    """
    hashed = written(docs.select("doc_id", _hash()), "hashes")
    rows = docs.select("doc_id", _hash(), F.struct("*").alias("_row"))
    unique, repeated = _two_passes(hashed, rows)
    stays = repeated.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    one = stays.groupBy("doc_id", "text_sha256").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return unique.select("_row").unionByName(one.select("_row")).select("_row.*")


ORACLE = """
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
