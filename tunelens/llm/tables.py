"""Tables written once to the shared folder, and lookups that frequent keys cannot slow down."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 8

#: ASCII white space as the contracts of these operators define it, and its complement, for Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else a folder in the session's warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a table of the shared folder: lineage ends here, and a lost executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def learning_row(doc_id: Column, parts: int, held: int) -> Column:
    """True for rows a model may learn from: crc32 of the id as text, modulo ``parts``, is not ``held``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) != held


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "left") -> DataFrame:
    """Join ``rows`` with the much smaller ``table``, which has one row per ``key``.

    Every table row goes to ``SALTS`` partitions and each row to one of them, chosen by ``by``: a key that holds a
    third of all rows is spread over that many tasks, and adaptive execution may split it further.
    """
    salt = F.pmod(F.xxhash64(F.col(by)), F.lit(SALTS)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")


