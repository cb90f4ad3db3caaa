"""Row numbers, running sums and order statistics that never pull one group into one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelens.session import stored

_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above, the row position below this bit
BUCKET = 65536


@dataclass
class Ordered:
    """A table written in global order. ``pos_id`` rises with the order; ``starts`` holds one entry per sorted
    partition: (partition, rows before it, rows in it)."""

    table: DataFrame
    starts: list[tuple[int, int, int]]

    @property
    def count(self) -> int:
        return sum(n for _, _, n in self.starts)

    def pos_id(self, row: int) -> int | None:
        """``pos_id`` of the zero-based ``row``; None past the end."""
        for part, before, n in self.starts:
            if row < before + n:
                return (part << _POSITION_BITS) + row - before
        return None

    def slice(self, first: int, end: int) -> DataFrame:
        """Rows [first, end) as a range filter that reaches the Parquet scan."""
        return self._between(first, end).drop("pos_id")

    def _between(self, first: int, end: int | None) -> DataFrame:
        low, high = self.pos_id(first), None if end is None else self.pos_id(end)
        rows = self.table
        if low is None:
            return rows.where(F.lit(False))
        rows = rows.where(F.col("pos_id") >= low)
        if high is not None:
            rows = rows.where(F.col("pos_id") < high)
        return rows

    def numbered(self, name: str = "rn", first: int = 0, end: int | None = None) -> DataFrame:
        """The table, or its rows [first, end), with the global row number, starting at 1."""
        spark = self.table.sparkSession
        # One row per sorted partition: bounded by the number of shuffle partitions.
        starts = spark.createDataFrame([s[:2] for s in self.starts], "part bigint, before bigint")
        part = F.shiftright("pos_id", _POSITION_BITS)
        row = F.col("pos_id") - F.shiftleft(F.col("part"), _POSITION_BITS)
        taken = self.table if not first and end is None else self._between(first, end)
        rows = taken.withColumn("part", part).join(F.broadcast(starts), "part")
        return rows.withColumn(name, F.col("before") + row + 1).drop("part", "before", "pos_id")


def in_order(df: DataFrame, *order: str | Column) -> Ordered:
    """Sort once over the whole cluster and keep the result with each row's position.

    The written table fixes the layout, so the positions survive lost executors.
    """
    ranked = stored(df.orderBy(*order).withColumn("pos_id", F.monotonically_increasing_id()), "ordered")
    counts = (
        ranked.groupBy(F.shiftright("pos_id", _POSITION_BITS).alias("part")).agg(F.count("*").alias("n")).collect()
    )
    starts, before = [], 0
    for part, n in sorted((r["part"], r["n"]) for r in counts):
        starts.append((part, before, n))
        before += n
    return Ordered(ranked, starts)


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Row number from 1 inside each key, in ``order``. A key may span any number of partitions.

    After the sort a key is a run of segments, one per sorted partition. The rows before each segment are summed over
    the segments alone; rows meet that number on (partition, key), so a frequent key never gathers anywhere.
    """
    ordered = in_order(df, *keys, *order)
    if not keys:
        return ordered.numbered(name)
    part = F.shiftright("pos_id", _POSITION_BITS)
    rows = ordered.table.withColumn("_part", part)
    segments = rows.groupBy("_part", *keys).agg(F.min("pos_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    same = (F.col("r._part") == F.col("s._part")) & _all([F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    joined = rows.alias("r").join(segments.alias("s"), same)
    number = F.col("pos_id") - F.col("_first") + F.col("_before") + 1
    return joined.select(*[f"r.{c}" for c in df.columns], number.alias(name))


def _all(conditions: list[Column]) -> Column:
    total = conditions[0]
    for c in conditions[1:]:
        total = total & c
    return total


def running_sums(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], bucket: int = BUCKET, totals: bool = False
) -> DataFrame:
    """Running totals along the integer column ``order``, unique inside each key; with ``totals`` also the sum over
    the whole key as ``<name>_total``.

    Two levels: a window inside buckets of at most ``bucket`` rows, and running offsets over the bucket totals.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket)))
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    per_bucket = rows.groupBy(*keys, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in sums if totals],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for name in sums:
        rows = rows.withColumn(f"_r_{name}", F.sum(f"_v_{name}").over(inside))
    joined = rows.join(offsets, [*keys, "_bucket"])
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_r_{name}") + F.col(f"_o_{name}"))
    return joined.select(*df.columns, *sums, *[f"{n}_total" for n in sums if totals])


def bounded(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """``df`` ready to be broadcast if it has at most ``limit`` rows, else to be joined by shuffle. It is computed once and
    written; its rows are counted where they lie."""
    table = stored(df, "bounded")
    return F.broadcast(table) if table.count() <= limit else table


SALTS = 8


def lookup(rows: DataFrame, table: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """``rows`` joined with a smaller ``table`` on ``key``, however often a key occurs in ``rows``.

    A table of at most ``limit`` rows, counted, is broadcast. Beyond, its rows go to ``SALTS`` partitions each and every
    one of ``rows`` to one of them, by its value of ``by``, so that no key gathers in one task.
    """
    table = stored(table, "lookup")
    if table.count() <= limit:
        return rows.join(F.broadcast(table), key)
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact quartiles with linear interpolation, picked by rank instead of gathering a group's values.

    Equal values are counted before they are ordered, so that a frequent value is one row and never one large
    partition.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranked = in_order(counts, *keys, value).numbered("_row")
    # Positions of a value inside its key: [_end - _c, _end).
    placed = running_sums(ranked, keys, "_row", {"_end": F.col("_c")}, totals=True).withColumnRenamed("_end_total", "n")
    picks = []
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        at = (F.col("n") - 1) * F.lit(p)

        def value_at(position: Column) -> Column:
            return F.max(F.when((F.col("_end") - F.col("_c") <= position) & (position < F.col("_end")), F.col(value)))

        low, high = value_at(F.floor(at)), value_at(F.ceil(at))
        picks.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
