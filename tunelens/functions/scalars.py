"""Small scalar expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 1024-step unit prefixes of the byte formatter.
SIZE_UNITS = ["", "Ki", "Mi", "Gi", "Ti", "Pi", "Ei", "Zi"]
SIZE_OVERFLOW_UNIT = "Yi"


def run_time_ms(start: Column, end: Column) -> Column:
    """Elapsed milliseconds; NULL while the end is unknown."""
    return end - start


def ms_to_ts(ms: Column) -> Column:
    """Epoch milliseconds as a timestamp of whole seconds in the session time zone."""
    return F.timestamp_seconds(F.floor(ms / F.lit(1000)))


def sizeof_fmt(num: Column, suffix: str = "B") -> Column:
    """Human-readable size with 1024 steps."""
    value = num.cast("double")
    chain = None
    for power, unit in enumerate(SIZE_UNITS):
        step = F.lit(1024.0**power)
        fits = F.abs(value) < F.lit(1024.0 ** (power + 1))
        text = F.format_string("%3.1f" + unit + suffix, value / step)
        chain = F.when(fits, text) if chain is None else chain.when(fits, text)
    overflow = F.format_string("%.1f" + SIZE_OVERFLOW_UNIT + suffix, value / F.lit(1024.0 ** len(SIZE_UNITS)))
    return F.when(value.isNotNull(), chain.otherwise(overflow))


def to_percent(fraction: Column) -> Column:
    return fraction * F.lit(100)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Position of ``value`` in [low, high] on a 0..100 scale; NULL when the range is flat."""
    return F.try_divide(value - low, high - low) * F.lit(100)


def inverse_minmax(value: Column, low: Column, high: Column) -> Column:
    """Like :func:`minmax` for measures where smaller is better."""
    return F.try_divide(high - value, high - low) * F.lit(100)


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
