"""Count, mean and squared deviations, which merge without losing digits when means are large.

A sum of squares around a value near the mean (a pivot) keeps the digits that a plain sum of squares loses for values
like epoch times, and two groups merge by the distance of their means alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Moments = tuple[float, float, float]


def from_sums(n: float, s: float, q: float, pivot: float) -> Moments:
    """Moments of n values from the sums of their distances to ``pivot`` and of the squares of these."""
    if not n:
        return 0.0, 0.0, 0.0
    return n, pivot + s / n, max(q - s * s / n, 0.0)


def merge(a: Moments, b: Moments) -> Moments:
    """Moments of two groups together."""
    if not a[0] or not b[0]:
        return tuple(b) if not a[0] else tuple(a)
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def from_sums_all(n: np.ndarray, s: np.ndarray, q: np.ndarray, pivot: float) -> tuple[np.ndarray, ...]:
    """:func:`from_sums` of many groups, none of them empty."""
    return n, pivot + s / n, np.maximum(q - s * s / n, 0.0)


def merge_all(a, b) -> tuple[np.ndarray, ...]:
    """:func:`merge` of many groups, none of ``b`` empty."""
    n, gap, had = a[0] + b[0], b[1] - a[1], a[0] != 0
    mean, m2 = a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n
    return np.where(had, n, b[0]), np.where(had, mean, b[1]), np.where(had, m2, b[2])


def centred(n: Column, s: Column, q: Column, pivot: Column) -> tuple[Column, Column]:
    """(mean, m2) of sums around ``pivot``; NULL without values."""
    share = F.try_divide(s, n)
    return pivot + share, F.greatest(q - s * share, F.lit(0.0))


def before(groups: DataFrame, order: str, name: str) -> tuple[Column, Column, Column]:
    """(n, mean, m2) of all groups before each one in ``order``, from columns ``<name>_n``, ``_mean``, ``_m2``.

    Group means are taken relative to the first group's mean. ``groups`` has one row per batch.
    """
    n, mean, m2 = (F.col(f"{name}_{c}") for c in ("n", "mean", "m2"))
    along = Window.orderBy(order)
    past = along.rowsBetween(Window.unboundedPreceding, -1)
    pivot = F.first(mean, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gap = mean - pivot
    total, s = F.sum(n).over(past), F.sum(n * gap).over(past)
    q = F.sum(m2 + n * gap * gap).over(past)
    mean_before, m2_before = centred(total, s, q, pivot)
    return total, mean_before, m2_before
