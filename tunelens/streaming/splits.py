"""Split merits from leaf statistics.

Works on the few numbers a leaf keeps per attribute and class; rows never come here.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CUTS = 10
CRITERIA = ("InfoGainSplitCriterion", "GiniSplitCriterion", "VarianceReductionSplitCriterion")


def normal_cdf(z):
    """Standard normal distribution function by the five-term error-function approximation (absolute error 1.5e-7)."""
    # The published coefficients.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = np.abs(z) / np.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    upper = 0.5 * poly * np.exp(-x * x)
    return np.where(z >= 0, 1.0 - upper, upper)


def impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity along the last axis of class counts; empty counts have none."""
    total = counts.sum(axis=-1, keepdims=True)
    p = np.divide(counts, total, out=np.zeros_like(counts, dtype=float), where=total > 0)
    if criterion == "InfoGainSplitCriterion":
        logs = np.log2(p, out=np.zeros_like(p), where=p > 0)
        return -(p * logs).sum(axis=-1)
    if criterion == "GiniSplitCriterion":
        return np.where(total[..., 0] > 0, 1.0 - (p * p).sum(axis=-1), 0.0)
    values = np.arange(counts.shape[-1])
    return (p * values * values).sum(axis=-1) - (p * values).sum(axis=-1) ** 2


def merit(parent: np.ndarray, branches: np.ndarray, criterion: str) -> np.ndarray:
    """Impurity drop of splitting ``parent`` (..., C) into ``branches`` (..., B, C)."""
    sizes = branches.sum(axis=-1)
    share = sizes / np.maximum(sizes.sum(axis=-1, keepdims=True), 1e-300)
    return impurity(parent, criterion) - (share * impurity(branches, criterion)).sum(axis=-1)


@dataclass
class Split:
    """Best test of one attribute: ``kind`` is numeric (x <= value), one (x = value) or many (a branch per value)."""

    attr: int
    kind: str
    value: float
    merit: float
    branches: np.ndarray


def numeric_cuts(n, mean, m2, low, high) -> tuple[np.ndarray, np.ndarray]:
    """Ten equally spaced cuts inside (low, high), and the class mass on both sides of each, by the normal CDF.

    Each class, the last axis, has a count, a mean and squared deviations from it; some class was seen."""
    seen = n > 0
    lo, hi = np.where(seen, low, np.inf).min(axis=-1), np.where(seen, high, -np.inf).max(axis=-1)
    cuts = lo[..., None] + (hi - lo)[..., None] * np.arange(1, CUTS + 1) / (CUTS + 1)
    sd = np.sqrt(np.divide(m2, n, out=np.zeros_like(m2), where=seen))[..., None, :]
    gap = cuts[..., None] - mean[..., None, :]
    z = np.divide(gap, sd, out=np.where(gap >= 0, np.inf, -np.inf), where=sd > 0)
    n = n[..., None, :]
    below = n * np.where(np.isinf(z), (z > 0).astype(float), normal_cdf(np.where(np.isinf(z), 0.0, z)))
    return cuts, np.stack([below, n - below], axis=-2)


def best_tests(stats: dict, parent: np.ndarray, criterion: str, binary_only: bool):
    """The best test of one attribute at each of many leaves, the first axis: its kind, values, merits and branches. Ties
    go to the first cut or value. ``stats`` holds arrays over leaves and classes."""
    if "values" in stats:
        table = stats["values"]
        if not binary_only:
            return "many", np.zeros(len(table)), merit(parent, table, criterion), table
        sides = np.stack([table, parent[:, None, :] - table], axis=-2)
        values = np.broadcast_to(np.arange(table.shape[1], dtype=float), sides.shape[:2])
        kind = "one"
    else:
        values, sides = numeric_cuts(stats["n"], stats["mean"], stats["m2"], stats["min"], stats["max"])
        kind = "numeric"
    merits = merit(parent[:, None, :], sides, criterion)
    best = np.arange(len(merits)), np.argmax(merits, axis=1)
    return kind, values[best], merits[best], sides[best]


def best_split(attr: int, stats: dict, parent: np.ndarray, criterion: str, binary_only: bool) -> Split | None:
    """Best test of one attribute at one leaf. ``stats`` holds arrays over the classes."""
    if "values" not in stats and not (stats["n"] > 0).any():
        return None
    one = {k: np.asarray(v)[None] for k, v in stats.items()}
    kind, value, merits, branches = best_tests(one, parent[None], criterion, binary_only)
    return Split(attr, kind, float(value[0]), float(merits[0]), branches[0])


def hoeffding_bound(n: float, classes: int, confidence: float, criterion: str) -> float:
    spread = max(np.log2(max(classes, 2)), 1.0) if criterion == "InfoGainSplitCriterion" else 1.0
    return float(np.sqrt(spread * spread * np.log(1.0 / confidence) / (2.0 * n)))
