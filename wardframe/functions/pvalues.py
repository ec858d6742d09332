"""Tail probabilities for a handful of test statistics (one per variable)."""

from __future__ import annotations

import math


def chi2_tail(x: float | None, df: int | None) -> float | None:
    """P(chi-squared with ``df`` degrees of freedom > x).

    Closed forms: an erfc or exponential term plus a finite sum, stepping up
    by two degrees at a time.
    """
    if x is None or df is None or math.isnan(x) or df < 1:
        return None
    if x <= 0:
        return 1.0
    half = x / 2
    tail, a = (math.erfc(math.sqrt(half)), 0.5) if df % 2 else (math.exp(-half), 1.0)
    while a < df / 2:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(tail, 1.0)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact probability of a 2x2 table: the tables no likelier
    than the observed one, the margins being fixed."""
    row, col, n = a + b, a + c, a + b + c + d

    def log_choose(m: int, k: int) -> float:
        return math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)

    def log_p(x: int) -> float:
        return log_choose(row, x) + log_choose(n - row, col - x) - log_choose(n, col)

    observed = log_p(a)
    support = range(max(0, row + col - n), min(row, col) + 1)
    return min(1.0, math.fsum(math.exp(lp) for lp in map(log_p, support) if lp <= observed + 1e-7))
