"""Exact null distributions of rank statistics, by counting.

Spark leaves one row per test: sizes, the statistic, and for rank sums the doubled midranks with the number of values that
share each.  Counting from there is a recursion over these few numbers; all its terms are positive, so small tails keep
their digits.  Ties are counted as they are (the distribution given the midranks), not broken.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _two_sided(ways: np.ndarray, at: int) -> float:
    total = ways.sum()
    return min(1.0, 2.0 * min(ways[: at + 1].sum(), ways[at:].sum()) / total)


def rank_sum(n_a: int, ranks2: Sequence[int], sizes: Sequence[int], sum2: int) -> float:
    """Two-sided p of a doubled rank sum: ways to choose ``n_a`` of all values, by their sum of doubled midranks."""
    order = np.argsort(ranks2)
    ranks2, sizes = np.asarray(ranks2, dtype=np.int64)[order], np.asarray(sizes, dtype=np.int64)[order]
    low = int(ranks2[0])  # only differences between the ranks count, in steps of what divides them all
    step = max(1, int(np.gcd.reduce(ranks2 - low)))
    ranks2, at = (ranks2 - low) // step, (sum2 - n_a * low) // step
    top = int(np.sort(np.repeat(ranks2, sizes))[::-1][:n_a].sum())
    ways = np.zeros((n_a + 1, top + 1))
    ways[0, 0] = 1.0
    for r, c in zip(ranks2.tolist(), sizes.tolist()):
        taken = ways.copy()
        for j in range(1, min(c, n_a) + 1):
            if j * r <= top:
                taken[j:, j * r :] += math.comb(c, j) * ways[: n_a + 1 - j, : top + 1 - j * r]
        ways = taken / taken.max()
    return _two_sided(ways[n_a], at)


def signed_rank(ranks2: Sequence[int], sizes: Sequence[int], sum2: int) -> float:
    """Two-sided p of a doubled sum of positive ranks: each midrank counts or not."""
    ways = np.ones(1)
    for r, c in zip(ranks2, sizes):
        for _ in range(int(c)):
            longer = np.zeros(len(ways) + int(r))
            longer[: len(ways)] = ways
            longer[int(r) :] += ways
            ways = longer / 2.0
    return _two_sided(ways, sum2)


def kolmogorov(n_a: int, n_b: int, steps: int) -> float:
    """P(D >= steps / (n_a n_b)) of two samples without ties.

    ``touched[i]`` is the share of the lattice paths to (i, s - i) that have reached the bound; a path's last step came
    from the left in i of s cases.  One anti-diagonal at a time, so the work is n_a times n_b.
    """
    i = np.arange(n_a + 1)
    touched = np.zeros(n_a + 1)
    touched[0] = float(steps <= 0)
    for s in range(1, n_a + n_b + 1):
        share = i / s
        from_left = np.concatenate([[0.0], touched[:-1]])
        touched = share * from_left + (1.0 - share) * touched
        j = s - i
        inside = (j >= 0) & (j <= n_b)
        touched = np.where(np.abs(i * n_b - j * n_a) >= steps, 1.0, touched)
        touched[~inside] = 0.0
    return min(1.0, float(touched[n_a]))


# ---- Spark surface: a null statistic or list gives a null p ---------------------------------


def p_rank_sum(n_a: Column, ranks2: Column, sizes: Column, sum2: Column) -> Column:
    @F.pandas_udf("double")
    def p(n: pd.Series, r: pd.Series, c: pd.Series, at: pd.Series) -> pd.Series:
        rows = zip(n, r, c, at)
        return pd.Series([None if r is None or at != at or not 0 < n < sum(c) else rank_sum(int(n), r, c, round(at)) for n, r, c, at in rows], dtype="float64")

    return p(n_a.cast("double"), ranks2, sizes, sum2.cast("double"))


def p_signed_rank(ranks2: Column, sizes: Column, sum2: Column) -> Column:
    @F.pandas_udf("double")
    def p(r: pd.Series, c: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or at != at else signed_rank(r, c, round(at)) for r, c, at in zip(r, c, at)], dtype="float64")

    return p(ranks2, sizes, sum2.cast("double"))


def p_kolmogorov(n_a: Column, n_b: Column, d: Column) -> Column:
    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, steps: pd.Series) -> pd.Series:
        return pd.Series([None if not (a > 0 and b > 0) or d != d else kolmogorov(int(a), int(b), round(d)) for a, b, d in zip(a, b, steps)], dtype="float64")

    return p(n_a.cast("double"), n_b.cast("double"), d.cast("double") * n_a * n_b)
