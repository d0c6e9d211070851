"""Hash-based randomness: the same draw for a row whatever the partitioning, engine or retry."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stable_key(*cols: Column | str, seed: int = 42) -> Column:
    """Hex digest of the seed and the columns."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(key: Column) -> Column:
    """A digest as a number in [0, 1): its first 52 bits."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_one(u: Column, top: int = 12) -> Column:
    """Poisson(1) count from a uniform number, by inversion of the distribution function."""
    import math

    out, cumulative = F, 0.0
    for k in range(top):
        cumulative += math.exp(-1.0) / math.factorial(k)
        out = out.when(u < cumulative, k)
    return out.otherwise(top)
