"""Ranks, exact quantiles and cumulative counts from a histogram of distinct values.

Everything that needs an order works on ``(group, value, count)`` rows instead of the data: equal values
are combined map-side first, so a hot value costs one row.  The running total over the distinct values is
computed in slices of the value axis; a slice is a pure function of the value and the column's range, so no
sampling pass is needed and a lost task recomputes the same slices.  Only one row per (group, slice) is ordered
globally.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES_PER_E_FOLD, SLICES_OF_RANGE = 256, 4096


def value_slice(c: Column, low: Column, high: Column) -> Column:
    """Monotone slice number: logarithmic around zero plus even steps between ``low`` and ``high``.

    The sum of two monotone step functions separates what either separates: values over many magnitudes as well as
    values that crowd far from zero (years, epoch seconds).
    """
    x = c.cast("double")
    fold = F.floor(F.signum(x) * F.log1p(F.abs(x)) * SLICES_PER_E_FOLD)
    width = high - low
    even = F.when((width > 0) & (width < float("inf")), F.floor((x - low) / width * SLICES_OF_RANGE)).otherwise(0)
    return (fold + even).cast("long")


def histogram(df: DataFrame, value: str, by: Sequence[str] = (), weights: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows (by…, value, counts…); nulls and NaN are no values."""
    weights = weights or {"n": F.count(F.lit(1))}
    keep = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    v = (F.col(value).cast("double") + F.lit(0.0)).alias(value)
    others = [c for c in df.columns if c != value]
    return df.where(keep).select(*others, v).groupBy(*by, value).agg(*[c.alias(k) for k, c in weights.items()])


def running(
    hist: DataFrame,
    value: str,
    counts: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Adds ``before_<c>`` (total of smaller values) and ``all_<c>`` (total) for every count column."""
    ends = hist.agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    h = hist.join(F.broadcast(ends))  # one row
    h = h.withColumn("_s", value_slice(F.col(value), F.col("_low"), F.col("_high"))).drop("_low", "_high")
    keys = ["_s"]
    if by:
        # a struct is never null and equal when its fields are, so null groups join on plain equality
        h, keys = h.withColumn("_g", F.struct(*by)), ["_g", "_s"]
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    parts = h.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in counts])
    across = Window.partitionBy("_g" if by else F.lit(0))  # one row per slice
    ahead = across.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in counts],
        *[F.sum(f"_t_{c}").over(across).alias(f"all_{c}") for c in counts],
    )
    out = h.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in counts]).join(parts, keys)
    out = out.withColumns({f"before_{c}": F.col(f"_i_{c}") + F.col(f"_o_{c}") for c in counts})
    return out.drop(*keys, *[f"_{x}_{c}" for x in "io" for c in counts])


def midranks(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Average ranks of the distinct values: rows (by…, value, n, rank)."""
    ranked = running(histogram(df, value, by), value, ["n"], by)
    return ranked.select(*by, value, "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias(out))


def quantiles_of(hist: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Exact linear-interpolated quantiles from a histogram: one row per group, one column per name."""
    ran = running(hist, value, [n], by)
    aggs = []
    for name, p in probs.items():
        pos = (F.col(f"all_{n}") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        first, last = F.col(f"before_{n}"), F.col(f"before_{n}") + F.col(n) - 1
        low = F.max(F.when((lo >= first) & (lo <= last), F.col(value)))
        high = F.max(F.when((hi >= first) & (hi <= last), F.col(value)))
        frac = F.max(pos - lo)
        aggs.append((low + (high - low) * frac).alias(name))
    return ran.groupBy(*by).agg(*aggs)


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    return quantiles_of(histogram(df, value, by), value, probs, by)


def medians(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "median") -> DataFrame:
    return quantiles(df, value, {out: 0.5}, by)
