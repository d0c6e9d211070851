"""Samples, splits and folds that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions.hashing import stable_key
from cohortlens.operators.rollup import first_n

SLICE_HEX = 4  # 65536 slices of the digest space


def hash_rank(df: DataFrame, key: str, by: Sequence[str] = (), seed: int = 42, out: str = "rank") -> DataFrame:
    """Exact 1-based rank by digest within every group.

    Ranked in slices of the digest space with slice totals added, so a group of any size is spread over
    65536 slices instead of being sorted in one.
    """
    h = df.withColumn("_h", stable_key(key, seed=seed)).withColumn("_s", F.substring("_h", 1, SLICE_HEX))
    keys = ["_s"]
    if by:
        h, keys = h.withColumn("_g", F.struct(*by)), ["_g", "_s"]
    inside = Window.partitionBy(*keys).orderBy("_h", key)
    before = Window.partitionBy("_g" if by else F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = h.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))  # one row per slice
    totals = totals.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = h.withColumn("_rn", F.row_number().over(inside)).join(totals, keys)
    return ranked.withColumn(out, F.col("_rn") + F.col("_before")).drop("_h", "_rn", "_before", *keys)


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows with the smallest digests."""
    return df.withColumn("_h", stable_key(key, seed=seed)).orderBy("_h", key).limit(n).drop("_h")


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """n rows per stratum (all of a smaller one), shuffled and numbered from 1."""
    h = df.withColumn("_h", stable_key(key, seed=seed))
    head = first_n(h, n, [stratum], ["_h", key]).drop("_rn", "_h")
    shuffled = Window.orderBy(stable_key(key, seed=seed + 1), key)  # n rows per stratum
    return head.withColumn("item", F.row_number().over(shuffled))


def blind_sheet(sample: DataFrame, text: str = "body", community: str = "subreddit") -> DataFrame:
    """What raters see: no score, empty answer columns."""
    empty = F.lit(None).cast("string")
    return sample.select(
        "item", F.col(text).alias("text"), F.col(community).alias("subreddit"),
        empty.alias("your_score"), empty.alias("reasoning"), empty.alias("confidence"),
    )


def answer_key(sample: DataFrame, key: str, score: str, extra: Sequence[str] = ()) -> DataFrame:
    return sample.select("item", key, score, *extra)


def train_test(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first ``round(share · n)`` of every class by digest."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = hash_rank(df, key, [label], seed)
    joined = ranked.join(F.broadcast(sizes), label)  # one row per class
    return joined.withColumn("is_test", F.col("rank") <= F.round(F.col("_n") * test_share)).drop("_n", "rank")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0…k-1, balanced within every class."""
    return hash_rank(df, key, [label], seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")


def shuffled_column(df: DataFrame, key: str, column: str, seed: int = 42) -> DataFrame:
    """Permutes one column over all rows: row i by one digest gets the value of row i by another."""
    target = hash_rank(df, key, seed=seed, out="_i").drop(column)
    source = hash_rank(df.select(key, column), key, seed=seed + 7919, out="_i").select("_i", column)
    return target.join(source, "_i").drop("_i")
