"""Join shapes of the analysis.

Strategies are left to the planner: AQE turns a side into a broadcast only when its measured size is below
the threshold, and splits skewed partitions of a sort-merge join otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def with_metadata(scores: DataFrame, comments: DataFrame, columns: Sequence[str] = ("author", "subreddit"),
                  key: str = "id") -> DataFrame:
    """Scores keep all rows; ids compare as strings."""
    right = comments.select(F.col(key).cast("string").alias(key), *columns)
    return scores.withColumn(key, F.col(key).cast("string")).join(right, key, "left")


def star(users: DataFrame, parts: Mapping[str, tuple[DataFrame, Mapping[str, str]]], key: str = "author") -> DataFrame:
    """Left joins on one key; each part selects and renames its columns.

    All joins share the key, so the fact side is shuffled once.
    """
    out = users
    for df, columns in parts.values():
        out = out.join(df.select(key, *[F.col(c).alias(n) for c, n in columns.items()]), key, "left")
    return out


def feature_union(blocks: Sequence[DataFrame], key: str = "author", fill: float = 0.0) -> DataFrame:
    """Full outer join of feature blocks, missing features as a constant."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.join(b, key, "full_outer")
    return out.na.fill(fill, [c for c in out.columns if c != key])


def restrict(df: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    return df.join(allowed.select(key), key, "left_semi")


def rater_table(ratings: DataFrame, raters: Sequence[str], item: str = "item", rater: str = "rater",
                score: str = "score", reference: DataFrame | None = None) -> DataFrame:
    """One row per item with one column per rater; items may be missing from any side.

    A pivot with known raters needs one shuffle and no self-join; pairs of raters are then columns.
    """
    wide = ratings.groupBy(item).pivot(rater, list(raters)).agg(F.min(score))
    if reference is not None:
        wide = wide.join(reference.select(item, F.col(score).alias("algorithm")), item, "full_outer")
    return wide
