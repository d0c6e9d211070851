"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every id in ``edges``, ``root`` the smallest id that its component holds.

    A round maps the edges to stars around smaller ids; it ends when a round changes nothing, after a number of rounds
    that grows with the logarithm of the largest component.  Hot ids are joined, never gathered.
    """
    current = written(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v")).distinct(), "edges")
    state = None
    while True:
        current = written(_small_star(_large_star(current)).distinct(), "edges")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    pairs = current.select(F.col("u").alias("id"), F.col("v").alias("root"))
    roots = current.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return pairs.unionByName(roots)
