"""Clusters by density, without a number of clusters: rows in no dense place are noise (-1).

A neighbour graph from random-projection trees gives every point its core distance (to the neighbour that completes
``neighbours`` points) and edges of mutual reachability; Boruvka rounds leave a minimum spanning forest; cutting it at a row
of distances gives nested clusters, and those are chosen that keep the most points over the widest range of density
(excess of mass).  Every step is joins and aggregates over points, edges or clusters; a task sees one leaf of a tree.

Equal vectors are one point with a weight, so copies never fill a leaf.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.session import ensure_checkpoint_dir

#: Trees have at most this many nodes on the levels whose marks are broadcast.
BROADCAST_LEVELS = 14
LEVELS = 64  # room for the level in the number of a (point, level) pair


def kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder, read again.

    ``checkpoint()`` keeps the estimated size of the plan; a join multiplies those of its sides, so in loops the number doubles its
    digits each round until the driver does nothing but multiply it.  A table has its own size.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/density-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _projection(vector: Column, size: int, seed: int) -> Column:
    """Length along a direction that tree, node and seed decide."""
    along = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.xxhash64(F.lit(seed), "tree", "node", j) / F.lit(2.0**63))
    return F.aggregate(F.zip_with(vector, along, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def leaves(points: DataFrame, trees: int, leaf: int, seed: int = 42) -> DataFrame:
    """(tree, node, id, v): every point in one leaf of each tree; nodes are halved at the median until about ``leaf`` points are left."""
    head = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size")).first()
    state = points.select("id", "v", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"), F.lit(1).cast("long").alias("node"))
    for level in range(max(0, math.ceil(math.log2(max(head["n"], 1) / leaf)))):
        state = kept(state.withColumn("p", _projection(F.col("v"), head["size"], seed)))
        middle = state.groupBy("tree", "node").agg(F.percentile_approx("p", 0.5, 1000).alias("middle"))
        middle = F.broadcast(middle) if level <= BROADCAST_LEVELS else middle  # trees * 2^level rows
        state = state.join(middle, ["tree", "node"]).select("id", "v", "tree", (2 * F.col("node") + (F.col("p") > F.col("middle")).cast("long")).alias("node"))
    return state


def neighbour_graph(points: DataFrame, k: int, trees: int = 4, leaf: int = 200, seed: int = 42) -> DataFrame:
    """(a, b, d): the ``k`` nearest points of each point among those that share a leaf with it."""

    def nearest(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        v = np.stack(group["v"].to_numpy(zero_copy_only=False)).astype(float)
        parts = []
        m = min(k, len(ids) - 1)
        for at in range(0, len(ids) if m > 0 else 0, 512):
            d = np.sqrt(np.maximum(0.0, ((v[at : at + 512, None, :] - v[None, :, :]) ** 2).sum(-1)) if len(ids) <= 4 * leaf else _distances(v[at : at + 512], v))
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            parts.append((np.repeat(ids[at : at + len(d)], m), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()))
        a, b, d = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "d": d})

    found = leaves(points, trees, leaf, seed).groupBy("tree", "node").applyInArrow(nearest, "a long, b long, d double")
    lists = found.groupBy("a").agg(F.array_sort(F.collect_set(F.struct("d", "b"))).alias("near"))  # at most trees * k
    return lists.select("a", F.explode(F.slice("near", 1, k)).alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.d").alias("d"))


def _distances(some: np.ndarray, all_: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (some**2).sum(1)[:, None] + (all_**2).sum(1)[None, :] - 2.0 * some @ all_.T)


def reachability_edges(points: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """(a, b, w) with a < b: the distance, or the core distance of either end if that is larger."""
    weight = points.select(F.col("id").alias("b"), F.col("weight").alias("wb"))
    near = graph.join(weight, "b").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("d", "wb"))).alias("near"))  # k entries
    near = near.join(points.select(F.col("id").alias("a"), "weight"), "a")
    start = F.struct(F.col("weight").alias("seen"), F.when(F.col("weight") >= k, 0.0).cast("double").alias("core"))
    step = lambda s, x: F.struct((s["seen"] + x["wb"]).alias("seen"), F.coalesce(s["core"], F.when(s["seen"] + x["wb"] >= k, x["d"])).alias("core"))
    core = near.select("a", F.coalesce(F.aggregate("near", start, step)["core"], F.element_at("near", -1)["d"]).alias("core"))
    both = graph.join(core, "a").join(core.select(F.col("a").alias("b"), F.col("core").alias("core_b")), "b")
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.greatest("d", "core", "core_b")).alias("w"))


def _roots(pointers: DataFrame) -> DataFrame:
    """(c, root): the end of each pointer's chain; a pair that points at each other ends at its smaller one."""
    back = pointers.select(F.col("c").alias("to"), F.col("to").alias("onward"))
    joined = pointers.join(back, "to", "left")
    at = kept(joined.select("c", F.when((F.col("onward") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to")))
    while True:
        nxt = at.select(F.col("c").alias("to"), F.col("to").alias("further"))
        jumped = kept(at.join(nxt, "to", "left").select("c", F.coalesce("further", "to").alias("to"), (F.coalesce("further", "to") != F.col("to")).alias("moved")))
        at = jumped.select("c", "to")
        if jumped.where("moved").isEmpty():
            return at.withColumnRenamed("to", "root")


def spanning_forest(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, w): the edges of a minimum spanning tree of every connected part (ties by the ends, so that there is one tree)."""
    label = points.select("id", F.col("id").alias("c"))
    live, tree = kept(edges.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))), None
    while not live.isEmpty():
        edge = F.struct("w", "a", "b", "ca", "cb")
        ends = live.select(F.explode(F.array("ca", "cb")).alias("c"), edge.alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        ends = kept(ends.select("c", "e.*").withColumn("to", F.when(F.col("c") == F.col("ca"), F.col("cb")).otherwise(F.col("ca"))))
        picked = ends.select("a", "b", "w").distinct()
        tree = picked if tree is None else tree.unionByName(picked)
        root = _roots(ends.select("c", "to"))
        live = live.join(root.select(F.col("c").alias("ca"), F.col("root").alias("ra")), "ca").join(root.select(F.col("c").alias("cb"), F.col("root").alias("rb")), "cb")
        live = kept(live.where("ra <> rb").select("a", "b", "w", F.col("ra").alias("ca"), F.col("rb").alias("cb")))
    return label.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w")).limit(0) if tree is None else tree


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node of the edges with the smallest node it is connected to, by alternating star operations."""
    current, state = kept(edges.select("u", "v").where("u <> v").distinct()), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        current = kept(small.distinct())
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return current
        state = now


def cut_distances(tree: DataFrame, steps: int = 16) -> list[float]:
    """Increasing distances to cut at: even in the logarithm, and shares of the edges."""
    shares = [0.05, 0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98, 0.99, 1.0]
    marks = tree.where("w > 0").agg(F.percentile_approx("w", shares, 10_000)).first()[0]
    if not marks:
        return [1.0]
    low, high = marks[0], marks[-1]
    even = [low * (high / low) ** (i / steps) for i in range(steps)] + [high]
    return sorted({float(x) for x in [*marks, *even]})


def nested_clusters(points: DataFrame, tree: DataFrame, cuts: list[float]) -> DataFrame:
    """(level, id, part): the connected part of every point when edges up to the level's distance stay."""
    level = F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))).alias("level")
    reach = F.element_at(F.array(*map(F.lit, cuts)), F.col("level") + 1)
    edges = tree.select("a", "b", "w", level).where(F.col("w") <= reach)
    number = lambda c: F.col(c) * LEVELS + F.col("level")
    joined = _stars(edges.select(number("a").alias("u"), number("b").alias("v")))
    part = joined.select((F.col("u") % LEVELS).cast("int").alias("level"), F.floor(F.col("u") / F.lit(LEVELS)).alias("id"), F.floor(F.col("v") / F.lit(LEVELS)).alias("part"))
    every = points.select("id", "weight", level)
    return every.join(part, ["level", "id"], "left").withColumn("part", F.coalesce("part", "id"))


def chosen_parts(parts: DataFrame, cuts: list[float], min_size: int, single: bool = False) -> DataFrame:
    """(level, part): clusters by excess of mass.

    A cluster lives from the level at which it stands apart down to where it splits in two of ``min_size`` or falls below it;
    what it holds over these levels is its stability, points times the density (1 / distance) that the levels span.  It is
    chosen if its stability is at least that of the best choice inside it.  Without ``single`` the cluster of all is not.
    """
    sizes = kept(parts.groupBy("level", "part").agg(F.sum("weight").alias("size")).where(F.col("size") >= min_size))
    above = parts.select((F.col("level") - 1).alias("level"), F.col("id").alias("part"), F.col("part").alias("parent"))
    sizes = kept(sizes.join(above, ["level", "part"], "left"))  # a part is named by one of its points
    tops, below = None, None
    for level, cut in enumerate(cuts):
        span = 1.0 / max(cut, 1e-300) - (1.0 / cuts[level + 1] if level + 1 < len(cuts) else 0.0)
        here = sizes.where(F.col("level") == level).select("part", "parent", "size", (F.col("size") * span).alias("mass"))
        if below is None:
            state = here.select("part", "parent", F.col("mass").alias("run"), F.lit(0.0).alias("inside"))
        else:
            best = F.greatest("run", "inside")
            child = below.groupBy("parent").agg(F.count(F.lit(1)).alias("k"), F.first("run").alias("one_run"), F.first("inside").alias("one_inside"), F.sum(best).alias("all_best"))
            joined = here.join(child.withColumnRenamed("parent", "part"), "part", "left")
            going_on = F.coalesce(F.col("k") == 1, F.lit(False))
            state = joined.select("part", "parent", (F.col("mass") + F.when(going_on, F.col("one_run")).otherwise(0.0)).alias("run"), F.when(going_on, F.col("one_inside")).otherwise(F.coalesce("all_best", F.lit(0.0))).alias("inside"))
        state = kept(state)
        last = level + 1 == len(cuts)
        peers = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0) if last else "parent"))
        if last:  # the parts of the last level meet in one cluster of all
            alone = state.count() == 1
            done = state.where(F.lit(single or not alone))
        else:
            done = state.withColumn("peers", peers).where("peers > 1 AND parent IS NOT NULL").drop("peers")
        done = done.where("run >= inside").select(F.lit(level).alias("level"), "part")
        tops = done if tops is None else tops.unionByName(done)
        below = state
    return tops


def density_clusters(df: DataFrame, key: str, vector: str, min_size: int = 50, neighbours: int = 15, trees: int = 4, leaf: int = 200,
                     single: bool = False, seed: int = 42) -> DataFrame:
    """(key, topic): topics from 0 by falling size, -1 for rows in none (null, empty or not finite vectors among them).

    With fewer than ``min_size`` rows all are -1.
    """
    usable = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(key, F.when(usable, F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    points = kept(rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("weight")).withColumn("id", F.monotonically_increasing_id()))
    graph = kept(neighbour_graph(points, neighbours, trees, leaf, seed))
    tree = kept(spanning_forest(points, kept(reachability_edges(points, graph, neighbours))))
    cuts = cut_distances(tree)
    parts = kept(nested_clusters(points, tree, cuts))
    inside = parts.join(chosen_parts(parts, cuts, min_size, single), ["level", "part"])
    topmost = inside.groupBy("id").agg(F.max(F.struct("level", "part")).alias("top")).select("id", "top.*")
    sizes = topmost.join(points.select("id", "weight"), "id").groupBy("level", "part").agg(F.sum("weight").alias("_n"), F.min("id").alias("_least"))
    numbered = sizes.withColumn("topic", (F.row_number().over(Window.orderBy(F.desc("_n"), "_least")) - 1).cast("int"))  # a row per cluster
    topic = topmost.join(numbered.select("level", "part", "topic"), ["level", "part"]).join(points.select("id", "v"), "id").select("v", "topic")
    return rows.join(topic, "v", "left").select(key, F.coalesce("topic", F.lit(-1)).alias("topic"))


def topics(df: DataFrame, key: str, vector: str, components: int = 5, **options) -> DataFrame:
    """``density_clusters`` of embeddings after reduction to ``components`` principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = kept(df.where(F.size(vector) > 0).select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v")))
    reduced = PCA(k=components, inputCol="_v", outputCol="_r").fit(data).transform(data).select(key, vector_to_array("_r").alias("_r"))
    return df.select(key).join(density_clusters(reduced, key, "_r", **options), key, "left").fillna(-1, ["topic"])
