"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions alone.

Every source is a queue of its documents in hash order, repeated up to ``epochs`` times.  A document's virtual finish time
is the size its queue has sent with it, divided by the source's target.  All queues are served in order of finish time and
the service stops at the total budget.

Running sums never gather a source in one task: documents fall into hash slices, a slice's sum before it comes from the
summary (source, slice), and only documents of one slice are ordered together.  The service order works the same way on
slices of virtual time.

Defined results: a null text has size 0 and a null source is a source of its own, the last; rows that share source and
document id are one unit of the queue (their sizes are added, they are taken together); documents of size 0 are never
taken; an empty table gives an empty result; further columns of the documents stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortlens.llm.shared import words_of, written


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """One row per source: size, weight and target.

    Weights repeat over the sources in code point order, null last.  Targets share the total size by weight; none is
    over ``epochs`` times its source's size, what is cut off is shared by the others (the level at which all
    uncapped sources have equal target per weight).  The windows see one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", epochs * F.col("source_size"))
    full = Window.orderBy((F.col("cap") / F.col("weight")), F.col("_rank"))
    upto = full.rowsBetween(Window.unboundedPreceding, -1)
    whole = full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    levels = ranked.withColumn("level", left / weights_left)
    # the sources before the first whose cap is above the level are at their caps
    open_level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(whole)
    target = F.least(F.coalesce(open_level, F.lit(0.0)) * F.col("weight"), F.col("cap").cast("double"))
    return levels.withColumn("target", target).select("source", "source_size", "weight", "target")


def queue(docs: DataFrame, seed: int = 42, slices: int = 4096) -> DataFrame:
    """Units (source, doc_id) with size and the size their source has sent when they are through once."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    units = docs.groupBy("source", "doc_id").agg(F.sum("size").alias("size")).where(F.col("size") > 0)
    units = units.withColumn("_key", key)
    units = units.withColumn("_slice", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % slices).cast("int"))
    sums = units.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    units = units.withColumn("_upto", F.sum("size").over(inner))
    same = units["source"].eqNullSafe(sums["source"]) & (units["_slice"] == sums["_slice"])
    return units.join(sums, same).select(units["source"], "doc_id", "size", "_key", (F.col("_before") + F.col("_upto")).alias("sent"))


def schedule(units: DataFrame, targets: DataFrame, epochs: int = 3, slices: int = 4096) -> DataFrame:
    """Units served before the budget ends: (source, doc_id, epoch, finish, served), ``served`` the size sent before."""
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_budget"))
    t = targets.select(F.col("source").alias("_source"), "source_size", "target").where("target > 0")
    items = units.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    items = items.withColumn("epoch", F.explode(F.array(*[F.lit(k) for k in range(epochs)])))
    items = items.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("sent")) / F.col("target"))
    # all targets are met about finish time 1; from 2 on the slices widen with the time, so there are few
    late = 2 * slices + F.floor(64 * F.log2("finish"))
    items = items.withColumn("_slice", F.when(F.col("finish") < 2, F.floor(F.col("finish") * slices)).otherwise(late).cast("int"))
    sums = items.groupBy("_slice").agg(F.sum("size").alias("_sum"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_slice", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    sums = sums.crossJoin(budget).where("_before < _budget")  # one row
    # at most 2 x slices + 64 x 1024 rows: a double has 11 bits of exponent; slices behind the cut go before the shuffle
    items = items.join(F.broadcast(sums), "_slice")
    order = Window.partitionBy("_slice").orderBy("finish", "_key", F.col("source").asc_nulls_last(), "doc_id", "epoch")
    items = items.withColumn("_upto", F.col("_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = items.where("_upto <= _budget")
    return taken.select("source", "doc_id", "epoch", "finish", (F.col("_upto") - F.col("size")).alias("served"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", words_of(F.col(text)).alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 42, slices: int = 4096) -> DataFrame:
    """How often each (source, doc_id) is taken: source, doc_id, copies, first_served."""
    return _taken(written(sized(docs), "sizes"), weights, epochs, seed, slices)


def _taken(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 42, slices: int = 4096) -> DataFrame:
    served = schedule(queue(sizes, seed, slices), source_targets(sizes, weights, epochs), epochs, slices)
    return served.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("copies"), F.min("served").alias("first_served"))


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    sizes = written(sized(docs), "sizes")  # the texts are read once
    taken = _taken(sizes, **options).select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), "copies", "first_served")
    targets = source_targets(sizes, options.get("weights", (1, 2, 3)), options.get("epochs", 3)).withColumnRenamed("source", "_t")
    out = sizes.join(taken, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    out = out.join(targets, F.col("source").eqNullSafe(F.col("_t")))
    return out.select("doc_id", "size", "source_size", "target", (F.coalesce("copies", F.lit(0)) * F.col("size")).alias("taken"), "first_served")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    names = docs.columns
    hidden = docs.toDF(*[f"_{i}_{c}" for i, c in enumerate(names)])
    source, key = (F.col(hidden.columns[names.index(c)]) for c in ("source", "doc_id"))
    taken = mix(docs, **options).select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("copies").alias("_copies"))
    out = hidden.join(taken, source.eqNullSafe(F.col("_s")) & key.eqNullSafe(F.col("_d")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*hidden.columns).toDF(*names)
