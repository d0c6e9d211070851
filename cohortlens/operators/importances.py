"""What a fitted model loses on held-out rows when one of its columns is permuted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from cohortlens.operators import sampling as SM
from cohortlens.operators.classify import Stack, assembled


def predictions(model, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with ``prediction``, from a ``Stack``, from a pipeline with its own assembler or from a model of a feature vector."""
    own = isinstance(model, Stack) or isinstance(model, PipelineModel) and any(isinstance(s, VectorAssembler) for s in model.stages)
    return model.transform(df if own else assembled(df, cols))


def permuted(test: DataFrame, cols: Sequence[str], key: str, label: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """Rows (feature, rep, label, cols...): the rows as they are (feature null) and, per feature and repeat, with that column permuted.

    Row number i by one digest takes its value from row number i by the digest of the repeat, so that the permutation is the
    same under any partitioning; both numberings are counted in slices of the digest space.
    """
    row = F.struct(*cols)
    rows = test.select(key, F.col(label).alias("_label"), row.alias("_own"))
    reps = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")
    target = SM.hash_rank(rows, key, seed=seed, out="_i").select("_i", "_label", "_own", reps)
    source = rows.select(F.col(key).cast("string").alias("_key"), F.col("_own").alias("_other"), reps)
    source = source.withColumn("_key", F.concat_ws(":", F.col("rep").cast("string"), "_key"))
    source = SM.hash_rank(source.select("rep", "_key", "_other"), "_key", ["rep"], seed + 7919, "_i").select("rep", "_i", "_other")
    pairs = target.join(source, ["rep", "_i"])
    feature = F.explode(F.array(*map(F.lit, cols))).alias("feature")
    values = [F.when(F.col("feature") == c, F.col(f"_other.`{c}`")).otherwise(F.col(f"_own.`{c}`")).alias(c) for c in cols]
    shuffled = pairs.select("rep", "_label", "_own", "_other", feature).select("feature", "rep", "_label", *values)
    whole = rows.select(F.lit(None).cast("string").alias("feature"), F.lit(-1).alias("rep"), "_label", *[F.col(f"_own.`{c}`").alias(c) for c in cols])
    return whole.unionByName(shuffled).withColumnRenamed("_label", label)


def macro_f1(scored: DataFrame, by: Sequence[str], label: str, prediction: str = "prediction") -> DataFrame:
    """(by..., macro_f1) over the classes that occur as label or prediction."""
    counts = scored.groupBy(*by, F.col(label).cast("double").alias("_l"), F.col(prediction).cast("double").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    right = F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.explode(F.array(
        F.struct(F.col("_l").alias("class"), right.cast("long").alias("hit"), F.col("_n").alias("either")),
        F.struct(F.col("_p").alias("class"), zero.alias("hit"), F.col("_n").alias("either")),
    )).alias("s")
    per = counts.select(*by, sides).groupBy(*by, "s.class").agg(F.sum("s.hit").alias("_hit"), F.sum("s.either").alias("_either"))
    return per.groupBy(*by).agg(F.avg(2 * F.col("_hit") / F.col("_either")).alias("macro_f1"))


def permutation_importance(model, test: DataFrame, cols: Sequence[str], key: str, label: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance, sd): loss of macro F1 on ``test`` with the feature permuted, its mean and deviation over repeats.

    ``model`` is fitted and stays as it is; ``test`` holds rows it has not seen.  All features and repeats are one table,
    scored in one job; only class counts are gathered.
    """
    rows = permuted(test.where(F.col(label).isNotNull()), cols, key, label, repeats, seed)
    f1 = macro_f1(predictions(model, rows, cols), ["feature", "rep"], label)
    base = f1.where("feature IS NULL").select(F.col("macro_f1").alias("_base"))
    loss = F.col("_base") - F.col("macro_f1")
    out = f1.where("feature IS NOT NULL").join(F.broadcast(base))  # one row
    return out.groupBy("feature").agg(F.avg(loss).alias("importance"), F.stddev_pop(loss).alias("sd"))
