"""Contingency tables: chi-squared, association, odds ratios, classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions import cdf
from cohortlens.operators.rollup import wilson


def chi2_2x2(t: DataFrame, a: str = "a", b: str = "b", c: str = "c", d: str = "d", p_value: bool = True) -> DataFrame:
    """Yates-corrected chi-squared of a 2×2 table in four columns, 0 when a margin is empty."""
    x = {k: F.col(v).cast("double") for k, v in zip("abcd", (a, b, c, d))}
    n = sum(x.values(), F.lit(0.0))
    det = x["a"] * x["d"] - x["b"] * x["c"]
    margins = (x["a"] + x["b"]) * (x["c"] + x["d"]) * (x["a"] + x["c"]) * (x["b"] + x["d"])
    # the correction never moves a count past its expectation
    core = F.greatest(F.abs(det) - n / 2, F.lit(0.0))
    out = t.withColumns(
        {
            "chi2": F.coalesce(F.try_divide(n * core * core, margins), F.lit(0.0)),
            "chi2_uncorrected": F.coalesce(F.try_divide(n * det * det, margins), F.lit(0.0)),
        }
    ).withColumn("cramers_v", F.sqrt(F.try_divide(F.col("chi2"), n)))
    return out.withColumn("p", cdf.p_chi2("chi2", 1.0)) if p_value else out


def chi2_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two categorical columns: one row.

    A 2×2 table gets the continuity correction (each |O − E| is lowered by at most one half).
    """
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))  # products of counts leave 64 bits
    whole = Window.partitionBy(F.lit(0))  # levels × levels rows
    c = counts.withColumns(
        {
            "_r": F.sum("n").over(Window.partitionBy(a)),
            "_c": F.sum("n").over(Window.partitionBy(b)),
            "_n": F.sum("n").over(whole),
        }
    )
    e = F.col("_r") * F.col("_c") / F.col("_n")
    # absent cells have O = 0: their expectations add what the present ones leave of the total
    s = c.agg(
        F.max("_n").alias("n"),
        F.count_distinct(a).alias("rows"),
        F.count_distinct(b).alias("columns"),
        (F.sum(F.col("n") * F.col("n") / e) - F.max("_n")).alias("chi2_uncorrected"),
        F.max(F.abs(F.col("n") - e)).alias("_dev"),
        F.sum(1 / e).alias("_inv"),
        F.count(F.lit(1)).alias("_cells"),
    )
    two = (F.col("rows") == 2) & (F.col("columns") == 2)
    # in a 2×2 table all |O − E| are equal; with an absent cell the sum of 1/E lacks its term
    full = F.when(F.col("_cells") == 4, F.col("_inv"))
    yates = F.pow(F.greatest(F.col("_dev") - 0.5, F.lit(0.0)), 2) * full
    yates = F.coalesce(yates, F.col("chi2_uncorrected") * F.pow(F.greatest(F.col("_dev") - 0.5, F.lit(0.0)) / F.col("_dev"), 2))
    s = s.withColumns(
        {
            "dof": ((F.col("rows") - 1) * (F.col("columns") - 1)).cast("double"),
            "chi2": F.when(two, yates).otherwise(F.col("chi2_uncorrected")),
        }
    )
    dim = F.least("rows", "columns") - 1
    s = s.withColumn("cramers_v", F.coalesce(F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * dim)), F.lit(0.0)))
    return s.withColumn("p", cdf.p_chi2("chi2", "dof")).drop("_dev", "_inv", "_cells")


def odds_table(df: DataFrame, group: str, a, b, outcome: Column, by: Sequence[str] = ()) -> DataFrame:
    """Prevalence per group with Wilson limits, prevalence ratio, odds ratio plain and with 0.5 added."""
    hit = outcome
    ga, gb = F.col(group) == a, F.col(group) == b
    t = df.where(F.col(group).isin(a, b)).groupBy(*by).agg(
        F.count_if(ga & hit).alias("a"), F.count_if(ga & ~hit).alias("b"),
        F.count_if(gb & hit).alias("c"), F.count_if(gb & ~hit).alias("d"),
    )
    x = {k: F.col(k).cast("double") for k in "abcd"}
    lo_a, hi_a = wilson(x["a"], x["a"] + x["b"])
    lo_b, hi_b = wilson(x["c"], x["c"] + x["d"])
    t = t.withColumns(
        {
            "rate_a": F.try_divide(x["a"], x["a"] + x["b"]),
            "rate_b": F.try_divide(x["c"], x["c"] + x["d"]),
            "low_a": lo_a, "high_a": hi_a, "low_b": lo_b, "high_b": hi_b,
            "odds_ratio": F.try_divide(x["a"] * x["d"], x["b"] * x["c"]),
            "odds_ratio_corrected": (x["a"] + 0.5) * (x["d"] + 0.5) / ((x["b"] + 0.5) * (x["c"] + 0.5)),
        }
    ).withColumn("rate_ratio", F.try_divide("rate_a", "rate_b"))
    return chi2_2x2(t)


# ---- classifiers ----------------------------------------------------------------------------


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    conf = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    t, p = F.col(truth), F.col(predicted)
    parts = conf.select(
        F.explode(
            F.array(
                F.struct(t.alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                         F.when(t == p, F.col("n")).otherwise(0).alias("correct")),
                F.struct(p.alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                         F.lit(0).cast("long").alias("correct")),
            )
        ).alias("s")
    ).select("s.*").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "correct")])
    zero = F.lit(0.0)
    parts = parts.withColumns(
        {
            "precision": F.coalesce(F.try_divide("correct", "called"), zero),
            "recall": F.coalesce(F.try_divide("correct", "support"), zero),
        }
    )
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return parts.withColumn("f1", F.coalesce(f1, zero))


def overall_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    m = class_metrics(df, truth, predicted)
    n = F.sum("support")
    return m.agg(
        n.alias("n"),
        (F.sum("correct") / n).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.avg("recall").alias("macro_recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
    )


def roc_points(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """True and false positive rates at every distinct score, from running sums of the histogram."""
    from cohortlens.operators import ranks

    tagged = df.withColumn("_pos", positive)
    hist = ranks.histogram(tagged, score, weights={"p": F.count_if(F.col("_pos")), "q": F.count_if(~F.col("_pos"))})
    r = ranks.running(hist, score, ["p", "q"])
    return r.select(
        F.col(score).alias("threshold"),
        ((F.col("all_p") - F.col("before_p")) / F.col("all_p")).alias("tpr"),
        ((F.col("all_q") - F.col("before_q")) / F.col("all_q")).alias("fpr"),
    )


def auroc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the curve as the superiority probability of positive scores."""
    from cohortlens.operators.groups import rank_tests

    tagged = df.withColumn("_pos", positive)
    return rank_tests(tagged, "_pos", True, False, score).select(
        F.col("cles").alias("auroc"), F.col("n_a").alias("n_positive"), F.col("n_b").alias("n_negative")
    )


def feature_table(df: DataFrame, label: str, a, b, features: Sequence[str]) -> DataFrame:
    """Mean and deviation per class, pooled t-test per feature."""
    from cohortlens.operators.groups import student, two_groups

    long = df.unpivot([label], [F.col(f).cast("double").alias(f) for f in features], "feature", "v")
    return student(two_groups(long, label, a, b, "v", ["feature"])).withColumn("significant", F.col("p") < 0.05)
