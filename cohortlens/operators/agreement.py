"""Agreement between raters, methods and score versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.operators import ranks
from cohortlens.operators.rollup import first_n


def kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa, unweighted, linear and quadratic where the ratings are numbers.

    From the confusion counts: agreement by chance is the product of the two marginal distributions,
    built as one row per category.  All-constant ratings give 1.
    """
    rated = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    conf = rated.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    numeric = all(t in ("int", "bigint", "double", "smallint", "float") for c, t in df.dtypes if c in (a, b))
    gap = F.abs(F.col(a) - F.col(b)).cast("double") if numeric else F.lit(None).cast("double")
    seen = conf.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("_agree"),
        F.sum(F.col("n") * gap).alias("_gap1"),
        F.sum(F.col("n") * gap * gap).alias("_gap2"),
        F.sum(F.when(gap <= 1, F.col("n")).otherwise(0)).alias("_near"),
    )
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col(a).alias("v"), F.col("n").alias("ra"), zero.alias("rb")),
        F.struct(F.col(b).alias("v"), zero.alias("ra"), F.col("n").alias("rb")),
    )
    cats = conf.select(*by, F.explode(sides).alias("s")).groupBy(*by, F.col("s.v").alias("v")).agg(
        F.sum("s.ra").alias("ra"), F.sum("s.rb").alias("rb")
    )
    ra, rb = F.col("ra").cast("double"), F.col("rb").cast("double")
    aggs = [F.sum(ra * rb).alias("_chance")]
    if numeric:
        # E|i - j| over independent margins = sum over steps of Fa(1 - Fb) + Fb(1 - Fa), step width included
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("v")  # one row per category
        part = Window.partitionBy(*(by or [F.lit(0)]))
        v = F.col("v").cast("double")
        cats = cats.withColumns(
            {
                "_fa": F.sum("ra").over(w) / F.sum("ra").over(part),
                "_fb": F.sum("rb").over(w) / F.sum("rb").over(part),
                "_step": F.coalesce(F.lead("v").over(w).cast("double") - v, F.lit(0.0)),
            }
        )
        aggs += [
            F.sum(F.col("_step") * (F.col("_fa") * (1 - F.col("_fb")) + F.col("_fb") * (1 - F.col("_fa")))).alias("_e1"),
            (
                F.sum(ra * v * v) / F.sum(ra)
                - 2 * F.sum(ra * v) / F.sum(ra) * F.sum(rb * v) / F.sum(rb)
                + F.sum(rb * v * v) / F.sum(rb)
            ).alias("_e2"),
        ]
    chance = cats.groupBy(*by).agg(*aggs)
    s = seen.join(chance, list(by)) if by else seen.join(F.broadcast(chance))  # one row each
    n = F.col("n").cast("double")
    po, pe = F.col("_agree") / n, F.col("_chance") / (n * n)
    out = {
        "exact": po,
        "kappa": F.when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe)),
    }
    if numeric:
        out |= {
            "within_1": F.col("_near") / n,
            "mean_abs_diff": F.col("_gap1") / n,
            "kappa_linear": F.when(F.col("_e1") == 0, 1.0).otherwise(1 - F.try_divide(F.col("_gap1") / n, F.col("_e1"))),
            "kappa_quadratic": F.when(F.abs("_e2") < 1e-12, 1.0).otherwise(1 - F.try_divide(F.col("_gap2") / n, F.col("_e2"))),
        }
    return s.select(*by, "n", *[c.alias(k) for k, c in out.items()])


def pair_rows(wide: DataFrame, columns: Mapping[str, str], ids: Sequence[str] = ()) -> DataFrame:
    """Two chosen columns per row: the pairs are pairs of columns, fixed by their number."""
    pairs = F.array(
        *[
            F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), F.col(columns[x]).alias("a"), F.col(columns[y]).alias("b"))
            for x, y in combinations(columns, 2)
        ]
    )
    return wide.select(*ids, F.explode(pairs).alias("_p")).select(*ids, "_p.*")


def pairwise_kappa(wide: DataFrame, columns: Mapping[str, str], min_n: int = 1) -> DataFrame:
    """Agreement of every pair of raters or methods held in columns."""
    return kappa(pair_rows(wide, columns), "a", "b", ["first", "second"]).where(F.col("n") >= min_n)


def pairwise_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("exact").alias("mean_exact"), F.avg("kappa").alias("mean_kappa")
    )


def kappa_matrix(wide: DataFrame, columns: Mapping[str, str], min_n: int = 11) -> DataFrame:
    """Long symmetric matrix with a unit diagonal; pairs with too few items are null."""
    upper = pairwise_kappa(wide, columns).select(
        "first", "second", F.when(F.col("n") >= min_n, F.col("kappa")).alias("kappa")
    )
    lower = upper.select(F.col("second").alias("first"), F.col("first").alias("second"), "kappa")
    names = F.array(*[F.lit(k) for k in columns])
    diagonal = wide.agg(F.count(F.lit(1)).alias("_n")).select(F.explode(names).alias("first")).select(
        "first", F.col("first").alias("second"), F.lit(1.0).alias("kappa")
    )
    return upper.unionByName(lower).unionByName(diagonal)


def consensus(wide: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Mean of the available raters rounded half to even, their number and spread."""
    scores = F.filter(F.array(*[F.col(r) for r in raters]), lambda x: x.isNotNull())
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / n
    return wide.withColumn("n_raters", n).withColumns(
        {
            "consensus_mean": F.when(F.col("n_raters") > 0, mean),
            "spread": F.when(F.col("n_raters") > 0, F.array_max(scores) - F.array_min(scores)),
        }
    ).withColumn("consensus", F.bround("consensus_mean", 0).cast("int"))


def against_consensus(rated: DataFrame, algorithm: str = "algorithm") -> DataFrame:
    """Exact and near agreement of an algorithm with the consensus, bias and its label."""
    d = F.col(algorithm) - F.col("consensus")
    s = rated.where(d.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((d == 0).cast("double")).alias("exact"),
        F.avg((F.abs(d) <= 1).cast("double")).alias("within_1"),
        F.avg(d).alias("bias"),
        F.avg(F.abs(d)).alias("mean_abs_error"),
    )
    label = (
        F.when(F.col("bias") > 0.3, "algorithm_overscores")
        .when(F.col("bias") < -0.3, "algorithm_underscores")
        .otherwise("roughly_aligned")
    )
    return s.withColumn("direction", label)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    ok = F.col(truth).isNotNull() & F.col(predicted).isNotNull()
    return df.where(ok).groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def high_disagreement(rated: DataFrame, algorithm: str = "algorithm", gap: int = 2, item: str = "item") -> DataFrame:
    d = F.col(algorithm) - F.col("consensus")
    return rated.withColumn("difference", d).where(F.abs("difference") >= gap).orderBy(F.desc(F.abs("difference")), item)


def calibration_examples(rated: DataFrame, per_score: int, algorithm: str = "algorithm", item: str = "item") -> DataFrame:
    """Items the raters agree on, a quota per consensus score: more raters first, then algorithm wrong."""
    ok = rated.where((F.col("n_raters") >= 2) & (F.col("spread") <= 1) & F.col(algorithm).isNotNull())
    ok = ok.withColumn("algorithm_correct", F.abs(F.col(algorithm) - F.col("consensus")) <= 1)
    return first_n(ok, per_score, ["consensus"], [F.desc("n_raters"), F.col("algorithm_correct"), F.col(item)]).drop("_rn")


def method_comparison(df: DataFrame, truth: str, methods: Mapping[str, str]) -> DataFrame:
    """Coverage of every method, and its accuracy and kappa where the truth is known."""
    rows = F.array(*[F.struct(F.lit(k).alias("method"), F.col(c).alias("label")) for k, c in methods.items()])
    long = df.select(F.col(truth).alias("truth"), F.explode(rows).alias("m")).select("truth", "m.*")
    cover = long.groupBy("method").agg(
        F.count("label").alias("n_classified"), F.avg(F.col("label").isNotNull().cast("double")).alias("coverage")
    )
    k = kappa(long, "truth", "label", ["method"]).select("method", F.col("n").alias("n_truth"), F.col("exact").alias("accuracy"), "kappa")
    return cover.join(k, "method", "left")


def version_comparison(df: DataFrame, old: str, new: str) -> DataFrame:
    """Paired statistics of two score versions, one row."""
    d = F.col(new) - F.col(old)
    ok = df.where(F.col(old).isNotNull() & F.col(new).isNotNull())
    s = ok.agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{name}_{k}") for k, c in (("old", old), ("new", new))
          for name, f in (("mean", F.avg), ("sd", F.stddev_samp))],
        F.avg((d == 0).cast("double")).alias("exact"),
        F.avg((F.abs(d) <= 1).cast("double")).alias("within_1"),
        F.count_if(d > 0).alias("raised"),
        F.count_if(d < 0).alias("lowered"),
        F.count_if(d == 0).alias("same"),
        F.try_divide(F.avg(d), F.stddev_samp(d)).alias("d_paired"),
    )
    for k, c in (("old", old), ("new", new)):
        s = s.join(F.broadcast(ranks.medians(ok, c, out=f"median_{k}")), how="left")  # one row
    return s.withColumns(
        {f"pct_{k}": F.try_divide(F.col(k) * 100, F.col("n")) for k in ("raised", "lowered")}
    )


def version_levels(df: DataFrame, versions: Mapping[str, str], levels: Sequence[int]) -> DataFrame:
    """Count and share of each score level per version."""
    from cohortlens.operators.rollup import level_distribution

    long = df.unpivot([], [F.col(c).alias(k) for k, c in versions.items()], "version", "score")
    return level_distribution(long.where(F.col("score").isNotNull()), "score", levels, ["version"])


def divergence(df: DataFrame, old: str, new: str, by: str) -> DataFrame:
    """Where two versions part: mean shift, big drops and gains, the 2 → 1 shift, by group and over all."""
    d = F.col(new) - F.col(old)
    valid = df.where((F.col(old) > 0) & (F.col(new) > 0))
    return valid.rollup(by).agg(
        F.grouping(by).alias("is_total"),
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("mean_diff"),
        F.avg(old).alias("old_mean"),
        F.avg(new).alias("new_mean"),
        F.count_if(d <= -2).alias("big_drops"),
        F.count_if(d >= 2).alias("big_gains"),
        F.count_if((F.col(old) == 2) & (F.col(new) == 1)).alias("shift_2_to_1"),
    )


def divergent_samples(df: DataFrame, old: str, new: str, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """n hash-drawn rows of the big drops and of the big gains, for reading."""
    from cohortlens.functions.hashing import stable_key

    d = F.col(new) - F.col(old)
    valid = df.where((F.col(old) > 0) & (F.col(new) > 0))
    tagged = valid.withColumn("kind", F.when(d <= -2, "drop").when(d >= 2, "gain")).where(F.col("kind").isNotNull())
    return first_n(tagged.withColumn("_h", stable_key(key, seed=seed)), n, ["kind"], ["_h", key]).drop("_h", "_rn")


def attribution_impact(df: DataFrame, old: str, new: str, classes: Mapping[str, Column]) -> DataFrame:
    """Score change by (overlapping) classes of comments."""
    valid = df.where((F.col(old) > 0) & (F.col(new) > 0))
    wide = valid.agg(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("class"),
                    F.count_if(c).alias("n"),
                    F.coalesce(F.avg(F.when(c, F.col(old))), F.lit(0.0)).alias("old_mean"),
                    F.coalesce(F.avg(F.when(c, F.col(new))), F.lit(0.0)).alias("new_mean"),
                    F.coalesce(F.avg(F.when(c, F.col(new) - F.col(old))), F.lit(0.0)).alias("mean_diff"),
                )
                for k, c in classes.items()
            ]
        ).alias("r")
    )
    return wide.select(F.explode("r").alias("r")).select("r.*")


def threshold_scale_accuracy(df: DataFrame, score: str, truth: str, cuts: Sequence[float], labels: Sequence[str],
                             scales: Sequence[float]) -> DataFrame:
    """Accuracy of score buckets when every cut is scaled; one scan for all scales."""
    from cohortlens.functions.scalar import cut

    def one(k: float) -> Column:
        called = cut(F.col(score), [c * k for c in cuts], labels)
        known = called.isNotNull() & F.col(truth).isNotNull()
        return F.struct(
            F.lit(float(k)).alias("threshold_scale"),
            F.avg(F.when(known, (called == F.col(truth)).cast("double"))).alias("accuracy"),
            F.count(called).alias("n_classified"),
        )

    return df.agg(F.array(*[one(k) for k in scales]).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def hit_diagnostic(df: DataFrame, features: Sequence[str], score: str) -> DataFrame:
    """Share of rows with a hit, and mean score with and without one, per feature."""
    long = df.unpivot([score], [F.col(f).cast("double").alias(f) for f in features], "feature", "v")
    hit = F.coalesce(F.col("v"), F.lit(0.0)) > 0
    s = long.groupBy("feature").agg(
        F.count_if(hit).alias("n_hit"),
        F.avg(hit.cast("double")).alias("hit_share"),
        F.avg(F.when(hit, F.col(score))).alias("mean_hit"),
        F.avg(F.when(~hit, F.col(score))).alias("mean_no_hit"),
    )
    return s.withColumn("difference", F.col("mean_hit") - F.col("mean_no_hit"))


def replication(main: DataFrame, confirm: DataFrame, score: str = "score") -> DataFrame:
    """Score distribution of both samples and the effect size of their difference."""
    from cohortlens.operators.groups import effect_size, two_groups

    both = main.select(score).withColumn("sample", F.lit("main")).unionByName(
        confirm.select(score).withColumn("sample", F.lit("confirmatory"))
    )
    s = F.col(score)
    shares = both.groupBy("sample").agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"),
        F.avg((s == 1).cast("double")).alias("share_1"), F.avg((s >= 4).cast("double")).alias("share_4plus"),
    )
    d = effect_size(two_groups(both, "sample", "main", "confirmatory", score)).select("d", "d_label")
    return shares.join(F.broadcast(d))  # one row
