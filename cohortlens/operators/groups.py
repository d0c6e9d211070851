"""Comparing groups: moments in one aggregate, the rest is arithmetic on one row per test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions import cdf, exact
from cohortlens.functions.scalar import d_label, fisher_z
from cohortlens.operators import ranks


def moments(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance")
    )


# ---- two groups -----------------------------------------------------------------------------


def two_groups(df: DataFrame, group: str, a, b, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, variance, sd of both groups side by side, one row per ``by``."""
    aggs = []
    for side, level in (("a", a), ("b", b)):
        v = F.when(F.col(group) == level, F.col(value).cast("double"))
        aggs += [F.count(v).alias(f"n_{side}"), F.avg(v).alias(f"mean_{side}"), F.var_samp(v).alias(f"var_{side}")]
    out = df.where(F.col(group).isin(a, b)).groupBy(*by).agg(*aggs)
    return out.withColumns(
        {
            "sd_a": F.sqrt("var_a"),
            "sd_b": F.sqrt("var_b"),
            "diff": F.col("mean_a") - F.col("mean_b"),
        }
    )


def welch(stats: DataFrame, p_value: bool = True) -> DataFrame:
    """Unequal variance t-test: ``t``, ``df`` and ``p``."""
    sa, sb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    out = stats.withColumns(
        {
            "t": F.try_divide(F.col("diff"), F.sqrt(sa + sb)),
            "df": F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)),
        }
    )
    return out.withColumn("p", cdf.p_t("t", "df")) if p_value else out


def _pooled_variance() -> Column:
    n1, n2 = F.col("n_a"), F.col("n_b")
    return F.try_divide((n1 - 1) * F.col("var_a") + (n2 - 1) * F.col("var_b"), n1 + n2 - 2)


def student(stats: DataFrame) -> DataFrame:
    """Equal variance t-test."""
    se = F.sqrt(_pooled_variance() * (1 / F.col("n_a") + 1 / F.col("n_b")))
    out = stats.withColumns(
        {"t": F.try_divide(F.col("diff"), se), "df": (F.col("n_a") + F.col("n_b") - 2).cast("double")}
    )
    return out.withColumn("p", cdf.p_t("t", "df"))


def effect_size(stats: DataFrame) -> DataFrame:
    """``d`` with small sample correction and its label, ``d_plain`` over the mean of the variances.

    A zero pooled deviation gives 0, fewer than two values in a group give null.
    """
    sd = F.sqrt(_pooled_variance())
    n = F.col("n_a") + F.col("n_b")
    d = F.when(sd == 0, 0.0).otherwise(F.try_divide(F.col("diff"), sd) * (1 - 3 / (4 * n - 9)))
    d = F.when((F.col("n_a") >= 2) & (F.col("n_b") >= 2), d)
    plain = F.try_divide(F.col("diff"), F.sqrt((F.col("var_a") + F.col("var_b")) / 2))
    return stats.withColumns({"d": d, "d_plain": plain}).withColumn("d_label", d_label(F.col("d")))


def group_test(df: DataFrame, group: str, a, b, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Welch test and effect size, with medians."""
    out = effect_size(welch(two_groups(df, group, a, b, value, by)))
    med = ranks.medians(df.where(F.col(group).isin(a, b)), value, [*by, group])
    wide = med.groupBy(*by).agg(
        F.max(F.when(F.col(group) == a, F.col("median"))).alias("median_a"),
        F.max(F.when(F.col(group) == b, F.col("median"))).alias("median_b"),
    )
    return out.join(wide, list(by)) if by else out.join(F.broadcast(wide))  # one row each


METHODS = ("limit", "exact")


def _tie_lists(n: str, wanted: Column) -> dict[str, Column]:
    """Doubled midranks and the number of values at each, for groups that are to be counted."""
    tie = F.struct((2 * F.col(f"before_{n}") + F.col(n) + 1).alias("r"), F.col(n).alias("c"))
    lists = F.collect_list(F.when(wanted, tie))
    full = F.max(wanted)
    return {"_r2": F.when(full, F.transform(lists, lambda t: t["r"])), "_c": F.when(full, F.transform(lists, lambda t: t["c"]))}


def rank_tests(df: DataFrame, group: str, a, b, value: str, by: Sequence[str] = (), method: str = "limit", largest: int = 200, largest_ks: int = 10_000) -> DataFrame:
    """Mann–Whitney (ties and continuity corrected), superiority, Brunner–Munzel and Kolmogorov–Smirnov.

    All three come from one running total over the distinct values; no pair of rows is ever formed:
    the probability that a draw from ``a`` exceeds one from ``b`` is U / (n_a n_b).

    ``method`` says where ``u_p`` and ``ks_p`` come from: ``limit``, the limiting distributions, or ``exact``, the counted
    ones: of the rank sum given its ties, and of the lattice paths.  Counting takes lists and time that grow with the
    group, so a group of more than ``largest`` values (``largest_ks`` in a sample) has a null exact p, never another kind of p.
    A group in which one of the two is missing has null statistics.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    both = df.where(F.col(group).isin(a, b))
    hist = ranks.histogram(
        both, value, by, {"na": F.count_if(F.col(group) == a), "nb": F.count_if(F.col(group) == b), "n": F.count(F.lit(1))}
    )
    r = ranks.running(hist, value, ["n", "na", "nb"], by)
    c = {k: F.col(k).cast("double") for k in r.columns if k not in by and k != value}
    mid = c["before_n"] + (c["n"] + 1) / 2
    within_a, within_b = c["before_na"] + (c["na"] + 1) / 2, c["before_nb"] + (c["nb"] + 1) / 2
    da, db = mid - within_a, mid - within_b
    s = r.groupBy(*by).agg(
        F.max(c["all_na"]).alias("n_a"),
        F.max(c["all_nb"]).alias("n_b"),
        F.sum(c["na"] * mid).alias("_ra"),
        F.sum(c["n"] * c["n"] * c["n"] - c["n"]).alias("_tie"),
        F.sum(c["na"] * da).alias("_sda"),
        F.sum(c["na"] * da * da).alias("_qda"),
        F.sum(c["nb"] * db).alias("_sdb"),
        F.sum(c["nb"] * db * db).alias("_qdb"),
        F.max(
            F.abs(F.try_divide(c["before_na"] + c["na"], c["all_na"]) - F.try_divide(c["before_nb"] + c["nb"], c["all_nb"]))
        ).alias("ks"),
        *([x.alias(k) for k, x in _tie_lists("n", F.col("all_n") <= largest).items()] if method == "exact" else []),
    )
    n1, n2 = F.col("n_a"), F.col("n_b")
    n = n1 + n2
    s = s.withColumn("u_a", F.col("_ra") - n1 * (n1 + 1) / 2).withColumn("u_b", n1 * n2 - F.col("u_a"))
    sd_u = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_tie"), n * (n - 1))))
    z = F.try_divide(F.greatest("u_a", "u_b") - n1 * n2 / 2 - 0.5, sd_u)
    mean_a = F.try_divide(F.col("_ra"), n1)
    mean_b = F.try_divide(n * (n + 1) / 2 - F.col("_ra"), n2)
    va = F.try_divide(F.col("_qda") - F.try_divide(F.col("_sda") * F.col("_sda"), n1), n1 - 1)
    vb = F.try_divide(F.col("_qdb") - F.try_divide(F.col("_sdb") * F.col("_sdb"), n2), n2 - 1)
    s = s.withColumns({"_va": va, "_vb": vb, "_ma": mean_a, "_mb": mean_b})
    w = n1 * F.col("_va") + n2 * F.col("_vb")
    s = s.withColumns(
        {
            "u_z": F.when((n1 > 0) & (n2 > 0), F.greatest(z, F.lit(0.0))),
            "cles": F.try_divide(F.col("u_a"), n1 * n2),
            "bm": F.try_divide(n1 * n2 * (F.col("_mb") - F.col("_ma")), n * F.sqrt(w)),
            "bm_df": F.try_divide(
                w * w,
                F.try_divide((n1 * F.col("_va")) * (n1 * F.col("_va")), n1 - 1) + F.try_divide((n2 * F.col("_vb")) * (n2 * F.col("_vb")), n2 - 1),
            ),
        }
    )
    if method == "exact":
        counted = (n1 <= largest_ks) & (n2 <= largest_ks)
        p = {
            "u_p": exact.p_rank_sum(n1, F.col("_r2"), F.col("_c"), 2 * F.col("_ra")),
            "ks_p": exact.p_kolmogorov(n1, n2, F.when(counted, F.col("ks"))),
        }
    else:
        p = {"u_p": cdf.p_norm("u_z"), "ks_p": cdf.p_kolmogorov(F.col("ks") * F.sqrt(n1 * n2 / n))}
    s = s.withColumns({**p, "bm_p": cdf.p_t("bm", "bm_df")})
    return s.select(*by, "n_a", "n_b", "u_a", "u_b", "u_z", "u_p", "cles", "bm", "bm_df", "bm_p", "ks", "ks_p")


def signed_rank(df: DataFrame, x: str, y: str, by: Sequence[str] = (), method: str = "limit", largest: int = 500) -> DataFrame:
    """Wilcoxon signed-rank on nonzero differences y − x, and the paired effect size.

    ``method`` as in ``rank_tests``; an exact p is null above ``largest`` differences.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_d", (F.col(y) - F.col(x)).cast("double"))
    paired = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.coalesce(F.try_divide(F.avg("_d"), F.stddev_samp("_d")), F.lit(0.0)).alias("d_paired"),
    )
    size = d.where(F.col("_d") != 0).withColumn("_a", F.abs("_d"))
    hist = ranks.histogram(
        size, "_a", by, {"n": F.count(F.lit(1)), "up": F.count_if(F.col("_d") > 0)}
    )
    r = ranks.running(hist, "_a", ["n"], by)
    n, mid = F.col("n").cast("double"), F.col("before_n") + (F.col("n") + 1) / 2
    s = r.groupBy(*by).agg(
        F.max("all_n").cast("double").alias("n_nonzero"),
        F.sum(F.col("up") * mid).alias("w_plus"),
        F.sum((F.col("n") - F.col("up")) * mid).alias("w_minus"),
        F.sum(n * n * n - n).alias("_tie"),
        *([x.alias(k) for k, x in _tie_lists("n", F.col("all_n") <= largest).items()] if method == "exact" else []),
    )
    m = F.col("n_nonzero")
    w = F.least("w_plus", "w_minus")
    se = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("_tie") / 2) / 24)
    s = s.withColumns({"w": w, "z": F.try_divide(w - m * (m + 1) / 4, se)})
    p = exact.p_signed_rank(F.col("_r2"), F.col("_c"), 2 * F.col("w_plus")) if method == "exact" else cdf.p_norm("z")
    s = s.withColumn("p", p).drop("_tie", "_r2", "_c")
    return paired.join(s, list(by), "left") if by else paired.join(F.broadcast(s), how="left")  # one row each


# ---- many groups ----------------------------------------------------------------------------


def one_way(df: DataFrame, group: str, value: str, min_n: int = 2) -> DataFrame:
    """F test and eta squared over groups of at least ``min_n``.

    The total sum of squares needs the kept groups only, so small groups are dropped by a semi join on
    the group sizes when ``min_n`` asks for it.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    if min_n > 2:
        sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n)
        rows = rows.join(sizes, group, "left_semi")
    v = F.col(value)
    g = rows.rollup(group).agg(
        F.count(v).alias("n"), F.var_samp(v).alias("var"), F.avg(v).alias("mean"), F.grouping(group).alias("_all")
    )
    ss = (F.col("n") - 1) * F.coalesce("var", F.lit(0.0))
    s = g.agg(
        F.max(F.when(F.col("_all") == 1, F.col("n"))).cast("double").alias("n"),
        F.count(F.when(F.col("_all") == 0, 1)).cast("double").alias("k"),
        F.max(F.when(F.col("_all") == 1, ss)).alias("ss_total"),
        F.sum(F.when(F.col("_all") == 0, ss)).alias("ss_within"),
    ).withColumn("ss_between", F.col("ss_total") - F.col("ss_within"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    return s.withColumns(
        {
            "f": F.try_divide(F.col("ss_between") / d1, F.col("ss_within") / d2),
            "df_between": d1,
            "df_within": d2,
            "eta_squared": F.when(F.col("ss_total") == 0, 0.0).otherwise(F.try_divide("ss_between", "ss_total")),
        }
    ).withColumn("p", cdf.p_f("f", "df_between", "df_within"))


MAX_PAIR_LEVELS = 2000


def _bounded_levels(stats: DataFrame, limit: int) -> DataFrame:
    """``stats`` (a row per level) if it has at most ``limit`` levels; more make all pairs too many to be of use."""
    n = stats.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} levels to compare in pairs; choose levels or raise the limit")
    return stats


def _ordered_pairs(stats: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of group summary rows (levels × levels, never data rows)."""
    left = stats.select(*by, *[F.col(c).alias(f"{c}_a") for c in (group, "n", "mean", "variance")])
    right = stats.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[F.col(c).alias(f"{c}_b") for c in (group, "n", "mean", "variance")])
    on = F.col(f"{group}_a") < F.col(f"{group}_b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, on).drop(*[f"_r_{c}" for c in by])


def pairwise(df: DataFrame, group: str, value: str, min_n: int = 2, max_levels: int = MAX_PAIR_LEVELS) -> DataFrame:
    """Student t-test and effect size for every pair of group summaries; too many levels raise an error."""
    s = _bounded_levels(moments(df, value, [group]).where(F.col("n") >= min_n), max_levels)
    p = _ordered_pairs(s, group).withColumnsRenamed({"variance_a": "var_a", "variance_b": "var_b"})
    p = p.withColumns({"diff": F.col("mean_a") - F.col("mean_b"), "sd_a": F.sqrt("var_a"), "sd_b": F.sqrt("var_b")})
    return effect_size(student(p))


def tukey(df: DataFrame, group: str, value: str, alpha: float = 0.05, max_levels: int = MAX_PAIR_LEVELS) -> DataFrame:
    """Tukey–Kramer comparison of all pairs of cells; too many cells raise an error."""
    s = _bounded_levels(moments(df, value, [group]), max_levels)
    whole = Window.partitionBy(F.lit(0))  # one row per cell
    s = s.withColumns(
        {
            "k": F.count(F.lit(1)).over(whole),
            "df": (F.sum("n").over(whole) - F.count(F.lit(1)).over(whole)).cast("double"),
            "_ss": F.sum((F.col("n") - 1) * F.col("variance")).over(whole),
        }
    )
    left = s.select(F.col(group).alias("group_a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"), "k", "df", "_ss")
    right = s.select(F.col(group).alias("group_b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"))
    p = left.join(right, F.col("group_a") < F.col("group_b"))  # cells × cells
    se = F.sqrt(F.col("_ss") / F.col("df") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b")))
    p = p.withColumns({"diff": F.col("mean_b") - F.col("mean_a"), "se": se})
    p = p.withColumn("q", F.abs("diff") / F.col("se")).withColumn("p_adj", cdf.p_tukey("q", "k", "df"))
    p = p.withColumn("_half", cdf.q_tukey(1 - alpha, "k", "df") * F.col("se"))
    return p.select(
        "group_a", "group_b", "n_a", "n_b", "diff", "se", "q", "df", "p_adj",
        (F.col("diff") - F.col("_half")).alias("lower"), (F.col("diff") + F.col("_half")).alias("upper"),
        (F.col("p_adj") < alpha).alias("significant"),
    )


def levene(df: DataFrame, group: str, value: str, levels: Sequence | None = None) -> DataFrame:
    """Median-centred Levene test and the largest over the smallest variance, from the histogram."""
    rows = df.where(F.col(group).isNotNull())
    rows = rows.where(F.col(group).isin(*levels)) if levels else rows
    hist = ranks.histogram(rows, value, [group])
    med = ranks.quantiles_of(hist, value, {"_med": 0.5}, [group])
    z = F.abs(F.col(value) - F.col("_med"))
    n = F.col("n").cast("double")
    g = hist.join(med, group).groupBy(group).agg(
        F.sum(n).alias("n"), F.sum(n * z).alias("s"), F.sum(n * z * z).alias("q"), F.sum(n * (F.col(value) - F.col("_med"))).alias("_d")
    )
    # squares about the median, less what the median is off the mean
    g = g.withColumn("variance", F.try_divide(F.col("q") - F.col("_d") * F.col("_d") / F.col("n"), F.col("n") - 1))
    s = g.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("_within"),
        (F.sum(F.col("s") * F.col("s") / F.col("n")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("_between"),
        (F.max("variance") / F.min("variance")).alias("variance_ratio"),
    )
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    s = s.withColumns({"w": F.try_divide(F.col("_between") / d1, F.col("_within") / d2), "df_between": d1, "df_within": d2})
    return s.withColumn("p", cdf.p_f("w", "df_between", "df_within")).drop("_within", "_between")


def two_way_margins(df: DataFrame, f1: str, f2: str, value: str) -> DataFrame:
    """Two-way analysis of variance from marginal means; one row per effect.

    The cell table (levels × levels rows) is all that is windowed.
    """
    v = F.col(value)
    rows = df.where(v.isNotNull() & F.col(f1).isNotNull() & F.col(f2).isNotNull())
    cube = rows.cube(f1, f2).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("var"), F.grouping_id(f1, f2).alias("_g")
    )
    whole, by1, by2 = Window.partitionBy(F.lit(0)), Window.partitionBy(f1), Window.partitionBy(f2)
    pick = lambda g, c, w: F.max(F.when(F.col("_g") == g, c)).over(w)
    c = cube.withColumns(
        {
            "gm": pick(3, F.col("m"), whole),
            "nt": pick(3, F.col("n"), whole),
            "sst": pick(3, (F.col("n") - 1) * F.col("var"), whole),
            "m1": pick(1, F.col("m"), by1),
            "m2": pick(2, F.col("m"), by2),
        }
    )
    dev = F.col("m") - F.col("gm")
    inter = F.col("m") - (F.col("gm") + (F.col("m1") - F.col("gm")) + (F.col("m2") - F.col("gm")))
    s = c.agg(
        F.max("sst").alias("ss_total"),
        F.max("nt").cast("double").alias("n"),
        F.sum(F.when(F.col("_g") == 1, F.col("n") * dev * dev)).alias("ss1"),
        F.sum(F.when(F.col("_g") == 2, F.col("n") * dev * dev)).alias("ss2"),
        F.sum(F.when(F.col("_g") == 0, F.col("n") * inter * inter)).alias("ss3"),
        F.count(F.when(F.col("_g") == 1, 1)).cast("double").alias("k1"),
        F.count(F.when(F.col("_g") == 2, 1)).cast("double").alias("k2"),
    )
    d1, d2 = F.col("k1") - 1, F.col("k2") - 1
    dr = F.col("n") - F.col("k1") * F.col("k2")
    resid = F.col("ss_total") - F.col("ss1") - F.col("ss2") - F.col("ss3")
    effects = F.array(
        *[
            F.struct(F.lit(name).alias("effect"), F.col(ss).alias("ss"), d.alias("df"))
            for name, ss, d in ((f1, "ss1", d1), (f2, "ss2", d2), ("interaction", "ss3", d1 * d2))
        ]
    )
    out = s.select(
        F.explode(effects).alias("e"), "ss_total", resid.alias("ss_residual"), dr.alias("df_residual"),
        F.try_divide(F.col("ss1") + F.col("ss2") + F.col("ss3"), F.col("ss_total")).alias("r_squared"),
    ).select("e.*", "ss_total", "ss_residual", "df_residual", "r_squared")
    f = F.try_divide(F.col("ss") / F.col("df"), F.col("ss_residual") / F.col("df_residual"))
    out = out.withColumns({"f": f, "eta_squared": F.try_divide("ss", "ss_total")})
    return out.withColumn("p", cdf.p_f("f", "df", "df_residual"))


# ---- correlations ---------------------------------------------------------------------------


def _r_test(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    t = F.try_divide(F.col(r) * F.sqrt(F.col(n) - 2), F.sqrt(1 - F.col(r) * F.col(r)))
    return df.withColumn("t", t).withColumn("p", cdf.p_t("t", F.col(n) - 2))


def pearson(df: DataFrame, x: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete r of one column with many, one row per feature, in one scan."""
    aggs = []
    for f in features:
        ok = F.col(x).isNotNull() & F.col(f).isNotNull()
        a, b = F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(f).cast("double"))
        aggs.append(F.struct(F.lit(f).alias("feature"), F.corr(a, b).alias("r"), F.count(b).alias("n")))
    out = df.groupBy(*by).agg(F.array(*aggs).alias("_a")).select(*by, F.explode("_a").alias("_a")).select(*by, "_a.*")
    return _r_test(out)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete correlations of all pairs of columns, long form, in one scan."""
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            ok = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
            aggs.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(x, y).alias("r"), F.count(y).alias("n")))
    out = df.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("_a")).select("_a.*")
    return out


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation from the joint histogram.

    Equal (x, y) pairs are combined first; midranks of n values average (n + 1) / 2 exactly, so the
    moments are centred without a second pass.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, (F.col(x).cast("double") + 0.0).alias("_x"), (F.col(y).cast("double") + 0.0).alias("_y")
    )
    pairs = rows.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_w"))

    def ranked(c: str, out: str) -> DataFrame:
        # both margins come from the joint histogram, whose shuffle the branches share
        ran = ranks.running(pairs.groupBy(*by, c).agg(F.sum("_w").alias("n")), c, ["n"], by)
        return ran.select(*by, c, (F.col("before_n") + (F.col("n") + 1) / 2).alias(out))

    j = pairs.join(ranked("_x", "_rx"), [*by, "_x"]).join(ranked("_y", "_ry"), [*by, "_y"])
    total = pairs.groupBy(*by).agg(F.sum("_w").cast("double").alias("_n"))
    j = j.join(total, list(by)) if by else j.join(F.broadcast(total))  # without groups one row
    cx, cy = F.col("_rx") - (F.col("_n") + 1) / 2, F.col("_ry") - (F.col("_n") + 1) / 2
    s = j.groupBy(*by).agg(
        F.max("_n").cast("long").alias("n"),
        F.try_divide(
            F.sum(F.col("_w") * cx * cy), F.sqrt(F.sum(F.col("_w") * cx * cx) * F.sum(F.col("_w") * cy * cy))
        ).alias("r"),
    )
    return _r_test(s)


def moderation(df: DataFrame, x: str, features: Sequence[str], group: str, a, b, min_n: int = 30) -> DataFrame:
    """Difference of a correlation between two groups by Fisher's z."""
    r = pearson(df.where(F.col(group).isin(a, b)), x, features, [group])
    side = lambda c, lvl: F.max(F.when(F.col(group) == lvl, F.col(c)))
    w = r.groupBy("feature").agg(
        side("r", a).alias("r_a"), side("n", a).alias("n_a"), side("r", b).alias("r_b"), side("n", b).alias("n_b")
    ).where((F.col("n_a") > min_n) & (F.col("n_b") > min_n))
    z = (fisher_z(F.col("r_a")) - fisher_z(F.col("r_b"))) / F.sqrt(1 / (F.col("n_a") - 3) + 1 / (F.col("n_b") - 3))
    return w.withColumn("z", z).withColumn("p", cdf.p_norm("z"))


# ---- contrasts ------------------------------------------------------------------------------


def quartile_contrast(df: DataFrame, score: str, features: Sequence[str]) -> DataFrame:
    """Features of rows at or above the third quartile against those at or below the first."""
    q = ranks.quantiles(df, score, {"_q1": 0.25, "_q3": 0.75})
    side = F.when(F.col(score) <= F.col("_q1"), "low").when(F.col(score) >= F.col("_q3"), "high")
    tagged = df.join(F.broadcast(q)).withColumn("_side", side).where(F.col("_side").isNotNull())  # one row
    long = tagged.unpivot(["_side", "_q1", "_q3"], [F.col(f).cast("double").alias(f) for f in features], "feature", "v")
    stats = two_groups(long, "_side", "high", "low", "v", ["feature", "_q1", "_q3"])
    return effect_size(welch(stats)).withColumnsRenamed({"_q1": "low_threshold", "_q3": "high_threshold"})


def flag_contrast(df: DataFrame, level: Column, flags: Sequence[str]) -> DataFrame:
    """Share of each 0/1 flag among high and low rows (true / false / null = neither), ratio, chi-squared."""
    from cohortlens.operators.contingency import chi2_2x2

    long = df.withColumn("_high", level).where(F.col("_high").isNotNull()).unpivot(["_high"], list(flags), "feature", "v")
    hit, high = F.col("v") > 0, F.col("_high")
    t = long.groupBy("feature").agg(
        F.count_if(high & hit).alias("a"), F.count_if(high & ~hit).alias("b"),
        F.count_if(~high & hit).alias("c"), F.count_if(~high & ~hit).alias("d"),
    )
    t = t.withColumns(
        {
            "high_pct": F.try_divide(F.col("a") * 100, F.col("a") + F.col("b")),
            "low_pct": F.try_divide(F.col("c") * 100, F.col("c") + F.col("d")),
        }
    ).withColumn("ratio", F.try_divide("high_pct", "low_pct"))
    return chi2_2x2(t)


def mean_contrast(df: DataFrame, level: Column, features: Sequence[str]) -> DataFrame:
    """Means of each feature among high and low rows with Welch test."""
    tagged = df.withColumn("_high", level).where(F.col("_high").isNotNull())
    long = tagged.unpivot(["_high"], [F.col(f).cast("double").alias(f) for f in features], "feature", "v")
    return effect_size(welch(two_groups(long, "_high", True, False, "v", ["feature"])))


def within_levels(df: DataFrame, group: str, a, b, value: str, level: str, min_n: int = 30) -> DataFrame:
    """The group effect inside every level of another factor."""
    out = effect_size(welch(two_groups(df, group, a, b, value, [level])))
    return out.where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))


def threshold_sensitivity(df: DataFrame, group: str, a, b, value: str, confidence: Column,
                          thresholds: Sequence[float], min_total: int = 100, min_side: int = 10) -> DataFrame:
    """The group effect at every confidence threshold a row passes; one scan, combined map-side."""
    passed = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= confidence)
    long = df.withColumn("_ts", passed).select("*", F.explode_outer("_ts").alias("threshold")).where(
        F.col("threshold").isNotNull()
    )
    out = effect_size(welch(two_groups(long, group, a, b, value, ["threshold"])))
    out = out.where((F.col("n_a") + F.col("n_b") >= min_total) & (F.col("n_a") > min_side) & (F.col("n_b") > min_side))
    return out.withColumn("direction", F.when(F.col("d") > 0, F.concat(F.lit(str(a)), F.lit(" higher"))).otherwise(
        F.concat(F.lit(str(b)), F.lit(" higher"))))


def iqr_fences(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    q = ranks.quantiles(df, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"lower": F.col("q1") - k * iqr, "upper": F.col("q3") + k * iqr})


def outlier_report(df: DataFrame, group: str, a, b, value: str) -> DataFrame:
    """Outliers beyond the fences, and the group effect without them."""
    fenced = df.join(F.broadcast(iqr_fences(df, value)))  # one row
    inside = F.col(value).between(F.col("lower"), F.col("upper"))
    counts = fenced.groupBy("lower", "upper").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~inside).alias("n_outliers")
    )
    rest = effect_size(welch(two_groups(fenced.where(inside), group, a, b, value)))
    return counts.join(F.broadcast(rest))  # one row each


# ---- multiple testing, residuals ------------------------------------------------------------


def adjust_p(df: DataFrame, p: str = "p", key: str = "test", family: Sequence[str] = ()) -> DataFrame:
    """Bonferroni, Benjamini–Hochberg, and the variant without the monotone step.

    The input has one row per test.
    """
    part = list(family) or [F.lit(0)]
    order = Window.partitionBy(*part).orderBy(F.col(p), F.col(key))
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    m = F.count(p).over(Window.partitionBy(*part))
    raw = F.col(p) * m / F.row_number().over(order)
    out = df.where(F.col(p).isNotNull()).withColumns(
        {"p_bonferroni": F.least(F.lit(1.0), F.col(p) * m), "p_bh_plain": F.least(F.lit(1.0), raw), "_raw": raw}
    )
    return out.withColumn("p_bh", F.least(F.lit(1.0), F.min("_raw").over(later))).drop("_raw")


def jarque_bera(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    s = df.groupBy(*by).agg(F.count(v).alias("n"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("excess"))
    jb = F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("excess") * F.col("excess") / 4)
    return s.withColumn("jb", jb).withColumn("p", cdf.p_chi2("jb", 2.0)).withColumn("normal", F.col("p") > 0.05)


# ---- missingness ----------------------------------------------------------------------------


def missing_pattern(df: DataFrame, age: str = "age_bucket", gender: str = "gender", unknown: str = "unknown") -> DataFrame:
    """Counts and shares of missing age and gender ('unknown' is missing) and their 2×2 pattern."""
    has_age = F.col(age).isNotNull()
    has_gender = F.coalesce(F.col(gender) != unknown, F.lit(False))
    s = df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(~has_age).alias("n_missing_age"),
        F.count_if(~has_gender).alias("n_missing_gender"),
        F.count_if(has_age & has_gender).alias("both_present"),
        F.count_if(has_age & ~has_gender).alias("age_only"),
        F.count_if(~has_age & has_gender).alias("gender_only"),
        F.count_if(~has_age & ~has_gender).alias("both_missing"),
    )
    return s.withColumns(
        {f"pct_missing_{k}": F.try_divide(f"n_missing_{k}", "n_total") for k in ("age", "gender")}
    )


def missing_outcome(df: DataFrame, present: Mapping[str, Column], value: str, min_n: int = 100, alpha: float = 0.05) -> DataFrame:
    """Does the outcome differ by missingness?  Pooled t-test per variable, both sides above ``min_n``."""
    tagged = df.select(value, *[c.cast("int").alias(k) for k, c in present.items()])
    long = tagged.unpivot([value], list(present), "variable", "_present")
    out = student(two_groups(long, "_present", 1, 0, value, ["variable"]))
    out = out.where((F.col("n_a") > min_n) & (F.col("n_b") > min_n))
    return out.withColumn("mnar", F.col("p") < alpha)
