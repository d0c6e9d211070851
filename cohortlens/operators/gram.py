"""Linear models from co-moment aggregates.

One scan leaves a *Gram row* per group: ``n``, the means and the upper triangle of the co-moment matrix of
``[x1 … xp, y]`` (Spark's covariance aggregate merges partial co-moments without cancellation).  Nested
models, VIF, leave-one-out, fixed effects, bootstrap and exclusion runs are sub-matrices, differences or
weighted sums of such rows; only the small solve runs in Python, in parallel over rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions import cdf
from cohortlens.functions.hashing import poisson_one, stable_key, uniform
from cohortlens.operators.clean import complete_cases

MODEL_FIELDS = (
    "n long, df_resid double, r2 double, adj_r2 double, f double, f_p double, rss double, aic double, bic double"
)
TERM_FIELDS = "term string, b double, se double, t double, p double, ci_low double, ci_high double, vif double"


# ---- Gram rows ------------------------------------------------------------------------------


def _pairs(q: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(q) for j in range(i, q)]


def _aggregates(cols: Sequence[str]) -> list[Column]:
    """n, mean and co as three expressions; written as SQL text to keep plan building short."""
    q = [f"CAST(`{c}` AS DOUBLE)" for c in cols]
    mean = ", ".join(f"avg({c})" for c in q)
    co = ", ".join(f"covar_pop({q[i]}, {q[j]}) * count(1)" for i, j in _pairs(len(q)))
    return [F.expr("count(1)").alias("n"), F.expr(f"array({mean})").alias("mean"), F.expr(f"array({co})").alias("co")]


def gram(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = (), total: bool = False) -> DataFrame:
    """Gram rows of complete cases; ``total`` adds the overall row (``is_total`` = 1) in the same scan."""
    cols = [*xs, y]
    rows = complete_cases(df, cols).select(*dict.fromkeys([*by, *cols]))
    if total:
        g = F.grouping(by[0]).cast("int").alias("is_total")
        return rows.rollup(*by).agg(*_aggregates(cols), g)
    return rows.groupBy(*by).agg(*_aggregates(cols))


def _matrix(co: Sequence[float], q: int) -> np.ndarray:
    m = np.zeros((q, q))
    m[np.triu_indices(q)] = co
    return m + np.triu(m, 1).T


class _Moments:
    """The Gram row as numpy, with sub-selection."""

    def __init__(self, n: float, mean: Sequence[float], co: np.ndarray, names: Sequence[str]):
        self.n, self.mean, self.co, self.names = float(n), np.asarray(mean, float), co, list(names)

    @classmethod
    def of(cls, row, names: Sequence[str]) -> "_Moments":
        return cls(row.n, list(row.mean), _matrix(list(row.co), len(names)), names)

    def solve(self, xs: Sequence[str]) -> dict | None:
        """Least squares of the last column on ``xs``; None when too few rows."""
        idx = [self.names.index(x) for x in xs]
        p = len(idx)
        sxx, sxy, syy = self.co[np.ix_(idx, idx)], self.co[idx, -1], self.co[-1, -1]
        dof = self.n - p - 1
        if dof <= 0:
            return None
        inv = np.linalg.pinv(sxx, hermitian=True) if p else np.zeros((0, 0))
        beta = inv @ sxy
        rss = max(0.0, float(syy - beta @ sxy))
        s2 = rss / dof
        mx = self.mean[idx]
        b0 = float(self.mean[-1] - beta @ mx)
        full = np.zeros((p + 1, p + 1))
        full[1:, 1:] = inv
        full[0, 1:] = full[1:, 0] = -inv @ mx
        full[0, 0] = 1.0 / self.n + mx @ inv @ mx
        r2 = 1.0 - rss / syy if syy > 0 else float("nan")
        with np.errstate(all="ignore"):
            vif = np.diag(inv) * np.diag(sxx)
        return {
            "beta": np.concatenate([[b0], beta]), "inv": full, "rss": rss, "s2": s2, "dof": dof, "r2": r2,
            "tss": float(syy), "vif": np.concatenate([[np.nan], vif]), "terms": ["Intercept", *xs], "p": p,
        }


def _model_fields(m: _Moments, fit: dict) -> dict:
    n, p, rss, r2 = m.n, fit["p"], fit["rss"], fit["r2"]
    f = (r2 / p) / ((1 - r2) / fit["dof"]) if p and r2 < 1 else float("nan")
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1) if rss > 0 else float("inf")
    return {
        "n": int(n), "df_resid": fit["dof"], "r2": r2, "adj_r2": 1 - (1 - r2) * (n - 1) / fit["dof"], "f": f,
        "f_p": cdf.f_sf(f, p, fit["dof"]) if f == f else float("nan"), "rss": rss,
        "aic": -2 * llf + 2 * (p + 1), "bic": -2 * llf + math.log(n) * (p + 1),
    }


def _term_rows(m: _Moments, fit: dict) -> Iterator[dict]:
    crit = cdf.t_ppf(0.975, fit["dof"])
    for i, term in enumerate(fit["terms"]):
        b, se = float(fit["beta"][i]), math.sqrt(max(0.0, fit["s2"] * fit["inv"][i, i]))
        t = b / se if se > 0 else float("nan")
        yield {
            "term": term, "b": b, "se": se, "t": t, "p": cdf.t_two_sided(t, fit["dof"]) if t == t else float("nan"),
            "ci_low": b - crit * se, "ci_high": b + crit * se, "vif": float(fit["vif"][i]),
        }


def _kinds(df: DataFrame, cols: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in cols)


def solve_rows(grams: DataFrame, names: Sequence[str], keep: Sequence[str], schema: str,
               emit: Callable[[_Moments], Iterator[dict]]) -> DataFrame:
    """Apply a small numpy function to every Gram row, carrying the ``keep`` columns along."""
    fields = [f.split()[0].strip("`") for f in schema.split(",")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out: dict[str, list] = {c: [] for c in [*keep, *fields]}
            for row in batch.itertuples(index=False):
                if row.n is None or row.n == 0 or any(v is None or v != v for v in row.co):
                    continue
                for rec in emit(_Moments.of(row, names)):
                    for c in keep:
                        out[c].append(getattr(row, c))
                    for c in fields:
                        out[c].append(rec[c])
            yield pd.DataFrame(out)

    return grams.mapInPandas(run, _kinds(grams, keep) + schema)


# ---- models ---------------------------------------------------------------------------------


def _union(models: Mapping[str, Sequence[str]]) -> list[str]:
    return list(dict.fromkeys(x for xs in models.values() for x in xs))


def fit_models(df: DataFrame, y: str, models: Mapping[str, Sequence[str]], by: Sequence[str] = (), min_n: int = 0) -> DataFrame:
    """Coefficient table of every model (per group), all from one Gram aggregate.

    All models use the rows that are complete for their union of columns.
    """
    xs = _union(models)
    specs = {k: list(v) for k, v in models.items()}
    grams = gram(df, y, xs, by).where(F.col("n") >= min_n)

    def emit(m: _Moments) -> Iterator[dict]:
        for name, cols in specs.items():
            fit = m.solve(cols)
            if fit is not None:
                head = {"model": name, **_model_fields(m, fit)}
                for rec in _term_rows(m, fit):
                    yield {**head, **rec}

    return solve_rows(grams, [*xs, y], by, f"model string, {MODEL_FIELDS}, {TERM_FIELDS}", emit)


def nested_models(df: DataFrame, y: str, models: Mapping[str, Sequence[str]], by: Sequence[str] = (), min_n: int = 0) -> DataFrame:
    """One row per model with the change in R² and its F test against the model before it."""
    xs = _union(models)
    specs = [(k, list(v)) for k, v in models.items()]
    grams = gram(df, y, xs, by).where(F.col("n") >= min_n)

    def emit(m: _Moments) -> Iterator[dict]:
        before = None
        for step, (name, cols) in enumerate(specs):
            fit = m.solve(cols)
            if fit is None:
                continue
            row = {"model": name, "step": step, **_model_fields(m, fit), "delta_r2": None, "f_change": None, "p_change": None}
            if before is not None:
                extra = fit["p"] - before["p"]
                row["delta_r2"] = fit["r2"] - before["r2"]
                if extra > 0 and fit["rss"] > 0:
                    row["f_change"] = (before["rss"] - fit["rss"]) / extra / fit["s2"]
                    row["p_change"] = cdf.f_sf(row["f_change"], extra, fit["dof"])
            before = fit
            yield row

    schema = f"model string, step int, {MODEL_FIELDS}, delta_r2 double, f_change double, p_change double"
    return solve_rows(grams, [*xs, y], by, schema, emit)


def anova_type2(df: DataFrame, y: str, f1: Mapping[str, Sequence[str]], f2: Mapping[str, Sequence[str]],
                interaction: Sequence[str]) -> DataFrame:
    """Type II sums of squares of two factors given as dummy columns, from nested residuals of one Gram."""
    (n1, d1), (n2, d2) = next(iter(f1.items())), next(iter(f2.items()))
    d1, d2, d12 = list(d1), list(d2), list(interaction)
    xs = [*d1, *d2, *d12]

    def emit(m: _Moments) -> Iterator[dict]:
        both, full = m.solve([*d1, *d2]), m.solve(xs)
        only1, only2 = m.solve(d1), m.solve(d2)
        parts = [
            (n1, only2["rss"] - both["rss"], len(d1)),
            (n2, only1["rss"] - both["rss"], len(d2)),
            ("interaction", both["rss"] - full["rss"], len(d12)),
        ]
        total = sum(ss for _, ss, _ in parts) + full["rss"]
        for name, ss, dof in parts:
            f = ss / dof / full["s2"]
            yield {
                "effect": name, "ss": ss, "df": float(dof), "f": f, "p": cdf.f_sf(f, dof, full["dof"]),
                "eta_squared": ss / total, "partial_eta_squared": ss / (ss + full["rss"]),
                "ss_residual": full["rss"], "df_residual": full["dof"], "r2": full["r2"],
            }

    schema = (
        "effect string, ss double, df double, f double, p double, eta_squared double, partial_eta_squared double, "
        "ss_residual double, df_residual double, r2 double"
    )
    return solve_rows(gram(df, y, xs), [*xs, y], [], schema, emit)


# ---- second pass diagnostics ----------------------------------------------------------------


def fit_row(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """One row: coefficients, inverse cross-product matrix, residual variance."""

    def emit(m: _Moments) -> Iterator[dict]:
        fit = m.solve(list(xs))
        if fit is not None:
            yield {"_beta": fit["beta"].tolist(), "_inv": fit["inv"].ravel().tolist(), "_s2": fit["s2"], "_n": int(m.n), "_r2": fit["r2"]}

    schema = "_beta array<double>, _inv array<double>, _s2 double, _n long, _r2 double"
    return solve_rows(gram(df, y, xs), [*xs, y], [], schema, emit)


def with_influence(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Fitted value, residual, leverage and Cook's distance per row; the fit is one broadcast row."""
    x = ["1.0D", *[f"CAST(`{c}` AS DOUBLE)" for c in xs]]
    k = len(x)
    fitted = " + ".join(f"_beta[{i}] * {x[i]}" for i in range(k))
    lev = " + ".join(f"{1 if i == j else 2} * _inv[{i * k + j}] * {x[i]} * {x[j]}" for i in range(k) for j in range(i, k))
    rows = complete_cases(df, [*xs, y]).join(F.broadcast(fit_row(df, y, xs)))
    rows = rows.withColumns({"fitted": F.expr(fitted), "leverage": F.expr(lev)}).withColumn("resid", F.expr(f"`{y}` - fitted"))
    cook = f"resid * resid * leverage / ({k} * _s2 * (1 - leverage) * (1 - leverage))"
    return rows.withColumn("cooks_d", F.expr(cook)).withColumn("influential", F.expr("cooks_d > 4.0D / _n")).drop(
        "_beta", "_inv", "_s2", "_n", "_r2"
    )


def robust_se(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """HC3 standard errors next to the plain ones."""
    cols = list(xs)
    k = len(cols) + 1
    x = ["1.0D", *[f"CAST(`{c}` AS DOUBLE)" for c in cols]]
    w = "resid * resid / ((1 - leverage) * (1 - leverage))"
    meat = ", ".join(f"sum({x[i]} * {x[j]} * {w})" for i in range(k) for j in range(i, k))
    m = with_influence(df, y, cols).agg(F.expr(f"array({meat})").alias("meat"))
    both = fit_row(df, y, cols).join(F.broadcast(m))  # one row each

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for r in batch.itertuples(index=False):
                inv = np.asarray(list(r[1])).reshape(k, k)
                v = inv @ _matrix(list(r.meat), k) @ inv
                for i, term in enumerate(["Intercept", *cols]):
                    b, se = float(r[0][i]), math.sqrt(max(0.0, v[i, i]))
                    z = b / se if se > 0 else float("nan")
                    out.append((term, b, math.sqrt(max(0.0, r[2] * inv[i, i])), se, z, min(1.0, 2 * cdf.norm_sf(abs(z)))))
            yield pd.DataFrame(out, columns=["term", "b", "se", "se_hc3", "z", "p"])

    return both.mapInPandas(run, "term string, b double, se double, se_hc3 double, z double, p double")


def breusch_pagan(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """n R² of the squared residuals on the predictors."""
    e = with_influence(df, y, xs).withColumn("_e2", F.col("resid") * F.col("resid"))
    cols = list(xs)

    def emit(m: _Moments) -> Iterator[dict]:
        fit = m.solve(cols)
        lm = m.n * fit["r2"]
        p = cdf.chi2_sf(lm, len(cols))
        yield {"lm": lm, "df": float(len(cols)), "p": p, "heteroscedastic": bool(p < 0.05)}

    return solve_rows(gram(e, "_e2", cols), [*cols, "_e2"], [], "lm double, df double, p double, heteroscedastic boolean", emit)


def influence_report(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Coefficients with and without influential rows (Cook's distance above 4 / n)."""
    flagged = with_influence(df, y, xs)
    counts = flagged.agg(
        F.count_if("influential").alias("n_influential"),
        F.avg(F.col("influential").cast("double")).alias("share_influential"),
        F.max("cooks_d").alias("max_cooks_d"),
    )
    full = fit_models(df, y, {"full": xs}).select("term", F.col("b").alias("b_full"), F.col("r2").alias("r2_full"))
    clean = fit_models(flagged.where(~F.col("influential")), y, {"clean": xs}).select(
        "term", F.col("b").alias("b_clean"), F.col("r2").alias("r2_clean"), F.col("n").alias("n_clean")
    )
    out = full.join(clean, "term").join(F.broadcast(counts))  # a row per term, one row of counts
    return out.withColumns(
        {
            "change": F.col("b_clean") - F.col("b_full"),
            "pct_change": F.try_divide((F.col("b_clean") - F.col("b_full")) * 100, F.col("b_full")),
        }
    )


def influence_profile(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Mean outcome and predictors of influential and other rows."""
    return with_influence(df, y, xs).groupBy("influential").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in [y, *xs]]
    )


# ---- groups ---------------------------------------------------------------------------------


def leave_one_group_out(df: DataFrame, y: str, xs: Sequence[str], group: str, min_n: int = 100) -> DataFrame:
    """R² without each group, by taking its Gram row out of the total: no refit, one scan."""
    cols = list(xs)
    names = [*cols, y]
    g = gram(df.where(F.col(group).isNotNull()), y, cols, [group], total=True)
    total = g.where("is_total = 1").select(F.col("n").alias("tn"), F.col("mean").alias("tm"), F.col("co").alias("tc"))
    rows = g.where(f"is_total = 0 AND n >= {min_n}").join(F.broadcast(total))  # one row
    kind = dict(df.dtypes)[group]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = len(names)
        for batch in it:
            out = []
            for r in batch.itertuples(index=False):
                m, tm = np.asarray(list(r.mean)), np.asarray(list(r.tm))
                n2 = r.tn - r.n
                if n2 < min_n:
                    continue
                tc = _matrix(list(r.tc), q)
                m2 = (r.tn * tm - r.n * m) / n2
                co = tc - _matrix(list(r.co), q) - np.outer(m - m2, m - m2) * (r.n * n2 / r.tn)
                rest, whole = _Moments(n2, m2, co, names).solve(cols), _Moments(r.tn, tm, tc, names).solve(cols)
                out.append((getattr(r, group), int(n2), rest["r2"], rest["r2"] - whole["r2"]))
            yield pd.DataFrame(out, columns=["excluded", "n", "r2", "r2_change"])

    return rows.mapInPandas(run, f"excluded {kind}, n long, r2 double, r2_change double")


def stability(runs: DataFrame, r2: str = "r2", limit: float = 0.001) -> DataFrame:
    s = runs.agg(
        F.count(r2).alias("n_runs"),
        (F.max(r2) - F.min(r2)).alias("r2_range"),
        F.stddev_pop(r2).alias("r2_sd"),
        F.avg(r2).alias("r2_mean"),
    )
    return s.withColumn("stable", F.col("r2_range") < limit)


def variance_explained(df: DataFrame, y: str, xs: Sequence[str], group: str, min_n: int = 100) -> DataFrame:
    """R² of predictors, of group membership and of both.

    Group effects are absorbed: the sum of the groups' own co-moments is the Gram matrix of demeaned
    columns, so thousands of communities cost no design columns.
    """
    cols = list(xs)
    q = len(cols) + 1
    keep = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_n)
    rows = df.join(keep, group, "left_semi")
    g = gram(rows, y, cols, [group], total=True)
    size = q * (q + 1) // 2
    within = [F.sum(F.when(F.col("is_total") == 0, F.col("co")[i])) for i in range(size)]
    total = [F.max(F.when(F.col("is_total") == 1, F.col("co")[i])) for i in range(size)]
    s = g.agg(
        F.max(F.when(F.col("is_total") == 1, F.col("n"))).alias("n"),
        F.count(F.when(F.col("is_total") == 0, 1)).alias("k"),
        F.array(*total).alias("tc"),
        F.array(*within).alias("wc"),
    )
    names = [*cols, y]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for r in batch.itertuples(index=False):
                if r.n is None or r.n != r.n:  # no group is large enough
                    out.append((0, 0, *[None] * 6))
                    continue
                tc, wc = _matrix(list(r.tc), q), _matrix(list(r.wc), q)
                zero = np.zeros(q)
                demo = _Moments(r.n, zero, tc, names).solve(cols)["r2"]
                tss = tc[-1, -1]
                within_fit = _Moments(r.n, zero, wc, names).solve(cols)
                community, both = 1 - wc[-1, -1] / tss, 1 - within_fit["rss"] / tss
                out.append((int(r.n), int(r.k), demo, community, both, community / demo if demo > 0 else None, both - community, both - demo))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in fields.split(", ")])
            yield frame.astype({c: "float64" for c in frame.columns[2:]})

    fields = (
        "n long, n_groups long, r2_predictors double, r2_group double, r2_both double, ratio double, "
        "delta_predictors double, delta_group double"
    )
    return s.mapInPandas(run, fields)


# ---- resampling -----------------------------------------------------------------------------


def block_of(key: str, blocks: int, seed: int = 42) -> Column:
    return F.floor(uniform(stable_key(key, seed=seed)) * blocks).cast("int")


def block_grams(df: DataFrame, y: str, xs: Sequence[str], key: str, blocks: int = 4096, seed: int = 42) -> DataFrame:
    """Gram rows of hash blocks: rows fall into blocks at random, so blocks are exchangeable."""
    return gram(df.withColumn("block", block_of(key, blocks, seed)), y, xs, ["block"])


def reweighted(blocks: DataFrame, q: int, weight: Callable[[Column, Column], Column], runs: DataFrame) -> DataFrame:
    """Gram row of every run: blocks weighted by ``weight(block, run)``.

    Sums are taken about the overall mean, which keeps them free of cancellation.  The work is
    blocks × runs small rows, whatever the number of data rows.
    """
    from pyspark.sql import Window

    whole = Window.partitionBy(F.lit(0))  # one row per block
    c = blocks.withColumns(
        {f"_c{i}": F.sum(F.col("n") * F.col("mean")[i]).over(whole) / F.sum("n").over(whole) for i in range(q)}
    )
    d = {f"_d{i}": F.expr(f"mean[{i}] - _c{i}") for i in range(q)}
    c = c.withColumns(d)
    x = c.join(F.broadcast(runs)).withColumn("w", weight(F.col("block"), F.col("run")).cast("double")).where("w > 0")
    sums = ["sum(w * n) AS n"] + [f"sum(w * n * _d{i}) AS s{i}" for i in range(q)] + [f"max(_c{i}) AS _c{i}" for i in range(q)]
    sums += [f"sum(w * (co[{p}] + n * _d{i} * _d{j})) AS p{p}" for p, (i, j) in enumerate(_pairs(q))]
    keep = runs.columns
    g = x.groupBy(*keep).agg(*[F.expr(s) for s in sums])
    mean = ", ".join(f"_c{i} + s{i} / n" for i in range(q))
    co = ", ".join(f"p{p} - s{i} * s{j} / n" for p, (i, j) in enumerate(_pairs(q)))
    return g.select(*keep, F.col("n").cast("long").alias("n"), F.expr(f"array({mean})").alias("mean"), F.expr(f"array({co})").alias("co"))


def poisson_weight(seed: int = 42, *extra: str) -> Callable[[Column, Column], Column]:
    return lambda block, run: poisson_one(uniform(stable_key(block, *[F.col(e) for e in extra], run, seed=seed)))


def kept_weight(share: Column | float, seed: int = 42) -> Callable[[Column, Column], Column]:
    """1 with probability ``share``, else 0."""
    limit = share if isinstance(share, Column) else F.lit(float(share))
    return lambda block, run: (uniform(stable_key(block, run, seed=seed)) < limit).cast("int")


def _coefficients(grams: DataFrame, y: str, xs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    cols = list(xs)

    def emit(m: _Moments) -> Iterator[dict]:
        fit = m.solve(cols)
        if fit is not None:
            for i, term in enumerate(fit["terms"]):
                yield {"term": term, "b": float(fit["beta"][i]), "r2": fit["r2"]}

    return solve_rows(grams, [*cols, y], keep, "term string, b double, r2 double", emit)


def resampled_coefficients(df: DataFrame, y: str, xs: Sequence[str], key: str, reps: int = 1000, blocks: int = 4096,
                           share: float | None = None, seed: int = 42) -> DataFrame:
    """Coefficients of every replicate: Poisson bootstrap, or subsamples of a share of the blocks."""
    runs = df.sparkSession.range(reps).select(F.col("id").cast("int").alias("run"))
    b = block_grams(df, y, xs, key, blocks, seed)
    weight = poisson_weight(seed) if share is None else kept_weight(share, seed)
    return _coefficients(reweighted(b, len(xs) + 1, weight, runs), y, xs, ["run"])


def summarise_runs(coefs: DataFrame, value: str = "b", by: Sequence[str] = ("term",)) -> DataFrame:
    """Mean, sd, coefficient of variation and percentile interval over runs."""
    v = F.col(value)
    return coefs.groupBy(*by).agg(
        F.count(v).alias("runs"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.abs(F.try_divide(F.stddev_samp(v), F.avg(v))).alias("cv"),
        F.percentile(v, 0.025).alias("ci_low"),
        F.percentile(v, 0.975).alias("ci_high"),
    )


def random_exclusion(df: DataFrame, y: str, xs: Sequence[str], key: str, shares: Sequence[float] = (0.01, 0.05, 0.10, 0.20),
                     trials: int = 10, blocks: int = 4096, seed: int = 42) -> DataFrame:
    """R² when a random share of the data is left out, several trials per share."""
    spark = df.sparkSession
    runs = spark.createDataFrame(
        [(i * trials + t, float(s), t) for i, s in enumerate(shares) for t in range(trials)], "run int, excluded double, trial int"
    )
    weight = kept_weight(1 - F.col("excluded"), seed)
    g = reweighted(block_grams(df, y, xs, key, blocks, seed), len(xs) + 1, weight, runs)
    r = _coefficients(g, y, xs, ["excluded", "run"]).where("term = 'Intercept'")
    return r.groupBy("excluded").agg(
        F.count("r2").alias("trials"), F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_sd"),
        (F.max("r2") - F.min("r2")).alias("r2_range"),
    )


def bootstrap_correlation(df: DataFrame, x: str, y: str, key: str, reps: int = 2000, blocks: int = 4096, seed: int = 42) -> DataFrame:
    """Percentile interval of a correlation."""
    runs = df.sparkSession.range(reps).select(F.col("id").cast("int").alias("run"))
    g = reweighted(block_grams(df, y, [x], key, blocks, seed), 2, poisson_weight(seed), runs)
    r = g.select(F.expr("co[1] / sqrt(co[0] * co[2])").alias("r"))
    return r.agg(
        F.count("r").alias("runs"), F.avg("r").alias("mean"), F.percentile("r", 0.025).alias("ci_low"),
        F.percentile("r", 0.975).alias("ci_high"),
    )


def bootstrap_mean_difference(df: DataFrame, group: str, a, b, value: str, key: str, reps: int = 2000, blocks: int = 4096,
                              seed: int = 42) -> DataFrame:
    """Percentile interval of a difference of means; the groups are resampled independently."""
    v = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(
        F.when(F.col(group) == a, "a").otherwise("b").alias("side"), F.col(value).cast("double").alias("v"), block_of(key, blocks, seed).alias("block")
    )
    sums = v.groupBy("side", "block").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    runs = df.sparkSession.range(reps).select(F.col("id").cast("int").alias("run"))
    x = sums.join(F.broadcast(runs)).withColumn("w", poisson_weight(seed, "side")(F.col("block"), F.col("run")))
    pick = lambda side, c: F.sum(F.when(F.col("side") == side, F.col("w") * F.col(c)))
    d = x.groupBy("run").agg((pick("a", "s") / pick("a", "n") - pick("b", "s") / pick("b", "n")).alias("d"))
    return d.agg(
        F.count("d").alias("runs"), F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("ci_low"),
        F.percentile("d", 0.975).alias("ci_high"),
    )
