"""Logistic and robust regression, compositional and attenuation-corrected models, power."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions import cdf
from cohortlens.functions.scalar import log_ratio
from cohortlens.operators import gram as M
from cohortlens.operators.clean import complete_cases
from cohortlens.session import ensure_checkpoint_dir


def _exp(x: float) -> float:
    return math.exp(x) if x < 709 else math.inf


def logistic(df: DataFrame, y: str, xs: Sequence[str], max_iter: int = 50, tol: float = 1e-10) -> DataFrame:
    """Binomial regression by Newton steps: coefficients, odds ratios with limits, pseudo R², AIC.

    A step is one aggregate over the checkpointed rows: the weighted Gram matrix, the gradient and the likelihood; only the
    coefficients travel.  Where a combination of columns separates the classes, the likelihood has no maximum: its gain
    fades out while some coefficients go on growing by about one a step.  These are reported as infinite with ``separated``
    set, without standard errors; the others keep the values they have settled at.
    """
    cols = list(xs)
    k = len(cols) + 1
    x = ["1.0D", *[f"CAST(`{c}` AS DOUBLE)" for c in cols]]
    ensure_checkpoint_dir(df.sparkSession)
    rows = complete_cases(df, [*cols, y]).select(*cols, F.col(y).cast("double").alias(y)).checkpoint()
    pairs = M._pairs(k)

    def step(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int, float]:
        eta = "(" + " + ".join(f"{float(b)!r}D * {c}" for b, c in zip(beta, x)) + ")"
        e = [f"sum(p * q * {x[i]} * {x[j]})" for i, j in pairs] + [f"sum((`{y}` - p) * {c})" for c in x]
        log_p = f"sum(`{y}` * eta - greatest(eta, 0.0D) - log1p(exp(-abs(eta))))"
        r, ll, n, mean = (
            rows.withColumn("eta", F.expr(eta)).withColumn("p", F.expr("1.0D / (1.0D + exp(-eta))")).withColumn("q", F.expr("1.0D / (1.0D + exp(eta))"))
            .agg(F.expr(f"array({', '.join(e)})"), F.expr(log_p), F.expr("count(1)"), F.expr(f"avg(`{y}`)")).head()
        )
        return M._matrix(r[: len(pairs)], k), np.asarray(r[len(pairs):]), ll, n, mean

    beta = np.zeros(k)
    moved = np.full(k, np.inf)
    before = -np.inf
    for _ in range(max_iter):
        info, slope, ll, n, mean = step(beta)
        if np.max(np.abs(moved)) < tol:
            break
        if ll < before - 1e-9 * abs(before):  # too far: back by half
            moved = moved / 2
            beta = beta - moved
            continue
        if ll - before < 1e-8 * (abs(ll) + 1e-3) and np.max(np.abs(moved)) > 0.3 and np.max(np.abs(beta)) > 12:
            break
        moved, before = np.linalg.lstsq(info, slope, rcond=None)[0], ll
        beta = beta + moved
    separated = bool(np.max(np.abs(moved)) > 0.3)
    cov = np.linalg.pinv(info)
    null = n * (mean * math.log(mean) + (1 - mean) * math.log(1 - mean)) if 0 < mean < 1 else 0.0
    pseudo, aic = (1 - ll / null if null else float("nan")), 2 * k - 2 * ll
    out = []
    for i, term in enumerate(["Intercept", *cols]):
        c, e = float(beta[i]), math.sqrt(max(cov[i, i], 0.0))
        if separated and abs(moved[i]) > 0.3:
            endless = math.copysign(math.inf, c)
            out.append((term, endless, None, None, None, math.inf if c > 0 else 0.0, None, None, pseudo, aic, int(n), True))
            continue
        z = c / e if e else float("nan")
        out.append((term, c, e, z, min(1.0, 2 * cdf.norm_sf(abs(z))), _exp(c), _exp(c - 1.959963984540054 * e), _exp(c + 1.959963984540054 * e), pseudo, aic, int(n), separated))
    schema = (
        "term string, b double, se double, z double, p double, odds_ratio double, or_low double, or_high double, "
        "pseudo_r2 double, aic double, n long, separated boolean"
    )
    return df.sparkSession.createDataFrame(out, schema)


BINS, HELD = 4096, 100_000


def _middle(rows: DataFrame, value: str, low: float, high: float, counts: list | None = None) -> float:
    """Exact median of an expression: bins between ``low`` and ``high`` are counted, the bin of the middle is read or cut again.

    ``counts`` are the (bin, n, least, most) rows of the first pass if another aggregate has made them.
    """
    found = {}
    counts = counts or rows.groupBy(F.expr(_bin(value, low, high)).alias("bin")).agg(F.count(F.lit(1)), F.expr(f"min({value})"), F.expr(f"max({value})")).collect()
    n = sum(r[1] for r in counts)
    for rank in {(n - 1) // 2, n // 2}:
        here, before = sorted(counts), 0
        while rank not in found:
            for _, c, least, most in here:
                if rank < before + c:
                    break
                before += c
            if least == most:
                found[rank] = least
            elif c <= HELD:
                inside = rows.where(F.expr(f"{value} BETWEEN {least!r}D AND {most!r}D")).select(F.expr(value)).collect()
                found[rank] = sorted(r[0] for r in inside)[rank - before]
            else:
                part = rows.where(F.expr(f"{value} BETWEEN {least!r}D AND {most!r}D")).groupBy(F.expr(_bin(value, least, most)).alias("bin"))
                here = sorted(part.agg(F.count(F.lit(1)), F.expr(f"min({value})"), F.expr(f"max({value})")).collect())
    return sum(found.values()) / len(found)


def _bin(value: str, low: float, high: float) -> str:
    """Number of the bin of a value; smaller and larger ones share a bin each."""
    width = (high - low) / BINS or 1.0
    return f"CAST(greatest(-1, least({BINS}, floor(({value} - {low!r}D) / {width!r}D))) AS INT)"


def huber(df: DataFrame, y: str, xs: Sequence[str], t: float = 1.345, max_iter: int = 50, tol: float = 1e-8) -> DataFrame:
    """Huber M-estimator by iteratively reweighted least squares, scale from the exact median absolute residual.

    An iteration is one aggregate over the checkpointed rows, by bins of the absolute residual around the last median: the
    Gram matrix with the residual's weight, and the counts that say which bin holds the median, whose few values a second
    job reads.  Only sums of the bins and the coefficients travel between iterations.
    """
    cols = list(xs)
    k = len(cols) + 1
    x = ["1.0D", *[f"CAST(`{c}` AS DOUBLE)" for c in cols]]
    ensure_checkpoint_dir(df.sparkSession)
    rows = complete_cases(df, [*cols, y]).select(*cols, y).checkpoint()
    pairs = M._pairs(k)

    def resid(beta: np.ndarray) -> str:
        return f"(CAST(`{y}` AS DOUBLE) - (" + " + ".join(f"{float(b)!r}D * {c}" for b, c in zip(beta, x)) + "))"

    def step(beta: np.ndarray, scale: float | None, around: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, float]:
        """Gram matrix, moments with y (weighted by the residuals at ``beta`` if there is a scale), median absolute residual."""
        size = f"abs({resid(beta)})"
        w = "1.0D" if scale is None else f"CASE WHEN r <= {t * scale!r}D THEN 1.0D ELSE {t * scale!r}D / r END"
        e = [f"sum(w * {x[i]} * {x[j]})" for i, j in pairs] + [f"sum(w * {c} * CAST(`{y}` AS DOUBLE))" for c in x]
        weighted = rows.withColumn("r", F.expr(size)).withColumn("w", F.expr(w))
        parts = weighted.groupBy(F.expr(_bin("r", *around)).alias("bin")).agg(F.count(F.lit(1)), F.min("r"), F.max("r"), F.expr(f"array({', '.join(e)})")).collect()
        sums = np.sum(np.array([r[4] for r in sorted(parts, key=lambda r: r[0])]), axis=0)
        return M._matrix(sums[: len(pairs)], k), sums[len(pairs):], _middle(rows, size, *around, [r[:4] for r in parts])

    zero = np.zeros(k)
    plain, xy, spread = step(zero, None, (0.0, 1.0))
    beta = np.linalg.solve(plain, xy)
    _, _, middle = step(beta, None, (0.0, 2 * spread or 1.0))
    scale, reach = middle / 0.6744897501960817, 0.5
    for _ in range(max_iter):
        if scale == 0:  # more than half of the rows are fitted exactly
            break
        xx, xy, now = step(beta, scale, (middle * (1 - reach), middle * (1 + reach)))
        new = np.linalg.solve(xx, xy)
        done = max(np.max(np.abs(new - beta)), abs(now - middle)) < tol
        reach = min(0.5, max(1e-3, 4 * abs(now / middle - 1)))
        beta, middle, scale = new, now, now / 0.6744897501960817
        if done:
            break
    if scale == 0:
        out = [(term, float(b), None, None, None, 0.0, int(rows.count())) for term, b in zip(["Intercept", *cols], beta)]
        return df.sparkSession.createDataFrame(out, "term string, b double, se double, z double, p double, scale double, n long")
    # covariance: k^2 * [sum psi^2 / (n - p)] s^2 / (mean psi')^2 * (X'X)^-1
    inside = f"(abs({resid(beta)}) <= {t * scale!r}D)"
    psi2 = f"CASE WHEN {inside} THEN pow({resid(beta)} / {scale!r}D, 2) ELSE {t * t!r}D END"
    n, sum_psi2, m = rows.agg(F.expr("count(1)"), F.expr(f"sum({psi2})"), F.expr(f"avg(CAST({inside} AS DOUBLE))")).head()
    kfac = 1 + k / n * (1 - m) / m
    cov = kfac**2 * (sum_psi2 * scale**2 / (n - k)) / m**2 * np.linalg.inv(plain)
    out = []
    for i, term in enumerate(["Intercept", *cols]):
        se = math.sqrt(cov[i, i])
        z = beta[i] / se
        out.append((term, float(beta[i]), se, float(z), min(1.0, 2 * cdf.norm_sf(abs(z))), float(scale), int(n)))
    return df.sparkSession.createDataFrame(out, "term string, b double, se double, z double, p double, scale double, n long")


def compositional(df: DataFrame, y: str, controls: Sequence[str], parts: Sequence[str], reference: str) -> DataFrame:
    """Regressions on shares that sum to one: reference dropped, log ratios, and one share at a time.

    All of them, and the controls-only model the changes in R² refer to, share one Gram aggregate.
    """
    rest = [p for p in parts if p != reference]
    ratios = {f"alr_{p}": log_ratio(F.col(p), F.col(reference)) for p in rest}
    models = {
        "controls": list(controls),
        "drop_reference": [*controls, *rest],
        "log_ratio": [*controls, *ratios],
        **{f"only_{p}": [*controls, p] for p in parts},
    }
    out = M.fit_models(complete_cases(df, [y, *controls, *parts]).withColumns(ratios), y, models)
    base = out.where("model = 'controls' AND term = 'Intercept'").select(F.col("r2").alias("_r2"))
    return out.join(F.broadcast(base)).withColumn("delta_r2", F.col("r2") - F.col("_r2")).drop("_r2")  # one row


def missing_models(df: DataFrame, y: str, age: str, gender: str, age_levels: Sequence[str], gender_levels: Sequence[str],
                   unknown: str = "unknown") -> DataFrame:
    """Complete cases against 'unknown' as a category of its own, side by side."""
    from cohortlens.functions.scalar import dummies

    filled = df.withColumns({age: F.coalesce(age, F.lit(unknown)), gender: F.coalesce(gender, F.lit(unknown))})
    a = dummies(age, age_levels, age_levels[0], "age_")
    g = dummies(gender, gender_levels, gender_levels[0], "gender_")
    plain = {**a, **g}
    extra = {
        "age_unknown": (F.col(age) == unknown).cast("double"),
        "gender_unknown": (F.col(gender) == unknown).cast("double"),
    }
    d = filled.select(y, age, gender, *[c.alias(k) for k, c in {**plain, **extra}.items()])
    known = d.where((F.col(age) != unknown) & (F.col(gender) != unknown))
    complete = M.fit_models(known, y, {"complete_case": list(plain)})
    category = M.fit_models(d, y, {"unknown_category": [*plain, *extra]})
    return complete.unionByName(category)


def reliability(df: DataFrame, pairs: Mapping[str, tuple[Column, Column]], min_n: int = 50) -> DataFrame:
    """Agreement of a classification with the truth where both are known; null below ``min_n``."""
    aggs = []
    for k, (truth, called) in pairs.items():
        known = truth.isNotNull() & called.isNotNull()
        n = F.count_if(known)
        aggs.append(F.struct(F.lit(k).alias("variable"), n.alias("n"), F.when(n > min_n, F.avg(F.when(known, (truth == called).cast("double")))).alias("reliability")))
    return df.agg(F.array(*aggs).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def attenuation_corrected(terms: DataFrame, reliabilities: Mapping[str, float] | DataFrame) -> DataFrame:
    """Coefficients divided by the reliability of their variable, R² by it too (at most 1)."""
    if not isinstance(reliabilities, DataFrame):
        reliabilities = terms.sparkSession.createDataFrame(list(reliabilities.items()), "term string, reliability double")
    out = terms.join(reliabilities, "term", "left")
    rel = F.coalesce(F.col("reliability"), F.lit(1.0))
    return out.withColumns(
        {
            "b_corrected": F.col("b") / rel,
            "r2_corrected": F.least(F.lit(1.0), F.col("r2") / rel),
            "attenuation": 1 - rel,
        }
    )


def corrected_bootstrap(df: DataFrame, y: str, xs: Sequence[str], reliabilities: DataFrame, key: str, reps: int = 1000,
                        blocks: int = 4096, seed: int = 42) -> DataFrame:
    """Percentile intervals of the coefficients divided by the reliability of their variable, over bootstrap runs."""
    runs = M.resampled_coefficients(df, y, xs, key, reps, blocks, seed=seed)
    rel = reliabilities.select("term", "reliability")
    out = runs.join(F.broadcast(rel), "term", "left")  # one row per variable of the model
    return M.summarise_runs(out.withColumn("b_corrected", F.col("b") / F.coalesce("reliability", F.lit(1.0))), "b_corrected")


# ---- power ----------------------------------------------------------------------------------


def f_test_power(sizes: np.ndarray, effects: np.ndarray, predictors: int, alpha: float) -> np.ndarray:
    """Power of the overall F test for each (sample size, Cohen's f2); nan where no error degrees of freedom are left."""
    out = np.full(len(sizes), np.nan)
    critical: dict[float, float] = {}
    for i, (n, f2) in enumerate(zip(sizes, effects, strict=True)):
        error_df = n - predictors - 1
        if error_df > 0:
            if n not in critical:
                critical[n] = cdf.f_ppf(1 - alpha, predictors, error_df)
            out[i] = cdf.noncentral_f_sf(critical[n], predictors, error_df, n * f2)
    return out


def detectable_effects(sizes: np.ndarray, target: float, predictors: int, alpha: float) -> np.ndarray:
    """Cohen's f2 at which the F test reaches the target power, for all sizes at once.

    The effect is bracketed by doubling from 1 / n and found by regula falsi (Illinois) on the logarithm of f2.
    """
    sizes = np.asarray(sizes, float)
    miss = lambda x: f_test_power(sizes, np.exp(x), predictors, alpha) - target
    high = -np.log(sizes)
    gap_high = miss(high)
    low, gap_low = high - 30, np.full(len(sizes), alpha - target)
    while (short := gap_high < 0).any():
        low, gap_low = np.where(short, high, low), np.where(short, gap_high, gap_low)
        high = np.where(short, high + np.log(2), high)
        gap_high = miss(high)
    for _ in range(200):
        if np.nanmax(high - low, initial=0) < 1e-10:
            break
        x = (low * gap_high - high * gap_low) / (gap_high - gap_low)
        x = np.where((x > low) & (x < high), x, (low + high) / 2)
        gap = miss(x)
        up = gap >= 0
        gap_low, gap_high = np.where(up, gap_low / 2, gap), np.where(up, gap, gap_high / 2)
        low, high = np.where(up | np.isnan(gap), low, x), np.where(up, x, high)
        if np.nanmax(np.abs(gap), initial=0) < 1e-12:
            low = high = x
    return np.exp(high)


def power_table(df: DataFrame, by: Sequence[str], effects: Sequence[float] = (0.02, 0.15, 0.35), reliability: float = 1.0,
                alpha: float = 0.05, predictors: int = 5, target: float = 0.80) -> DataFrame:
    """Per segment: power for each effect size, with and without measurement error, and the detectable effect."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    kinds = M._kinds(sizes, by)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            n = batch["n"].to_numpy(float)
            # measurement error shrinks the effect by the squared reliability
            smallest = detectable_effects(n, target, predictors, alpha) / reliability**2
            for e in effects:
                clean, noisy = (f_test_power(n, np.full(len(n), e * r**2), predictors, alpha) for r in (1.0, reliability))
                yield batch[[*by, "n"]].assign(f2=e, power_no_error=clean, power=noisy, power_loss=clean - noisy, detectable_f2=smallest)

    schema = kinds + "n long, f2 double, power_no_error double, power double, power_loss double, detectable_f2 double"
    return sizes.mapInPandas(run, schema)
