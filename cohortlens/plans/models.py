"""Queries on regression models, diagnostics and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import gram as M, models as MD
from cohortlens.plans import roles, sqltext as Q
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.stats import with_missing

rnd = Q.rnd
U = roles.USERS_SQL
TEEN, FEMALE, BOTH = "is_teen", "is_female", "teen_x_female"
_D = f"""d AS (SELECT *, CAST(age_predicted = 'teen' AS DOUBLE) AS is_teen, CAST(gender_predicted = 'female' AS DOUBLE) AS is_female,
    CAST(age_predicted = 'teen' AND gender_predicted = 'female' AS DOUBLE) AS teen_x_female FROM users)"""


def design(spark, sf):
    """Users with 0/1 columns and their interaction."""
    df = roles.users(spark, sf).withColumns(
        {TEEN: (F.col("age_predicted") == "teen").cast("double"), FEMALE: (F.col("gender_predicted") == "female").cast("double")}
    )
    return df.withColumn(BOTH, F.col(TEEN) * F.col(FEMALE))


# ---- SQL pieces -----------------------------------------------------------------------------


def _ols2(source: str, y: str, x1: str, x2: str, by: str = "") -> str:
    """CTE ``o``: least squares on two predictors by Cramer's rule on covariances."""
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""c AS (SELECT {sel}CAST(count(*) AS DOUBLE) AS n, avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, var_pop({y}) AS syy, var_pop({x1}) AS s11, var_pop({x2}) AS s22,
      covar_pop({x1}, {x2}) AS s12, covar_pop({x1}, {y}) AS s1y, covar_pop({x2}, {y}) AS s2y FROM {source} {grp}),
    e AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM c),
    f AS (SELECT *, (s1y * s22 - s2y * s12) / det AS b1, (s2y * s11 - s1y * s12) / det AS b2 FROM e),
    g AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (syy - b1 * s1y - b2 * s2y) AS rss, n * syy AS tss FROM f),
    o AS (SELECT *, n - 3 AS dof, rss / (n - 3) AS s2, 1 - rss / tss AS r2,
      sqrt(rss / (n - 3) * s22 / det / n) AS se1, sqrt(rss / (n - 3) * s11 / det / n) AS se2,
      sqrt(rss / (n - 3) * (1 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det / n)) AS se0,
      1 / (1 - s12 * s12 / (s11 * s22)) AS vif, ((tss - rss) / 2) / (rss / (n - 3)) AS fstat,
      n * (ln(2 * pi()) + ln(rss / n) + 1) + 6 AS aic, n * (ln(2 * pi()) + ln(rss / n) + 1) + 3 * ln(n) AS bic FROM g)"""


_MODEL = f"""CAST(n AS BIGINT) AS n, dof AS df_resid, {rnd('r2')} AS r2, {rnd('1 - (1 - r2) * (n - 1) / dof')} AS adj_r2, {rnd('fstat')} AS f, {rnd(Q.p_f('fstat', '2.0::DOUBLE', 'dof'), 5)} AS f_p,
      {rnd('rss', 4)} AS rss, {rnd('aic', 3)} AS aic, {rnd('bic', 3)} AS bic"""


def _terms(x1: str, x2: str, extra: str = "") -> str:
    out = []
    for term, i, vif in (("Intercept", 0, "NULL::DOUBLE"), (x1, 1, "vif"), (x2, 2, "vif")):
        out.append(
            f"SELECT {extra}'{term}' AS term, {rnd(f'b{i}')} AS b, {rnd(f'se{i}')} AS se, {rnd(f'b{i} / se{i}')} AS t, {rnd(Q.p_t(f'(b{i} / se{i})', 'dof'), 5)} AS p, {rnd(vif)} AS vif, {_MODEL} FROM o"
        )
    return " UNION ALL ".join(out)


_DIGITS = dict(p=5, f_p=5, rss=4, aic=3, bic=3)
_R2 = "((pow({r1}, 2) + pow({r2}, 2) - 2 * {r1} * {r2} * {r12}) / (1 - pow({r12}, 2)))"


def _r2_sql(y: str, x1: str, x2: str) -> str:
    return _R2.format(r1=f"corr({y}, {x1})", r2=f"corr({y}, {x2})", r12=f"corr({x1}, {x2})")


# ---- least squares --------------------------------------------------------------------------


@query(f"WITH {U}, {_D}, {_ols2('d', 'score_mean', TEEN, FEMALE)} SELECT 'demographics' AS model, * FROM ({_terms(TEEN, FEMALE)})")
def ols_demographics(spark, sf):
    out = M.fit_models(design(spark, sf), "score_mean", {"demographics": [TEEN, FEMALE]})
    return rounded(out.drop("ci_low", "ci_high"), **_DIGITS)


_CELLS = """k AS (SELECT is_teen, is_female, count(*) AS n, avg(score_mean) AS m, var_samp(score_mean) AS v FROM d GROUP BY ALL),
    w AS (SELECT max(n) FILTER (WHERE is_teen = 0 AND is_female = 0) AS n00, max(m) FILTER (WHERE is_teen = 0 AND is_female = 0) AS m00, max(n) FILTER (WHERE is_teen = 1 AND is_female = 0) AS n10,
      max(m) FILTER (WHERE is_teen = 1 AND is_female = 0) AS m10, max(n) FILTER (WHERE is_teen = 0 AND is_female = 1) AS n01, max(m) FILTER (WHERE is_teen = 0 AND is_female = 1) AS m01,
      max(n) FILTER (WHERE is_teen = 1 AND is_female = 1) AS n11, max(m) FILTER (WHERE is_teen = 1 AND is_female = 1) AS m11, sum((n - 1) * v) AS rss3, sum(n) AS n, sum(n) - 4.0::DOUBLE AS dof,
      sum((n - 1) * v) / (sum(n) - 4) AS s2 FROM k)"""


@query(
    f"""WITH {U}, {_D}, {_CELLS}, t AS (
      SELECT 'Intercept' AS term, m00 AS b, sqrt(s2 / n00) AS se, dof FROM w UNION ALL SELECT 'is_teen', m10 - m00, sqrt(s2 * (1 / n00 + 1 / n10)), dof FROM w
      UNION ALL SELECT 'is_female', m01 - m00, sqrt(s2 * (1 / n00 + 1 / n01)), dof FROM w UNION ALL SELECT 'teen_x_female', m11 - m10 - m01 + m00, sqrt(s2 * (1 / n00 + 1 / n10 + 1 / n01 + 1 / n11)), dof FROM w)
    SELECT term, {rnd('b')} AS b, {rnd('se')} AS se, {rnd('b / se')} AS t, {rnd(Q.p_t('(b / se)', 'dof'), 5)} AS p, dof AS df_resid FROM t"""
)
def ols_interaction(spark, sf):
    out = M.fit_models(design(spark, sf), "score_mean", {"interaction": [TEEN, FEMALE, BOTH]})
    return rounded(out.select("term", "b", "se", "t", "p", "df_resid"), p=5)


@query(
    f"""WITH {U}, {_D}, {_CELLS}, t AS (SELECT var_pop(score_mean) * count(*) AS tss, count(*) AS n, pow(corr(score_mean, is_teen), 2) AS r1, {_r2_sql('score_mean', TEEN, FEMALE)} AS r2 FROM d),
    r AS (SELECT 'age' AS model, 0 AS step, t.n, t.n - 2.0::DOUBLE AS df_resid, r1 AS r2, NULL::DOUBLE AS prev FROM t UNION ALL SELECT 'gender', 1, n, n - 3.0::DOUBLE, r2, r1 FROM t
      UNION ALL SELECT 'interaction', 2, t.n, t.n - 4.0::DOUBLE, 1 - rss3 / tss, r2 FROM t, w),
    f AS (SELECT *, (r2 - prev) / ((1 - r2) / df_resid) AS fc FROM r)
    SELECT model, CAST(step AS INTEGER) AS step, CAST(n AS BIGINT) AS n, df_resid, {rnd('r2', 8)} AS r2, {rnd('r2 - prev', 8)} AS delta_r2, {rnd('fc')} AS f_change, {rnd(Q.p_f('fc', '1.0::DOUBLE', 'df_resid'), 5)} AS p_change FROM f"""
)
def hierarchical_models(spark, sf):
    out = M.nested_models(
        design(spark, sf), "score_mean", {"age": [TEEN], "gender": [TEEN, FEMALE], "interaction": [TEEN, FEMALE, BOTH]}
    )
    return rounded(out.select("model", "step", "n", "df_resid", "r2", "delta_r2", "f_change", "p_change"), r2=8, delta_r2=8, p_change=5)


@query()
def full_emotion_model(spark, sf):
    """Demographics, interaction, community dummies and emotions: every coefficient, interval and VIF."""
    from cohortlens.functions.scalar import dummies

    c = dummies("community", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], "AFRICA", "community_")
    c = {k.replace(" ", "_"): v for k, v in c.items()}
    df = design(spark, sf).withColumns(c)
    emotions = roles.USER_EMOTIONS[:-1]
    out = M.fit_models(
        df, "score_mean",
        {"demographics": [TEEN, FEMALE], "interaction": [TEEN, FEMALE, BOTH], "communities": [TEEN, FEMALE, BOTH, *c],
         "emotions": [TEEN, FEMALE, BOTH, *c, *emotions]},
    )
    return rounded(out)


@query(
    f"""WITH {U}, {_D}, {_CELLS}, t AS (SELECT var_pop(score_mean) * count(*) AS tss, pow(corr(score_mean, is_teen), 2) AS r1, pow(corr(score_mean, is_female), 2) AS r2, {_r2_sql('score_mean', TEEN, FEMALE)} AS r12 FROM d),
    s AS (SELECT tss * (r12 - r2) AS ss1, tss * (r12 - r1) AS ss2, tss * (1 - r12) - rss3 AS ss3, rss3, dof, tss FROM t, w),
    e AS (SELECT 'age' AS effect, ss1 AS ss, * FROM s UNION ALL SELECT 'gender', ss2, * FROM s UNION ALL SELECT 'interaction', ss3, * FROM s),
    f AS (SELECT *, ss / (rss3 / dof) AS f FROM e)
    SELECT effect, {rnd('ss')} AS ss, 1.0::DOUBLE AS df, {rnd('f')} AS f, {rnd(Q.p_f('f', '1.0::DOUBLE', 'dof'), 5)} AS p, {rnd('ss / (ss1 + ss2 + ss3 + rss3)')} AS eta_squared,
      {rnd('ss / (ss + rss3)')} AS partial_eta_squared, {rnd('rss3', 4)} AS ss_residual, dof AS df_residual, {rnd('1 - rss3 / tss', 8)} AS r2 FROM f"""
)
def two_way_anova_type2(spark, sf):
    out = M.anova_type2(design(spark, sf), "score_mean", {"age": [TEEN]}, {"gender": [FEMALE]}, [BOTH])
    return rounded(out, p=5, ss_residual=4, r2=8)


# ---- diagnostics ----------------------------------------------------------------------------

_ONE = f"""m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(balance) AS mx, var_pop(balance) * count(*) AS sxx, regr_slope(score_mean, balance) AS b1, regr_intercept(score_mean, balance) AS b0 FROM users),
    r AS (SELECT u.author, u.balance AS x, u.score_mean AS y, m.*, u.score_mean - b0 - b1 * u.balance AS e, 1 / n + pow(u.balance - mx, 2) / sxx AS h FROM users u, m),
    s AS (SELECT sum(e * e) / (max(n) - 2) AS s2 FROM r), k AS (SELECT r.*, s2, e * e * h / (2 * s2 * pow(1 - h, 2)) AS cook FROM r, s)"""


@query(f"WITH {U}, {_ONE} SELECT author, {rnd('y - e')} AS fitted, {rnd('e')} AS resid, {rnd('h', 9)} AS leverage, {rnd('cook', 8)} AS cooks_d, cook > 4 / n AS influential FROM k")
def influence_measures(spark, sf):
    out = M.with_influence(roles.users(spark, sf), "score_mean", ["balance"])
    return rounded(out.select("author", "fitted", "resid", "leverage", "cooks_d", "influential"), leverage=9, cooks_d=8)


@query(
    f"""WITH {U}, {_ONE}, v AS (SELECT max(b0) AS b0, max(b1) AS b1, max(s2) AS s2, max(n) AS n, max(mx) AS mx, max(sxx) AS sxx, sum(pow(x - mx, 2) * e * e / pow(1 - h, 2)) / pow(max(sxx), 2) AS v1,
      sum(pow(1 / n - mx * (x - mx) / sxx, 2) * e * e / pow(1 - h, 2)) AS v0 FROM k)
    SELECT 'Intercept' AS term, {rnd('b0')} AS b, {rnd('sqrt(s2 * (1 / n + mx * mx / sxx))')} AS se, {rnd('sqrt(v0)')} AS se_hc3, {rnd('b0 / sqrt(v0)', 4)} AS z, {rnd(Q.p_norm('(b0 / sqrt(v0))'), 5)} AS p FROM v
    UNION ALL SELECT 'balance', {rnd('b1', 9)}, {rnd('sqrt(s2 / sxx)', 9)}, {rnd('sqrt(v1)', 9)}, {rnd('b1 / sqrt(v1)', 4)}, {rnd(Q.p_norm('(b1 / sqrt(v1))'), 5)} FROM v"""
)
def robust_standard_errors(spark, sf):
    out = M.robust_se(roles.users(spark, sf), "score_mean", ["balance"])
    small = F.col("term") == "balance"
    cols = [F.when(small, F.round(c, 9)).otherwise(F.round(c, 6)).alias(c) for c in ("b", "se", "se_hc3")]
    return out.select("term", *cols, F.round("z", 4).alias("z"), F.round("p", 5).alias("p"))


@query(
    f"""WITH {U}, {_ONE}, t AS (SELECT max(n) * pow(corr(e * e, x), 2) AS lm FROM k)
    SELECT {rnd('lm')} AS lm, 1.0::DOUBLE AS df, {rnd(Q.p_chi2('lm', '1.0::DOUBLE'), 5)} AS p, {Q.p_chi2('lm', '1.0::DOUBLE')} < 0.05 AS heteroscedastic FROM t"""
)
def breusch_pagan_test(spark, sf):
    return rounded(M.breusch_pagan(roles.users(spark, sf), "score_mean", ["balance"]), p=5)


@query(
    f"""WITH {U}, {_ONE}, c AS (SELECT count(*) FILTER (WHERE cook > 4 / n) AS ni, avg(CAST(cook > 4 / n AS INTEGER)) AS si, max(cook) AS mc FROM k),
    z AS (SELECT regr_slope(y, x) AS c1, regr_intercept(y, x) AS c0, regr_r2(y, x) AS rc, count(*) AS nc FROM k WHERE NOT cook > 4 / n), a AS (SELECT max(b0) AS b0, max(b1) AS b1, pow(corr(y, x), 2) AS rf FROM k),
    t AS (SELECT 'Intercept' AS term, b0 AS b_full, c0 AS b_clean, * FROM a, z, c UNION ALL SELECT 'balance', b1, c1, * FROM a, z, c)
    SELECT term, {rnd('b_full', 8)} AS b_full, {rnd('rf', 8)} AS r2_full, {rnd('b_clean', 8)} AS b_clean, {rnd('rc', 8)} AS r2_clean, nc AS n_clean, ni AS n_influential, {rnd('si')} AS share_influential, {rnd('mc')} AS max_cooks_d,
      {rnd('b_clean - b_full', 8)} AS change, {rnd('(b_clean - b_full) * 100 / b_full', 3)} AS pct_change FROM t"""
)
def influence_report(spark, sf):
    out = M.influence_report(roles.users(spark, sf), "score_mean", ["balance"])
    return rounded(out, 8, share_influential=6, max_cooks_d=6, pct_change=3)


@query(f"WITH {U}, {_ONE} SELECT cook > 4 / n AS influential, count(*) AS n, {rnd('avg(y)')} AS mean_score_mean, {rnd('avg(x)', 4)} AS mean_balance FROM k GROUP BY ALL")
def influence_profile(spark, sf):
    return rounded(M.influence_profile(roles.users(spark, sf), "score_mean", ["balance"]), mean_balance=4)


@query(f"WITH {U}, {_ONE}, g AS (SELECT count(*) AS n, skewness(e) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0::DOUBLE)) AS sk, kurtosis_pop(e) AS ex FROM k), j AS (SELECT *, n / 6 * (sk * sk + ex * ex / 4) AS jb FROM g) SELECT n, {rnd('sk')} AS skew, {rnd('ex')} AS excess, {rnd('jb', 4)} AS jb, {rnd('exp(-jb / 2)', 5)} AS p, exp(-jb / 2) > 0.05 AS normal FROM j")
def residual_normality(spark, sf):
    from cohortlens.operators.groups import jarque_bera

    resid = M.with_influence(roles.users(spark, sf), "score_mean", ["balance"]).select("resid")
    return rounded(jarque_bera(resid, "resid"), jb=4, p=5)


# ---- other models ---------------------------------------------------------------------------


@query(
    f"""WITH {U}, {_D}, t AS (SELECT CAST(count(*) FILTER (WHERE is_teen = 1 AND n_high > 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE is_teen = 1 AND n_high = 0) AS DOUBLE) AS b,
      CAST(count(*) FILTER (WHERE is_teen = 0 AND n_high > 0) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE is_teen = 0 AND n_high = 0) AS DOUBLE) AS d FROM d),
    l AS (SELECT *, -2 * (a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d))) AS dev, -2 * ((a + c) * ln((a + c) / (a + b + c + d)) + (b + d) * ln((b + d) / (a + b + c + d))) AS nul FROM t),
    r AS (SELECT 'Intercept' AS term, ln(c / d) AS co, sqrt(1 / c + 1 / d) AS se, * FROM l UNION ALL SELECT 'is_teen', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d), * FROM l)
    SELECT term, {rnd('co', 5)} AS b, {rnd('se', 5)} AS se, {rnd('co / se', 4)} AS z, {rnd(Q.p_norm('(co / se)'), 4)} AS p, {rnd('exp(co)', 5)} AS odds_ratio, {rnd('exp(co - 1.959963984540054 * se)', 4)} AS or_low,
      {rnd('exp(co + 1.959963984540054 * se)', 4)} AS or_high, {rnd('1 - dev / nul')} AS pseudo_r2, {rnd('dev + 4', 3)} AS aic, CAST(a + b + c + d AS BIGINT) AS n FROM r"""
)
def logistic_age(spark, sf):
    df = design(spark, sf).withColumn("high", (F.col("n_high") > 0).cast("double"))
    return rounded(MD.logistic(df, "high", [TEEN]).drop("separated"), 5, z=4, p=4, or_low=4, or_high=4, pseudo_r2=6, aic=3)


_DET = "({m}11 * ({m}22 * {m}33 - {m}23 * {m}23) - {m}12 * ({m}12 * {m}33 - {m}23 * {m}13) + {m}13 * ({m}12 * {m}23 - {m}22 * {m}13))"


def _inverse(m: str) -> dict[str, str]:
    """Entries of the inverse of a symmetric 3x3 matrix with columns ``m``11 to ``m``33, times its determinant."""
    g = {"m": m}
    return {k: v.format(**g) for k, v in {
        "11": "({m}22 * {m}33 - {m}23 * {m}23)", "12": "({m}13 * {m}23 - {m}12 * {m}33)", "13": "({m}12 * {m}23 - {m}13 * {m}22)",
        "22": "({m}11 * {m}33 - {m}13 * {m}13)", "23": "({m}12 * {m}13 - {m}11 * {m}23)", "33": "({m}11 * {m}22 - {m}12 * {m}12)",
    }.items()}


_INV, _DET3 = _inverse("h"), _DET.format(m="h")
_SOLVED = [f"({_INV[f'{min(1, i)}{max(1, i)}']} * v1 + {_INV[f'{min(2, i)}{max(2, i)}']} * v2 + {_INV[f'{min(3, i)}{max(3, i)}']} * v3) / {_DET3}" for i in (1, 2, 3)]


@query(
    f"""WITH RECURSIVE {U}, {_D}, cell AS (SELECT is_teen AS x1, is_female AS x2, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE n_high > 0) AS DOUBLE) AS k FROM d GROUP BY ALL),
    it(i, b0, b1, b2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT i + 1, b0 + {_SOLVED[0]}, b1 + {_SOLVED[1]}, b2 + {_SOLVED[2]} FROM (
        SELECT i, b0, b1, b2, sum(w) AS h11, sum(w * x1) AS h12, sum(w * x2) AS h13, sum(w * x1 * x1) AS h22, sum(w * x1 * x2) AS h23, sum(w * x2 * x2) AS h33, sum(k - n * p) AS v1, sum((k - n * p) * x1) AS v2, sum((k - n * p) * x2) AS v3
        FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p, n * p * (1 - p) AS w FROM it, cell) GROUP BY i, b0, b1, b2) WHERE i < 25),
    e AS (SELECT b0, b1, b2, sum(w) AS h11, sum(w * x1) AS h12, sum(w * x2) AS h13, sum(w * x1 * x1) AS h22, sum(w * x1 * x2) AS h23, sum(w * x2 * x2) AS h33, sum(k * ln(p) + (n - k) * ln(1 - p)) AS ll, sum(n) AS n, sum(k) AS k
        FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p, n * p * (1 - p) AS w FROM it, cell WHERE i = 25) GROUP BY b0, b1, b2),
    r AS ({' UNION ALL '.join(f"SELECT '{t}' AS term, b{i} AS co, sqrt({_INV[f'{i + 1}{i + 1}']} / {_DET3}) AS se, ll, n, k FROM e" for i, t in enumerate(('Intercept', TEEN, FEMALE)))})
    SELECT term, {rnd('co', 5)} AS b, {rnd('se', 5)} AS se, {rnd('co / se', 4)} AS z, {rnd(Q.p_norm('(co / se)'), 4)} AS p, {rnd('exp(co)', 5)} AS odds_ratio, {rnd('exp(co - 1.959963984540054 * se)', 4)} AS or_low,
      {rnd('exp(co + 1.959963984540054 * se)', 4)} AS or_high, {rnd('1 - ll / (k * ln(k / n) + (n - k) * ln(1 - k / n))')} AS pseudo_r2, {rnd('6 - 2 * ll', 3)} AS aic, CAST(n AS BIGINT) AS n, false AS separated FROM r"""
)
def logistic_demographics(spark, sf):
    df = design(spark, sf).withColumn("high", (F.col("n_high") > 0).cast("double"))
    return rounded(MD.logistic(df, "high", [TEEN, FEMALE]), 5, z=4, p=4, or_low=4, or_high=4, pseudo_r2=6, aic=3)


_MOMENTS = "sum(w) AS h11, sum(w * x1) AS h12, sum(w * x2) AS h13, sum(w * x1 * x1) AS h22, sum(w * x1 * x2) AS h23, sum(w * x2 * x2) AS h33, sum(w * y) AS v1, sum(w * x1 * y) AS v2, sum(w * x2 * y) AS v3"


@query(
    f"""WITH RECURSIVE {U}, {_D}, z AS (SELECT is_teen AS x1, is_female AS x2, score_mean AS y FROM d),
    o AS (SELECT {', '.join(f'{s} AS b{i}' for i, s in enumerate(_SOLVED))} FROM (SELECT {_MOMENTS} FROM (SELECT *, 1.0::DOUBLE AS w FROM z))),
    it(i, b0, b1, b2, s) AS (SELECT 0, b0, b1, b2, median(abs(y - b0 - b1 * x1 - b2 * x2)) / 0.6744897501960817::DOUBLE FROM o, z GROUP BY b0, b1, b2 UNION ALL
        SELECT i + 1, {', '.join(_SOLVED)}, m / 0.6744897501960817::DOUBLE FROM (SELECT i, b0, b1, b2, median(r) AS m, {_MOMENTS} FROM (
            SELECT *, abs(y - b0 - b1 * x1 - b2 * x2) AS r, CASE WHEN r <= 1.345 * s THEN 1.0::DOUBLE ELSE 1.345 * s / r END AS w FROM it, z) GROUP BY i, b0, b1, b2) WHERE i < 50),
    l AS (SELECT b0, b1, b2, s, CAST(count(*) AS DOUBLE) AS n, avg(CAST(r <= 1.345 * s AS DOUBLE)) AS m, sum(CASE WHEN r <= 1.345 * s THEN r * r / (s * s) ELSE 1.345 * 1.345 END) AS psi2, {_MOMENTS}
        FROM (SELECT *, abs(y - b0 - b1 * x1 - b2 * x2) AS r, 1.0::DOUBLE AS w FROM it, z WHERE i = 50) GROUP BY b0, b1, b2, s),
    t AS ({' UNION ALL '.join(f"SELECT '{t}' AS term, b{i} AS b, sqrt(pow(1 + 3 / n * (1 - m) / m, 2) * (psi2 * s * s / (n - 3)) / (m * m) * {_INV[f'{i + 1}{i + 1}']} / {_DET3}) AS se, s, n FROM l" for i, t in enumerate(('Intercept', TEEN, FEMALE)))})
    SELECT term, {rnd('b', 5)} AS b, {rnd('se', 5)} AS se, {rnd('b / se', 3)} AS z, {rnd(Q.p_norm('(b / se)'), 4)} AS p, {rnd('s', 5)} AS scale, CAST(n AS BIGINT) AS n FROM t"""
)
def huber_regression(spark, sf):
    return rounded(MD.huber(design(spark, sf), "score_mean", [TEEN, FEMALE]), 5, z=3, p=4)


@query(
    f"""WITH {U}, {_D}, {_ols2('d', 'score_mean', 'score_std', 'emotion_joy', 'community')} SELECT community, 'model' AS model, * FROM ({' UNION ALL '.join(
        f"SELECT community, '{t}' AS term, {rnd(f'b{i}')} AS b, {rnd(f'se{i}')} AS se, {rnd(f'b{i} / se{i}', 4)} AS t, {rnd('r2')} AS r2, CAST(n AS BIGINT) AS n FROM o WHERE n >= 50" for i, t in enumerate(('Intercept', 'score_std', 'emotion_joy')))})""".replace("SELECT community, 'model' AS model, * FROM", "SELECT 'model' AS model, * FROM")
)
def models_by_community(spark, sf):
    out = M.fit_models(design(spark, sf), "score_mean", {"model": ["score_std", "emotion_joy"]}, ["community"], 50)
    return rounded(out.select("community", "model", "term", "b", "se", "t", "r2", "n"), t=4)


@query(
    f"""WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice / 100000 AS v, CAST(o_orderstatus = 'F' AS DOUBLE) AS is_f, CAST(o_orderpriority = '1-URGENT' AS DOUBLE) AS is_urgent FROM orders),
    {_ols2('y', 'v', 'is_f', 'is_urgent', 'year')} SELECT * FROM ({' UNION ALL '.join(
        f"SELECT year, '{t}' AS term, {rnd(f'b{i}')} AS b, {rnd(f'se{i}')} AS se, {rnd('r2')} AS r2, CAST(n AS BIGINT) AS n FROM o WHERE n >= 100" for i, t in enumerate(('Intercept', 'is_f', 'is_urgent')))})"""
)
def models_by_year(spark, sf):
    df = roles.table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("year"), (F.col("o_totalprice") / 100000).alias("v"),
        (F.col("o_orderstatus") == "F").cast("double").alias("is_f"), (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("is_urgent"),
    )
    out = M.fit_models(df, "v", {"model": ["is_f", "is_urgent"]}, ["year"], 100)
    return rounded(out.select("year", "term", "b", "se", "r2", "n"))


_LOSO = f"""al AS (SELECT {_r2_sql('score_mean', 'score_std', 'emotion_joy')} AS r FROM users), g AS (SELECT community, count(*) AS n FROM users GROUP BY community HAVING count(*) >= 100),
    lo AS (SELECT g.community AS excluded, count(*) AS n, {_r2_sql('score_mean', 'score_std', 'emotion_joy')} AS r2 FROM g JOIN users u ON u.community <> g.community GROUP BY g.community)"""


@query(f"WITH {U}, {_LOSO} SELECT excluded, n, {rnd('r2', 8)} AS r2, {rnd('r2 - r', 8)} AS r2_change FROM lo, al")
def leave_one_community_out(spark, sf):
    return rounded(M.leave_one_group_out(roles.users(spark, sf), "score_mean", ["score_std", "emotion_joy"], "community"), 8)


@query(f"WITH {U}, {_LOSO} SELECT count(*) AS n_runs, {rnd('max(r2) - min(r2)', 8)} AS r2_range, {rnd('stddev_pop(r2)', 8)} AS r2_sd, {rnd('avg(r2)', 8)} AS r2_mean, max(r2) - min(r2) < 0.001 AS stable FROM lo")
def community_stability(spark, sf):
    runs = M.leave_one_group_out(roles.users(spark, sf), "score_mean", ["score_std", "emotion_joy"], "community")
    return rounded(M.stability(runs), 8)


@query(
    f"""WITH {U}, {_D}, k AS (SELECT * FROM d WHERE community IN (SELECT community FROM d GROUP BY community HAVING count(*) >= 100)),
    w AS (SELECT k.*, score_mean - avg(score_mean) OVER (PARTITION BY community) AS y0, score_std - avg(score_std) OVER (PARTITION BY community) AS a0, is_female - avg(is_female) OVER (PARTITION BY community) AS b0 FROM k),
    s AS (SELECT count(*) AS n, count(DISTINCT community) AS k, {_r2_sql('score_mean', 'score_std', FEMALE)} AS demo, var_pop(y0) / var_pop(score_mean) AS wshare, {_r2_sql('y0', 'a0', 'b0')} AS inner_r2 FROM w),
    r AS (SELECT n, k, demo, 1 - wshare AS grp, 1 - wshare * (1 - inner_r2) AS joint FROM s)
    SELECT n, k AS n_groups, {rnd('demo', 8)} AS r2_predictors, {rnd('grp', 8)} AS r2_group, {rnd("joint", 8)} AS r2_both, {rnd('grp / demo', 5)} AS ratio, {rnd('joint - grp', 8)} AS delta_predictors, {rnd('joint - demo', 8)} AS delta_group FROM r"""
)
def variance_explained(spark, sf):
    return rounded(M.variance_explained(design(spark, sf), "score_mean", ["score_std", FEMALE], "community"), 8, ratio=5)


@query(
    f"WITH {U}, {_D}, base AS (SELECT pow(corr(score_mean, is_teen), 2) AS r FROM d), "
    + "all_models AS ("
    + " UNION ALL ".join(
        f"SELECT 'only_{e}' AS model, '{e}' AS feature, count(*) AS n, {_r2_sql('score_mean', TEEN, e)} AS r2, "
        f"(covar_pop({e}, score_mean) * var_pop(is_teen) - covar_pop(is_teen, score_mean) * covar_pop(is_teen, {e})) / (var_pop(is_teen) * var_pop({e}) - pow(covar_pop(is_teen, {e}), 2)) AS b FROM d"
        for e in roles.USER_EMOTIONS
    )
    + f") SELECT model, {rnd('b')} AS b, {rnd('r2', 8)} AS r2, {rnd('r2 - r', 8)} AS delta_r2, n FROM all_models, base"
)
def single_emotion_models(spark, sf):
    out = MD.compositional(design(spark, sf), "score_mean", [TEEN], roles.USER_EMOTIONS, "emotion_neutral")
    out = out.where("model LIKE 'only_%' AND model = concat('only_', term)")
    return rounded(out.select("model", "b", "r2", "delta_r2", "n"), r2=8, delta_r2=8)


@query()
def compositional_models(spark, sf):
    """Reference-dropped, log-ratio and one-at-a-time regressions on emotion shares."""
    return rounded(MD.compositional(design(spark, sf), "score_mean", [TEEN, FEMALE], roles.USER_EMOTIONS, "emotion_neutral"))


_REL = """rel AS (SELECT avg(CAST(age_predicted = (CASE WHEN score_mean > 2.5 THEN 'teen' ELSE 'adult' END) AS INTEGER)) AS teen, avg(CAST(gender_predicted = (CASE WHEN balance > 4500 THEN 'female' ELSE 'male' END) AS INTEGER)) AS female FROM users)"""


@query(f"WITH {U}, {_REL} SELECT 'is_teen' AS term, (SELECT count(*) FROM users) AS n, {rnd('teen')} AS reliability FROM rel UNION ALL SELECT 'is_female', (SELECT count(*) FROM users), {rnd('female')} FROM rel")
def classification_reliability(spark, sf):
    return rounded(_reliability(spark, sf))


def _reliability(spark, sf):
    df = roles.users(spark, sf)
    pairs = {
        TEEN: (F.col("age_predicted"), F.when(F.col("score_mean") > 2.5, "teen").otherwise("adult")),
        FEMALE: (F.col("gender_predicted"), F.when(F.col("balance") > 4500, "female").otherwise("male")),
    }
    return MD.reliability(df, pairs).withColumnRenamed("variable", "term")


@query(
    f"""WITH {U}, {_D}, {_REL}, {_ols2('d', 'score_mean', TEEN, FEMALE)}, t AS (SELECT 'Intercept' AS term, b0 AS b, r2, 1.0::DOUBLE AS rel FROM o UNION ALL SELECT 'is_teen', b1, r2, teen FROM o, rel UNION ALL SELECT 'is_female', b2, r2, female FROM o, rel)
    SELECT term, {rnd('b')} AS b, {rnd('b / rel')} AS b_corrected, {rnd('least(1, r2 / rel)', 8)} AS r2_corrected, {rnd('1 - rel')} AS attenuation FROM t"""
)
def measurement_error_correction(spark, sf):
    terms = M.fit_models(design(spark, sf), "score_mean", {"m": [TEEN, FEMALE]}).select("term", "b", "r2")
    out = MD.attenuation_corrected(terms, _reliability(spark, sf).select("term", "reliability"))
    return rounded(out.select("term", "b", "b_corrected", "r2_corrected", "attenuation"), r2_corrected=8)


@query(f"WITH {U}, {_D}, nz AS (SELECT * FROM d WHERE n_high > 0), {_ols2('nz', 'score_mean', TEEN, FEMALE)} SELECT 'nonzero' AS model, * FROM ({_terms(TEEN, FEMALE)})")
def nonzero_subsample_model(spark, sf):
    out = M.fit_models(design(spark, sf).where("n_high > 0"), "score_mean", {"nonzero": [TEEN, FEMALE]})
    return rounded(out.drop("ci_low", "ci_high"), **_DIGITS)


@query()
def missing_data_models(spark, sf):
    """Complete cases against unknown as a category."""
    return rounded(MD.missing_models(with_missing(spark, sf), "score_mean", "age_bucket", "gender", ["adult", "teen"], ["male", "female"]))


@query()
def power_analysis(spark, sf):
    return rounded(MD.power_table(roles.users(spark, sf), ["community", "age_predicted"], reliability=0.8))


# ---- resampling -----------------------------------------------------------------------------

REPS, BLOCKS = 2000, 4096


def _ladder(u: str) -> str:
    import math

    parts, c = [], 0.0
    for k in range(12):
        c += math.exp(-1.0) / math.factorial(k)
        parts.append(f"WHEN {u} < {c!r}::DOUBLE THEN {k}")
    return f"CASE {' '.join(parts)} ELSE 12 END"


def _block(key: str) -> str:
    hashed = f"'42:' || CAST({key} AS VARCHAR)"
    return f"CAST(floor({Q.uniform(hashed)} * {BLOCKS}) AS INTEGER)"


_BKEY = "'42:' || CAST(block AS VARCHAR) || ':' || CAST(run AS VARCHAR)"
_SKEY = "'42:' || CAST(block AS VARCHAR) || ':' || side || ':' || CAST(run AS VARCHAR)"


@query(
    f"""WITH {U}, b AS (SELECT {_block('author')} AS block, CASE WHEN age_predicted = 'teen' THEN 'a' ELSE 'b' END AS side, count(*) AS n, sum(score_mean) AS s FROM users GROUP BY ALL),
    x AS (SELECT run, side, n, s, {_ladder(Q.uniform(_SKEY))} AS w FROM b, range(0, {REPS}) t(run)),
    d AS (SELECT run, sum(w * s) FILTER (WHERE side = 'a') / sum(w * n) FILTER (WHERE side = 'a') - sum(w * s) FILTER (WHERE side = 'b') / sum(w * n) FILTER (WHERE side = 'b') AS d FROM x GROUP BY run)
    SELECT count(*) AS runs, {rnd('avg(d)')} AS mean, {rnd('quantile_cont(d, 0.025)')} AS ci_low, {rnd('quantile_cont(d, 0.975)')} AS ci_high FROM d"""
)
def bootstrap_age_difference(spark, sf):
    return rounded(
        M.bootstrap_mean_difference(roles.users(spark, sf), "age_predicted", "teen", "adult", "score_mean", "author", REPS, BLOCKS)
    )


def _runs(x: str) -> str:
    return f"""b AS (SELECT {_block('author')} AS block, {x} AS x, score_mean AS y FROM users), wt AS (SELECT block, run, {_ladder(Q.uniform(_BKEY))} AS w FROM range(0, {BLOCKS}) k(block), range(0, {REPS}) t(run)),
    m AS (SELECT run, sum(w) AS n, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM b JOIN wt USING (block) GROUP BY run),
    c AS (SELECT run, max(mx) AS mx, max(my) AS my, sum(w * (x - mx) * (y - my)) AS sxy, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (y - my) * (y - my)) AS syy FROM b JOIN wt USING (block) JOIN m USING (run) GROUP BY run)"""


_RUNS = _runs("score_std")


@query(
    f"""WITH {U}, {_RUNS}, r AS (SELECT sxy / sqrt(sxx * syy) AS r FROM c) SELECT count(*) AS runs, {rnd('avg(r)')} AS mean, {rnd('quantile_cont(r, 0.025)')} AS ci_low, {rnd('quantile_cont(r, 0.975)')} AS ci_high FROM r"""
)
def bootstrap_correlation(spark, sf):
    return rounded(M.bootstrap_correlation(roles.users(spark, sf), "score_std", "score_mean", "author", REPS, BLOCKS))


@query(
    f"""WITH {U}, {_RUNS}, t AS (SELECT 'score_std' AS term, sxy / sxx AS b FROM c UNION ALL SELECT 'Intercept', my - sxy / sxx * mx FROM c)
    SELECT term, count(*) AS runs, {rnd('avg(b)')} AS mean, {rnd('stddev_samp(b)')} AS sd, {rnd('abs(stddev_samp(b) / avg(b))', 4)} AS cv, {rnd('quantile_cont(b, 0.025)')} AS ci_low, {rnd('quantile_cont(b, 0.975)')} AS ci_high FROM t GROUP BY term"""
)
def bootstrap_coefficients(spark, sf):
    runs = M.resampled_coefficients(roles.users(spark, sf), "score_mean", ["score_std"], "author", REPS, BLOCKS)
    return rounded(M.summarise_runs(runs), cv=4)


@query(
    f"""WITH {U}, {_REL}, {_runs("CAST(age_predicted = 'teen' AS DOUBLE)")}, t AS (SELECT 'is_teen' AS term, sxy / sxx / teen AS b FROM c, rel UNION ALL SELECT 'Intercept', my - sxy / sxx * mx FROM c)
    SELECT term, count(*) AS runs, {rnd('avg(b)')} AS mean, {rnd('stddev_samp(b)')} AS sd, {rnd('abs(stddev_samp(b) / avg(b))', 4)} AS cv, {rnd('quantile_cont(b, 0.025)')} AS ci_low, {rnd('quantile_cont(b, 0.975)')} AS ci_high FROM t GROUP BY term"""
)
def bootstrap_corrected_coefficients(spark, sf):
    out = MD.corrected_bootstrap(design(spark, sf), "score_mean", [TEEN], _reliability(spark, sf), "author", REPS, BLOCKS)
    return rounded(out, cv=4)


@query(
    f"""WITH {U}, b AS (SELECT {_block('author')} AS block, score_std AS x, score_mean AS y FROM users), c AS (SELECT run, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM b, range(0, 500) t(run) WHERE {Q.uniform(_BKEY)} < 0.8 GROUP BY run),
    t AS (SELECT 'score_std' AS term, b1 AS b FROM c UNION ALL SELECT 'Intercept', b0 FROM c)
    SELECT term, count(*) AS runs, {rnd('avg(b)')} AS mean, {rnd('stddev_samp(b)')} AS sd, {rnd('abs(stddev_samp(b) / avg(b))', 4)} AS cv, {rnd('quantile_cont(b, 0.025)')} AS ci_low, {rnd('quantile_cont(b, 0.975)')} AS ci_high FROM t GROUP BY term"""
)
def subsample_stability(spark, sf):
    runs = M.resampled_coefficients(roles.users(spark, sf), "score_mean", ["score_std"], "author", 500, BLOCKS, 0.8)
    return rounded(M.summarise_runs(runs), cv=4)


@query(
    f"""WITH {U}, b AS (SELECT {_block('author')} AS block, score_std AS x, score_mean AS y FROM users),
    s AS (SELECT * FROM (VALUES (0, 0.01::DOUBLE), (1, 0.05::DOUBLE), (2, 0.1::DOUBLE), (3, 0.2::DOUBLE)) v(i, excluded)), k AS (SELECT i * 10 + t AS run, excluded FROM s, range(0, 10) r(t)),
    c AS (SELECT excluded, run, pow(corr(y, x), 2) AS r2 FROM b, k WHERE {Q.uniform(_BKEY)} < 1 - excluded GROUP BY ALL)
    SELECT excluded, count(*) AS trials, {rnd('avg(r2)', 8)} AS r2_mean, {rnd('stddev_samp(r2)', 8)} AS r2_sd, {rnd('max(r2) - min(r2)', 8)} AS r2_range FROM c GROUP BY excluded"""
)
def random_exclusion(spark, sf):
    return rounded(M.random_exclusion(roles.users(spark, sf), "score_mean", ["score_std"], "author", blocks=BLOCKS), 8)
