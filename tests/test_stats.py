"""Statistics by hand, against numpy brute force, and their invariants."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import cdf
from cohortlens.operators import agreement as V, contingency as CT, gram as M, groups as G, models as MD, ranks


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(42)
    n = 600
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * a - b + rng.standard_t(3, size=n)
    g = rng.integers(0, 3, size=n)
    return spark.createDataFrame(
        [(int(i), float(p), float(q), float(v), int(k)) for i, (p, q, v, k) in enumerate(zip(a, b, y, g))],
        "id long, a double, b double, y double, g int",
    ).cache()


def arrays(people):
    pdf = people.toPandas().sort_values("id")
    return pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["y"].to_numpy(), pdf["g"].to_numpy()


# ---- distributions --------------------------------------------------------------------------


def test_tails():
    assert abs(cdf.t_two_sided(2.228138852, 10) - 0.05) < 1e-9
    assert abs(cdf.f_sf(4.102821015, 2, 10) - 0.05) < 1e-9
    assert abs(cdf.chi2_sf(3.841458821, 1) - 0.05) < 1e-9
    assert abs(cdf.norm_ppf(0.975) - 1.959963985) < 1e-8
    assert abs(cdf.studentised_range_ppf(0.95, 3, 10) - 3.877) < 2e-3
    assert abs(cdf.studentised_range_ppf(0.95, 4, 20) - 3.958) < 2e-3
    assert abs(cdf.kolmogorov_sf(1.358) - 0.05) < 1e-3
    assert abs(cdf.t_two_sided(1.96, 1e9) - 0.04999579) < 1e-6


def test_noncentral_f_by_simulation():
    rng = np.random.default_rng(1)
    d1, d2, nc, n = 5, 94, 15.0, 400000
    x = (rng.noncentral_chisquare(d1, nc, n) / d1) / (rng.chisquare(d2, n) / d2)
    crit = cdf.f_ppf(0.95, d1, d2)
    assert abs((x > crit).mean() - cdf.noncentral_f_sf(crit, d1, d2, nc)) < 4e-3


# ---- ranks ----------------------------------------------------------------------------------


def test_small_rank_tests(spark):
    rows = spark.createDataFrame([("x", v) for v in (1, 2, 2, 3)] + [("y", v) for v in (2, 3, 4)], "g string, v int")
    r = G.rank_tests(rows, "g", "x", "y", "v").head()
    assert r.u_a + r.u_b == 12 and r.u_a == 2.5 and abs(r.cles - 2.5 / 12) < 1e-12
    assert abs(r.ks - 5 / 12) < 1e-12
    t = G.effect_size(G.welch(G.two_groups(rows, "g", "x", "y", "v"))).head()
    pooled = (3 * t.var_a + 2 * t.var_b) / 5
    assert abs(t.d - (2 - 3) / math.sqrt(pooled) * (1 - 3 / 19)) < 1e-12


def test_rank_tests_equal_all_pairs(people):
    a, _, _, g = arrays(people)
    rows = people.withColumn("r", F.round("a", 1))
    x, y = np.round(a[g == 0], 1), np.round(a[g == 1], 1)
    cles = ((x[:, None] > y).sum() + 0.5 * (x[:, None] == y).sum()) / (len(x) * len(y))
    r = G.rank_tests(rows, "g", 0, 1, "r").head()
    assert abs(r.cles - cles) < 1e-12
    grid = np.union1d(x, y)
    ks = max(abs((x <= v).mean() - (y <= v).mean()) for v in grid)
    assert abs(r.ks - ks) < 1e-12


def test_quantiles_match_numpy_for_any_partitioning(people):
    a, *_ = arrays(people)
    probs = {"q1": 0.01, "q2": 0.333, "q3": 0.9}
    for parts in (1, 13):
        r = ranks.quantiles(people.repartition(parts), "a", probs).head()
        assert np.allclose([r.q1, r.q2, r.q3], np.quantile(a, list(probs.values())))


def test_running_totals_with_one_hot_value(spark):
    rows = spark.range(10000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 1.5 - 4000).alias("v"))
    r = ranks.midranks(rows, "v").agg(F.sum(F.col("n") * F.col("rank")), F.max("n")).head()
    assert r[0] == 10000 * 10001 / 2 and r[1] == 3334


# ---- tables ---------------------------------------------------------------------------------


def test_published_table(spark):
    t = spark.createDataFrame([(2214, 734, 11088, 2311)], "a long, b long, c long, d long")
    r = CT.chi2_2x2(t).head()
    assert abs(r.chi2 - 92.8071) < 1e-3 and abs(r.chi2_uncorrected - 93.3112) < 1e-3 and abs(r.cramers_v - 0.07535) < 1e-5


def test_chi2_general_equals_2x2(spark):
    cells = [("t", "m", 20), ("t", "f", 5), ("a", "m", 9), ("a", "f", 30)]
    rows = spark.createDataFrame([(x, y) for x, y, n in cells for _ in range(n)], "x string, y string")
    r = CT.chi2_test(rows, "x", "y").head()
    one = CT.chi2_2x2(spark.createDataFrame([(20, 5, 9, 30)], "a long, b long, c long, d long")).head()
    assert abs(r.chi2 - one.chi2) < 1e-9 and r.dof == 1


def test_kappa(spark):
    def kap(pairs):
        return V.kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b").head()

    assert kap([(1, 1), (2, 2), (3, 3)]).kappa == 1
    assert kap([(2, 2), (2, 2)]).kappa == 1
    assert kap([(1, 2), (2, 1)]).kappa <= 0
    pairs = [(1, 2), (2, 2), (3, 5), (4, 4), (5, 1), (3, 3)]
    r = kap(pairs)
    x = np.array(pairs)
    for power, got in ((1, r.kappa_linear), (2, r.kappa_quadratic)):
        seen = (np.abs(x[:, 0] - x[:, 1]) ** power).mean()
        chance = (np.abs(x[:, 0][:, None] - x[:, 1]) ** power).mean()
        assert abs(got - (1 - seen / chance)) < 1e-12


def test_consensus_rounds_half_to_even(spark):
    wide = spark.createDataFrame([(1, 2, 3, None), (2, 3, 4, None), (3, None, None, None)], "item int, r1 int, r2 int, r3 int")
    got = [r.consensus for r in V.consensus(wide, ["r1", "r2", "r3"]).orderBy("item").collect()]
    assert got == [2, 4, None]


def test_multiple_testing(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "test string, p double")
    got = {r.test: r for r in G.adjust_p(p).collect()}
    assert [round(got[k].p_bonferroni, 10) for k in "abcd"] == [0.04, 0.16, 0.12, 0.02]
    assert [round(got[k].p_bh, 10) for k in "abcd"] == [0.02, 0.04, 0.04, 0.02]
    assert all(r.p_bh >= r.p for r in got.values())


# ---- models ---------------------------------------------------------------------------------


def test_exact_regression(spark):
    rows = spark.createDataFrame([(float(i % 2), float(i // 2 % 2), 1 + 2.0 * (i % 2) - i // 2 % 2) for i in range(8)], "a double, b double, y double")
    got = {r.term: r for r in M.fit_models(rows, "y", {"m": ["a", "b"]}).collect()}
    assert np.allclose([got["Intercept"].b, got["a"].b, got["b"].b], [1, 2, -1])
    assert abs(got["a"].r2 - 1) < 1e-12 and abs(got["a"].vif - 1) < 1e-12


def ols(x, y):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ b
    return b, e


def test_ols_hc3_cook_against_numpy(people):
    a, b, y, _ = arrays(people)
    x = np.column_stack([np.ones_like(a), a, b])
    beta, e = ols(x, y)
    inv = np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    s2 = e @ e / (len(y) - 3)
    got = {r.term: r for r in M.fit_models(people, "y", {"m": ["a", "b"]}).collect()}
    assert np.allclose([got[t].b for t in ("Intercept", "a", "b")], beta)
    assert np.allclose([got[t].se for t in ("Intercept", "a", "b")], np.sqrt(s2 * np.diag(inv)))
    hc3 = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    rob = {r.term: r for r in M.robust_se(people, "y", ["a", "b"]).collect()}
    assert np.allclose([rob[t].se_hc3 for t in ("Intercept", "a", "b")], np.sqrt(np.diag(hc3)))
    cook = e**2 * h / (3 * s2 * (1 - h) ** 2)
    inf = M.with_influence(people, "y", ["a", "b"]).orderBy("id").toPandas()
    assert np.allclose(inf["cooks_d"], cook) and np.allclose(inf["leverage"], h)
    _, e2 = ols(x, e**2)
    lm = len(y) * (1 - (e2 @ e2) / ((e**2 - (e**2).mean()) ** 2).sum())
    assert abs(M.breusch_pagan(people, "y", ["a", "b"]).head().lm - lm) < 1e-6


def test_leave_one_out_equals_refit(people):
    for r in M.leave_one_group_out(people, "y", ["a", "b"], "g", 10).collect():
        again = M.fit_models(people.where(F.col("g") != r.excluded), "y", {"m": ["a", "b"]}).head()
        assert abs(again.r2 - r.r2) < 1e-12 and again.n == r.n


def test_unit_weights_give_the_total(people):
    blocks = M.block_grams(people, "y", ["a", "b"], "id", 37)
    one = people.sparkSession.range(1).select(F.col("id").cast("int").alias("run"))
    got = M.reweighted(blocks, 3, lambda b, r: F.lit(1), one).head()
    want = M.gram(people, "y", ["a", "b"]).head()
    assert got.n == want.n and np.allclose(got.mean, want.mean) and np.allclose(got.co, want.co)


def test_group_dummies_equal_absorbed_effects(people):
    d = people.withColumns({"g1": (F.col("g") == 1).cast("double"), "g2": (F.col("g") == 2).cast("double")})
    full = M.fit_models(d, "y", {"m": ["a", "g1", "g2"]}).head().r2
    assert abs(M.variance_explained(people, "y", ["a"], "g", 10).head().r2_both - full) < 1e-12


def test_bootstrap_interval_matches_row_bootstrap(people):
    a, b, y, _ = arrays(people)
    rng = np.random.default_rng(0)
    slopes = []
    for _ in range(600):
        i = rng.integers(0, len(y), len(y))
        slopes.append(np.polyfit(a[i], y[i], 1)[0])
    runs = M.resampled_coefficients(people, "y", ["a"], "id", 600, 4096)
    r = M.summarise_runs(runs).where("term = 'a'").head()
    assert abs(r.sd - np.std(slopes)) < 0.2 * np.std(slopes) and abs(r.mean - np.mean(slopes)) < 0.3 * np.std(slopes)


def test_huber_against_numpy(people):
    a, b, y, _ = arrays(people)
    x = np.column_stack([np.ones_like(a), a, b])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(100):
        e = y - x @ beta
        s = np.median(np.abs(e)) / 0.6744897501960817
        w = np.minimum(1, 1.345 * s / np.maximum(np.abs(e), 1e-300))
        beta = np.linalg.solve((x.T * w) @ x, (x.T * w) @ y)
    got = {r.term: r.b for r in MD.huber(people, "y", ["a", "b"]).collect()}
    assert np.allclose([got[t] for t in ("Intercept", "a", "b")], beta, atol=1e-6)


def test_logistic_against_newton(people):
    a, b, y, _ = arrays(people)
    x, t = np.column_stack([np.ones_like(a), a, b]), (y > 1).astype(float)
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (t - p))
    got = {r.term: r for r in MD.logistic(people.withColumn("hi", (F.col("y") > 1).cast("double")), "hi", ["a", "b"]).collect()}
    assert np.allclose([got[k].b for k in ("Intercept", "a", "b")], beta, atol=1e-5)
    se = np.sqrt(np.diag(np.linalg.inv((x.T * (p * (1 - p))) @ x)))
    assert np.allclose([got[k].se for k in ("Intercept", "a", "b")], se, atol=1e-5)


def test_logistic_finds_separation(spark):
    rng = np.random.default_rng(4)
    rows = [(float(x), float(z), float(x > 0.2)) for x, z in rng.normal(size=(200, 2))]
    got = {r.term: r for r in MD.logistic(spark.createDataFrame(rows, "x double, z double, y double"), "y", ["x", "z"]).collect()}
    assert all(r.separated for r in got.values()) and got["x"].b == math.inf and got["x"].se is None
    # one level of a column without a single 1: only its coefficient (and what it is compared with) has no value
    rows = [(float(i % 2), float(z), float(i % 2 == 1 and rng.random() < 1 / (1 + np.exp(-z)))) for i, z in enumerate(rng.normal(size=400))]
    got = {r.term: r for r in MD.logistic(spark.createDataFrame(rows, "x double, z double, y double"), "y", ["x", "z"]).collect()}
    assert got["x"].b == math.inf and got["Intercept"].b == -math.inf and got["z"].separated and 0.5 < got["z"].b < 1.6 and got["z"].se > 0
    alike = spark.createDataFrame([(float(i % 3), 1.0) for i in range(30)], "x double, y double")
    assert all(r.separated for r in MD.logistic(alike, "y", ["x"]).where("term = 'Intercept'").collect())


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40 + [7.0] * 40, list(np.random.default_rng(1).exponential(size=501)), [0.0] * 9 + [1e12, 1e-12]])
def test_exact_middle(spark, values, monkeypatch):
    monkeypatch.setattr(MD, "BINS", 4)
    monkeypatch.setattr(MD, "HELD", 3)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    for around in ((0.0, 1.0), (0.9, 1.1), (100.0, 100.0)):
        assert MD._middle(rows, "v", *around) == np.median(values)


def test_power_grows_with_n(spark):
    rows = spark.createDataFrame([("s",)] * 60 + [("l",)] * 400, "seg string")
    got = {(r.seg, r.f2): r for r in MD.power_table(rows, ["seg"], reliability=0.7).collect()}
    assert got["l", 0.02].power > got["s", 0.02].power and got["l", 0.02].detectable_f2 < got["s", 0.02].detectable_f2
    assert all(0 <= r.power <= r.power_no_error <= 1 for r in got.values())


def test_attenuation(spark):
    terms = spark.createDataFrame([("x", 0.3, 0.4)], "term string, b double, r2 double")
    r = MD.attenuation_corrected(terms, {"x": 0.5}).head()
    assert (r.b_corrected, r.r2_corrected, r.attenuation) == (0.6, 0.8, 0.5)


def test_normal_scores(people):
    from cohortlens.operators import classify as K

    z = [r.z for r in K.normal_scores(people, "y", "z").select("z").collect()]
    inner = [v for v in z if abs(v) < 4]
    assert abs(np.mean(inner)) < 0.05 and abs(np.std(inner) - 1) < 0.1
