"""Queries comparing groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import lexicons as L, scalar as S, text as T
from cohortlens.operators import contingency as CT, groups as G, ranks
from cohortlens.plans import roles, sqltext as Q
from cohortlens.plans.registry import query, rounded

rnd = Q.rnd
U = roles.USERS_SQL

# ---- SQL pieces -----------------------------------------------------------------------------


def _two_sql(name: str, source: str, group: str, a: str, b: str, value: str, by: str = "") -> str:
    """CTE with n, mean, variance of both groups, diff, Welch and pooled statistics and effect sizes."""
    sel, grp = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    parts = ", ".join(
        f"count({value}) FILTER (WHERE {group} = {lvl}) AS n_{s}, avg({value}) FILTER (WHERE {group} = {lvl}) AS mean_{s}, "
        f"var_samp({value}) FILTER (WHERE {group} = {lvl}) AS var_{s}"
        for s, lvl in (("a", a), ("b", b))
    )
    return f"""{name}0 AS (SELECT {sel}{parts} FROM {source} WHERE {group} IN ({a}, {b}) {grp}),
    {name}1 AS (SELECT *, sqrt(var_a) AS sd_a, sqrt(var_b) AS sd_b, mean_a - mean_b AS diff, var_a / n_a AS sa, var_b / n_b AS sb,
      ((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) AS pooled FROM {name}0),
    {name} AS (SELECT *, diff / nullif(sqrt(sa + sb), 0) AS welch_t, (sa + sb) * (sa + sb) / nullif(sa * sa / (n_a - 1) + sb * sb / (n_b - 1), 0) AS welch_df,
      diff / nullif(sqrt(pooled * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b)), 0) AS student_t, CAST(n_a + n_b - 2 AS DOUBLE) AS student_df,
      CASE WHEN pooled = 0 THEN 0 ELSE diff / sqrt(pooled) * (1 - 3.0::DOUBLE / (4 * (n_a + n_b) - 9)) END AS d,
      diff / nullif(sqrt((var_a + var_b) / 2), 0) AS d_plain FROM {name}1)"""


_LABEL = "CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END"
_BASE = ", ".join(["n_a", "n_b"] + [f"{rnd(c)} AS {c}" for c in ("mean_a", "var_a", "mean_b", "var_b", "sd_a", "sd_b", "diff")])
_WELCH = f"{_BASE}, {rnd('welch_t')} AS t, {rnd('welch_df', 4)} AS df, {rnd(Q.p_t('welch_t', 'welch_df'), 5)} AS p"
_STUDENT = f"{_BASE}, {rnd('student_t')} AS t, {rnd('student_df')} AS df, {rnd(Q.p_t('student_t', 'student_df'), 5)} AS p"
_EFFECT = f"{rnd('d')} AS d, {rnd('d_plain')} AS d_plain, {_LABEL} AS d_label"


def _tidy(df, **special):
    return rounded(df, **{"df": 4, "p": 5, **special})


# ---- two groups -----------------------------------------------------------------------------


@query(
    f"""WITH {U}, {_two_sql('s', 'users', 'age_predicted', "'teen'", "'adult'", 'score_mean')}
    SELECT {_WELCH}, {_EFFECT}, (SELECT {rnd('median(score_mean)', 12)} FROM users WHERE age_predicted = 'teen') AS median_a,
      (SELECT {rnd('median(score_mean)', 12)} FROM users WHERE age_predicted = 'adult') AS median_b FROM s"""
)
def age_effect(spark, sf):
    """Welch test, effect size and medians of the age groups."""
    return _tidy(G.group_test(roles.users(spark, sf), "age_predicted", "teen", "adult", "score_mean"), median_a=12, median_b=12)


@query(
    f"""WITH f AS (SELECT o_orderpriority, o_orderstatus, o_totalprice / 100000 AS v FROM orders),
    {_two_sql('s', 'f', 'o_orderstatus', "'F'", "'O'", 'v', 'o_orderpriority')}
    SELECT o_orderpriority, {_STUDENT}, {_EFFECT} FROM s"""
)
def student_by_segment(spark, sf):
    df = roles.table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_totalprice") / 100000).alias("v"))
    return _tidy(G.effect_size(G.student(G.two_groups(df, "o_orderstatus", "F", "O", "v", ["o_orderpriority"]))))


def _rank_sql(source: str, group: str, a: str, b: str, value: str) -> str:
    return f"""x AS (SELECT {group} = {a} AS is_a, {value} AS v FROM {source} WHERE {group} IN ({a}, {b})),
    r AS (SELECT is_a, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS mid,
      rank() OVER (PARTITION BY is_a ORDER BY v) + (count(*) OVER (PARTITION BY is_a, v) - 1) / 2 AS own, count(*) OVER () AS n FROM x),
    ks AS (SELECT max(abs(fa - fb)) AS ks FROM (SELECT v, sum(sum(CAST(is_a AS INTEGER))) OVER (ORDER BY v) / CAST(sum(sum(CAST(is_a AS INTEGER))) OVER () AS DOUBLE) AS fa,
      sum(sum(CAST(NOT is_a AS INTEGER))) OVER (ORDER BY v) / CAST(sum(sum(CAST(NOT is_a AS INTEGER))) OVER () AS DOUBLE) AS fb FROM x GROUP BY v)),
    tie AS (SELECT CAST(sum(pow(c, 3) - c) AS DOUBLE) AS tie FROM (SELECT count(*) AS c FROM x GROUP BY v)),
    g AS (SELECT CAST(count(*) FILTER (WHERE is_a) AS DOUBLE) AS n_a, CAST(count(*) FILTER (WHERE NOT is_a) AS DOUBLE) AS n_b, sum(mid) FILTER (WHERE is_a) AS ra,
      avg(mid) FILTER (WHERE is_a) AS ma, avg(mid) FILTER (WHERE NOT is_a) AS mb, var_samp(mid - own) FILTER (WHERE is_a) AS va,
      var_samp(mid - own) FILTER (WHERE NOT is_a) AS vb FROM r),
    s AS (SELECT *, ra - n_a * (n_a + 1) / 2 AS u_a, n_a * n_b - (ra - n_a * (n_a + 1) / 2) AS u_b, n_a + n_b AS n FROM g, ks, tie),
    z AS (SELECT *, greatest(0, (greatest(u_a, u_b) - n_a * n_b / 2 - 0.5) / sqrt(n_a * n_b / 12 * ((n + 1) - tie / (n * (n - 1))))) AS u_z,
      n_a * n_b * (mb - ma) / (n * sqrt(n_a * va + n_b * vb)) AS bm,
      pow(n_a * va + n_b * vb, 2) / (pow(n_a * va, 2) / (n_a - 1) + pow(n_b * vb, 2) / (n_b - 1)) AS bm_df FROM s)
    SELECT n_a, n_b, {rnd('u_a', 1)} AS u_a, {rnd('u_b', 1)} AS u_b, {rnd('u_z')} AS u_z, {rnd(Q.p_norm('u_z'), 5)} AS u_p, {rnd('u_a / (n_a * n_b)')} AS cles,
      {rnd('bm')} AS bm, {rnd('bm_df', 3)} AS bm_df, {rnd(Q.p_t('bm', 'bm_df'), 5)} AS bm_p, {rnd('ks')} AS ks,
      {rnd("(SELECT CASE WHEN ks * sqrt(n_a * n_b / n) < 0.3 THEN 1 ELSE least(1, 2 * sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * k * k * ks * ks * n_a * n_b / n))) END FROM range(1, 101) t(k))", 5)} AS ks_p FROM z"""


_RANK_DIGITS = dict(u_a=1, u_b=1, u_p=5, bm_df=3, bm_p=5, ks_p=5)


@query(f"WITH {U}, {_rank_sql('users', 'age_predicted', chr(39) + 'teen' + chr(39), chr(39) + 'adult' + chr(39), 'score_mean')}")
def age_rank_tests(spark, sf):
    return rounded(G.rank_tests(roles.users(spark, sf), "age_predicted", "teen", "adult", "score_mean"), **_RANK_DIGITS)


@query(f"WITH {_rank_sql('lineitem', 'l_returnflag', chr(39) + 'A' + chr(39), chr(39) + 'R' + chr(39), 'l_quantity')}")
def tied_rank_tests(spark, sf):
    """Heavily tied values: 50 distinct quantities over all line items."""
    return rounded(G.rank_tests(roles.table(spark, sf, "lineitem"), "l_returnflag", "A", "R", "l_quantity"), **_RANK_DIGITS)


_PAIR = f"""pair AS (SELECT a.item, a.score AS x, g.score AS y FROM algorithm a JOIN (SELECT * FROM ratings WHERE rater = 'alpha') g USING (item))"""


def _pairs(spark, sf):
    """Two score versions per item."""
    r = roles.ratings(spark, sf).where("rater = 'alpha'").select("item", F.col("score").alias("y"))
    return roles.algorithm(spark, sf).select("item", F.col("score").alias("x")).join(r, "item")


@query(
    f"""WITH {roles.RATINGS_SQL}, {_PAIR}, d AS (SELECT CAST(y - x AS DOUBLE) AS d FROM pair),
    r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS mid FROM d WHERE d <> 0),
    tie AS (SELECT sum(pow(c, 3) - c) AS tie FROM (SELECT count(*) AS c FROM d WHERE d <> 0 GROUP BY abs(d))),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS m, sum(mid) FILTER (WHERE d > 0) AS wp, sum(mid) FILTER (WHERE d < 0) AS wm FROM r),
    z AS (SELECT *, (least(wp, wm) - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - tie / 2) / 24) AS z FROM s, tie)
    SELECT (SELECT count(*) FROM d) AS n_pairs, (SELECT {rnd('avg(d) / stddev_samp(d)')} FROM d) AS d_paired, m AS n_nonzero, {rnd('wp', 1)} AS w_plus,
      {rnd('wm', 1)} AS w_minus, {rnd('least(wp, wm)', 1)} AS w, {rnd('z')} AS z, {rnd(Q.p_norm('z'), 5)} AS p FROM z"""
)
def signed_rank_test(spark, sf):
    return rounded(G.signed_rank(_pairs(spark, sf), "x", "y"), w_plus=1, w_minus=1, w=1, p=5)


_PEER_SQL = """peer AS (SELECT c_nationkey AS nation, c_mktsegment = 'BUILDING' AS is_a, round(c_acctbal / 100) AS v,
    CAST(c_custkey % 21 - floor(c_acctbal / 500) AS DOUBLE) AS d FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))"""


def _peers(spark, sf):
    """Customers of two segments by nation: groups small enough to count their rank statistics."""
    c = roles.table(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.select(
        F.col("c_nationkey").alias("nation"), "c_mktsegment", F.round(F.col("c_acctbal") / 100).alias("v"),
        F.floor(F.col("c_acctbal") / 500).cast("double").alias("x"), (F.col("c_custkey") % 21).cast("double").alias("y"),
    )


@query(
    f"""WITH RECURSIVE {_PEER_SQL},
    item AS (SELECT nation, is_a, CAST(2 * rank() OVER g + count(*) OVER (PARTITION BY nation, v) - 1 AS BIGINT) AS r2,
        row_number() OVER (PARTITION BY nation ORDER BY v) AS i FROM peer WINDOW g AS (PARTITION BY nation ORDER BY v)),
    size AS (SELECT nation, count(*) AS n, count(*) FILTER (WHERE is_a) AS n_a, count(*) FILTER (WHERE NOT is_a) AS n_b, sum(r2) FILTER (WHERE is_a) AS w2 FROM item GROUP BY nation),
    ways(nation, i, k, s, w) AS (SELECT nation, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM size UNION ALL
        SELECT w.nation, w.i + 1, w.k + t.take, CAST(w.s + t.take * any_value(item.r2) AS BIGINT), sum(w.w) / 2 FROM ways w JOIN size z USING (nation)
        JOIN item ON item.nation = w.nation AND item.i = w.i + 1, (SELECT unnest([0, 1]) AS take) t WHERE w.k + t.take <= z.n_a GROUP BY w.nation, w.i, w.k, w.s, t.take),
    last AS (SELECT nation, s, sum(w) AS w FROM ways JOIN size USING (nation) WHERE i = n AND k = n_a GROUP BY nation, s),
    mw AS (SELECT nation, least(1, 2 * least(sum(w) FILTER (WHERE s <= w2), sum(w) FILTER (WHERE s >= w2)) / sum(w)) AS u_p FROM last JOIN size USING (nation) GROUP BY nation),
    d AS (SELECT nation, CAST(round(max(abs(fa * n_b - fb * n_a))) AS BIGINT) AS d FROM (SELECT nation, v,
        sum(sum(CAST(is_a AS INTEGER))) OVER w AS fa, sum(sum(CAST(NOT is_a AS INTEGER))) OVER w AS fb FROM peer GROUP BY nation, v WINDOW w AS (PARTITION BY nation ORDER BY v)) JOIN size USING (nation) GROUP BY nation),
    touched(nation, s, i, b) AS (SELECT nation, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE FROM size UNION ALL
        SELECT nation, s, i, CASE WHEN any_value(abs(i * n_b - (s - i) * n_a) >= d) THEN 1.0 ELSE sum(b) END FROM (
            SELECT t.nation, t.s + 1 AS s, t.i + e.up AS i, t.b * CASE e.up WHEN 1 THEN t.i + 1 ELSE t.s + 1 - t.i END / (t.s + 1) AS b, n_a, n_b, d
            FROM touched t JOIN size USING (nation) JOIN d USING (nation), (SELECT unnest([0, 1]) AS up) e WHERE t.i + e.up <= n_a AND t.s + 1 - t.i - e.up <= n_b) GROUP BY nation, s, i)
    SELECT z.nation, CAST(n_a AS DOUBLE) AS n_a, CAST(n_b AS DOUBLE) AS n_b, {rnd('w2 / 2.0::DOUBLE - n_a * (n_a + 1) / 2.0::DOUBLE', 1)} AS u_a, {rnd('u_p')} AS u_p, {rnd('d / CAST(n_a * n_b AS DOUBLE)')} AS ks, {rnd('least(1, b)')} AS ks_p
    FROM size z JOIN mw USING (nation) JOIN d USING (nation) JOIN touched t ON t.nation = z.nation AND t.s = n AND t.i = n_a WHERE n <= 200"""
)
def exact_rank_tests(spark, sf):
    """Counted p-values, with ties, for every nation of at most 200 customers in the two segments."""
    out = G.rank_tests(_peers(spark, sf), "c_mktsegment", "BUILDING", "MACHINERY", "v", ["nation"], method="exact").where("n_a > 0 AND n_b > 0 AND n_a + n_b <= 200")
    return rounded(out.select("nation", "n_a", "n_b", "u_a", "u_p", "ks", "ks_p"), u_a=1)


@query(
    f"""WITH RECURSIVE {_PEER_SQL}, item AS (SELECT nation, d > 0 AS up, CAST(2 * rank() OVER g + count(*) OVER (PARTITION BY nation, abs(d)) - 1 AS BIGINT) AS r2,
        row_number() OVER (PARTITION BY nation ORDER BY abs(d)) AS i FROM peer WHERE d <> 0 WINDOW g AS (PARTITION BY nation ORDER BY abs(d))),
    size AS (SELECT nation, count(*) AS n, coalesce(sum(r2) FILTER (WHERE up), 0) AS w2, sum(r2) AS all2 FROM item GROUP BY nation),
    ways(nation, i, s, w) AS (SELECT nation, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM size UNION ALL
        SELECT w.nation, w.i + 1, CAST(w.s + t.take * item.r2 AS BIGINT) AS s, sum(w.w) / 2 FROM ways w JOIN item ON item.nation = w.nation AND item.i = w.i + 1,
        (SELECT unnest([0, 1]) AS take) t GROUP BY w.nation, w.i, w.s + t.take * item.r2)
    SELECT nation, CAST(n AS DOUBLE) AS n_nonzero, {rnd('w2 / 2.0::DOUBLE', 1)} AS w_plus, {rnd('(all2 - w2) / 2.0::DOUBLE', 1)} AS w_minus,
        {rnd('least(1, 2 * least(sum(w) FILTER (WHERE s <= w2), sum(w) FILTER (WHERE s >= w2)))')} AS p
    FROM ways JOIN size USING (nation) WHERE i = n AND n <= 500 GROUP BY ALL"""
)
def exact_signed_rank(spark, sf):
    out = G.signed_rank(_peers(spark, sf), "x", "y", ["nation"], method="exact").where("n_nonzero <= 500")
    return rounded(out.select("nation", "n_nonzero", "w_plus", "w_minus", "p"), w_plus=1, w_minus=1)


_LEV = """m AS (SELECT segment, median(score_mean) AS med, var_samp(score_mean) AS var FROM users GROUP BY segment),
    z AS (SELECT u.segment, abs(score_mean - med) AS z FROM users u JOIN m USING (segment)),
    g AS (SELECT segment, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY segment),
    t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum((n - 1) * v) AS w, sum(n * m) / sum(n) AS gm FROM g),
    s AS (SELECT t.n, t.k, t.w AS ssw, (SELECT sum(g.n * pow(g.m - t.gm, 2)) FROM g) AS ssb FROM t),
    f AS (SELECT n, k, k - 1 AS df_between, n - k AS df_within, (ssb / (k - 1)) / (ssw / (n - k)) AS w FROM s)"""


@query(
    f"""WITH {U}, {_LEV} SELECT n, k, (SELECT {rnd('max(var) / min(var)')} FROM m) AS variance_ratio, {rnd('w')} AS w, df_between, df_within,
    {rnd(Q.p_f('w', 'df_between', 'df_within'), 5)} AS p FROM f"""
)
def levene_test(spark, sf):
    return rounded(G.levene(roles.users(spark, sf), "segment", "score_mean"), p=5)


# ---- many groups ----------------------------------------------------------------------------


@query(
    f"""WITH {U}, g AS (SELECT community, count(*) AS n, avg(score_mean) AS m, var_samp(score_mean) AS v FROM users GROUP BY community HAVING count(*) >= 100),
    t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum((n - 1) * v) AS ssw, sum(n * m) / sum(n) AS gm FROM g),
    s AS (SELECT n, k, ssw, (SELECT sum(g.n * pow(g.m - t.gm, 2)) FROM g) AS ssb FROM t),
    f AS (SELECT *, (ssb / (k - 1)) / (ssw / (n - k)) AS f, k - 1 AS df_between, n - k AS df_within FROM s)
    SELECT n, k, {rnd('ssb + ssw')} AS ss_total, {rnd('ssw')} AS ss_within, {rnd('ssb')} AS ss_between, {rnd('f')} AS f, df_between, df_within,
      {rnd('ssb / (ssb + ssw)')} AS eta_squared, {rnd(Q.p_f('f', 'df_between', 'df_within'), 5)} AS p FROM f"""
)
def community_anova(spark, sf):
    return rounded(G.one_way(roles.users(spark, sf), "community", "score_mean", 100), p=5)


@query(
    f"""WITH {U}, g AS (SELECT community, count(*) AS n, avg(score_mean) AS m, var_samp(score_mean) AS v FROM users GROUP BY community HAVING count(*) >= 100),
    s AS (SELECT a.community AS community_a, b.community AS community_b, a.n AS n_a, b.n AS n_b, a.m AS mean_a, b.m AS mean_b, a.v AS var_a, b.v AS var_b,
      sqrt(a.v) AS sd_a, sqrt(b.v) AS sd_b, a.m - b.m AS diff, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled FROM g a JOIN g b ON a.community < b.community),
    p AS (SELECT *, diff / sqrt(pooled * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b)) AS student_t, CAST(n_a + n_b - 2 AS DOUBLE) AS student_df,
      diff / sqrt(pooled) * (1 - 3.0::DOUBLE / (4 * (n_a + n_b) - 9)) AS d, diff / sqrt((var_a + var_b) / 2) AS d_plain FROM s)
    SELECT community_a, community_b, {_STUDENT}, {_EFFECT} FROM p"""
)
def community_pairwise(spark, sf):
    return _tidy(G.pairwise(roles.users(spark, sf), "community", "score_mean", 100))


_CELLS = """u AS (SELECT age_predicted AS f1, gender_predicted AS f2, score_mean AS v FROM users), gm AS (SELECT avg(v) AS gm, sum(pow(v - (SELECT avg(v) FROM u), 2)) AS sst, count(*) AS n FROM u),
    a AS (SELECT f1, count(*) AS n, avg(v) AS m FROM u GROUP BY f1), b AS (SELECT f2, count(*) AS n, avg(v) AS m FROM u GROUP BY f2),
    c AS (SELECT f1, f2, count(*) AS n, avg(v) AS m FROM u GROUP BY ALL),
    ss AS (SELECT gm.sst, CAST(gm.n AS DOUBLE) AS n, (SELECT sum(a.n * pow(a.m - gm.gm, 2)) FROM a) AS ss1, (SELECT sum(b.n * pow(b.m - gm.gm, 2)) FROM b) AS ss2,
      (SELECT sum(c.n * pow(c.m - (gm.gm + (a.m - gm.gm) + (b.m - gm.gm)), 2)) FROM c JOIN a USING (f1) JOIN b USING (f2)) AS ss3,
      (SELECT CAST(count(*) AS DOUBLE) FROM a) AS k1, (SELECT CAST(count(*) AS DOUBLE) FROM b) AS k2 FROM gm),
    e AS (SELECT 'age_predicted' AS effect, ss1 AS ss, k1 - 1 AS df, * FROM ss UNION ALL SELECT 'gender_predicted', ss2, k2 - 1, * FROM ss
          UNION ALL SELECT 'interaction', ss3, (k1 - 1) * (k2 - 1), * FROM ss),
    f AS (SELECT effect, ss, df, sst AS ss_total, sst - ss1 - ss2 - ss3 AS ss_residual, n - k1 * k2 AS df_residual, (ss1 + ss2 + ss3) / sst AS r_squared,
      (ss / df) / ((sst - ss1 - ss2 - ss3) / (n - k1 * k2)) AS f FROM e)"""


@query(
    f"""WITH {U}, {_CELLS} SELECT effect, {rnd('ss')} AS ss, df, {rnd('ss_total')} AS ss_total, {rnd('ss_residual')} AS ss_residual, df_residual, {rnd('r_squared')} AS r_squared,
      {rnd('f')} AS f, {rnd('ss / ss_total')} AS eta_squared, {rnd(Q.p_f('f', 'df', 'df_residual'), 5)} AS p FROM f"""
)
def two_way_anova_margins(spark, sf):
    return rounded(G.two_way_margins(roles.users(spark, sf), "age_predicted", "gender_predicted", "score_mean"), p=5)


@query(
    f"""WITH {U}, g AS (SELECT age_predicted || '_' || gender_predicted AS g, count(*) AS n, avg(score_mean) AS m, var_samp(score_mean) AS v FROM users GROUP BY ALL),
    t AS (SELECT CAST(sum(n) - count(*) AS DOUBLE) AS df, sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g)
    SELECT a.g AS group_a, b.g AS group_b, a.n AS n_a, b.n AS n_b, {rnd('b.m - a.m')} AS diff, {rnd('sqrt(mse / 2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n))')} AS se,
      {rnd('abs(b.m - a.m) / sqrt(mse / 2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n))')} AS q, df FROM g a JOIN g b ON a.g < b.g, t"""
)
def tukey_statistics(spark, sf):
    return tukey_hsd(spark, sf).select("group_a", "group_b", "n_a", "n_b", "diff", "se", "q", "df")


@query()
def tukey_hsd(spark, sf):
    """With adjusted p-values and intervals (studentised range; no SQL counterpart)."""
    df = roles.users(spark, sf).withColumn("cell", F.concat_ws("_", "age_predicted", "gender_predicted"))
    return rounded(G.tukey(df, "cell", "score_mean"))


# ---- tables ---------------------------------------------------------------------------------


def _chi_sql(source: str, a: str, b: str) -> str:
    return f"""o AS (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS o FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
    ra AS (SELECT a, sum(o) AS r FROM o GROUP BY a), rb AS (SELECT b, sum(o) AS c FROM o GROUP BY b),
    grid AS (SELECT coalesce(o.o, 0) AS o, ra.r * rb.c / (SELECT sum(o) FROM o) AS e, (SELECT sum(o) FROM o) AS n FROM ra CROSS JOIN rb LEFT JOIN o USING (a, b)),
    t AS (SELECT max(n) AS n, (SELECT count(*) FROM ra) AS rows, (SELECT count(*) FROM rb) AS columns, sum(pow(o - e, 2) / e) AS chi2_uncorrected,
      sum(pow(greatest(abs(o - e) - 0.5, 0), 2) / e) AS yates FROM grid),
    k AS (SELECT *, CAST((rows - 1) * (columns - 1) AS DOUBLE) AS dof, CASE WHEN rows = 2 AND columns = 2 THEN yates ELSE chi2_uncorrected END AS chi2 FROM t)
    SELECT n, rows, columns, {rnd('chi2_uncorrected')} AS chi2_uncorrected, dof, {rnd('chi2')} AS chi2, {rnd('sqrt(chi2 / (n * (least(rows, columns) - 1)))')} AS cramers_v,
      {rnd(Q.p_chi2('chi2', 'dof'), 5)} AS p FROM k"""


@query(f"WITH {U}, {_chi_sql('users', 'age_predicted', 'gender_predicted')}")
def age_gender_independence(spark, sf):
    return rounded(CT.chi2_test(roles.users(spark, sf), "age_predicted", "gender_predicted"), p=5)


@query(f"WITH {_chi_sql('orders', 'o_orderpriority', 'o_orderstatus')}")
def priority_status_independence(spark, sf):
    return rounded(CT.chi2_test(roles.table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus"), p=5)


@query(f"WITH {_chi_sql('labels', 'quality', 'toxic')}")
def label_independence(spark, sf):
    return rounded(CT.chi2_test(roles.table(spark, sf, "labels"), "quality", "toxic"), p=5)


def _wil(k: str, n: str) -> tuple[str, str]:
    from cohortlens.plans.rollup import _wilson_sql

    return _wilson_sql(k, n)


_YATES = "(CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN (a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) ELSE 0 END)"
_PLAINCHI = _YATES.replace(" - (a + b + c + d) / 2", "")


@query(
    f"""WITH {U}, t AS (SELECT community, CAST(count(*) FILTER (WHERE age_predicted = 'adult' AND n_high > 0) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE age_predicted = 'adult' AND n_high = 0) AS DOUBLE) AS b,
      CAST(count(*) FILTER (WHERE age_predicted = 'teen' AND n_high > 0) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE age_predicted = 'teen' AND n_high = 0) AS DOUBLE) AS d FROM users GROUP BY community)
    SELECT community, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, {rnd('a / (a + b)')} AS rate_a, {rnd('c / (c + d)')} AS rate_b,
      {rnd(_wil('a', '(a + b)')[0])} AS low_a, {rnd(_wil('a', '(a + b)')[1])} AS high_a, {rnd(_wil('c', '(c + d)')[0])} AS low_b, {rnd(_wil('c', '(c + d)')[1])} AS high_b,
      {rnd('CASE WHEN b * c > 0 THEN a * d / (b * c) END')} AS odds_ratio, {rnd('(a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))')} AS odds_ratio_corrected, {rnd('(a / (a + b)) / (c / (c + d))')} AS rate_ratio,
      {rnd(_YATES)} AS chi2, {rnd(_PLAINCHI)} AS chi2_uncorrected, {rnd(f'sqrt({_YATES} / (a + b + c + d))')} AS cramers_v, {rnd(Q.p_chi2(_YATES, '1.0::DOUBLE'), 5)} AS p FROM t"""
)
def high_scorer_odds(spark, sf):
    """Prevalence of high scorers by age within each community: rates, intervals, odds ratios."""
    out = CT.odds_table(roles.users(spark, sf), "age_predicted", "adult", "teen", F.col("n_high") > 0, ["community"])
    return rounded(out, p=5)


# ---- correlations ---------------------------------------------------------------------------

_FEATS = [*roles.USER_EMOTIONS, "score_std", "balance"]


def _r_sql(x: str, feats, source: str = "users", by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(f"SELECT {sel}'{f}' AS feature, corr({x}, {f}) AS r, count({f}) AS n FROM {source}{grp}" for f in feats)


_RT = "(r * sqrt(n - 2.0::DOUBLE) / sqrt(1 - r * r))"


@query(f"WITH {U}, c AS ({_r_sql('score_mean', _FEATS)}) SELECT feature, {rnd('r')} AS r, n, {rnd(_RT)} AS t, {rnd(Q.p_t(_RT, '(n - 2.0::DOUBLE)'), 5)} AS p FROM c")
def emotion_correlations(spark, sf):
    return rounded(G.pearson(roles.users(spark, sf), "score_mean", _FEATS), p=5)


@query(
    f"WITH {U}, c AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r, count(*) AS n FROM users" for i, a in enumerate(_FEATS) for b in _FEATS[i:]
    )
    + f") SELECT x, y, {rnd('r')} AS r, n FROM c"
)
def correlation_matrix(spark, sf):
    return rounded(G.correlation_matrix(roles.users(spark, sf), _FEATS))


_MID = "rank() OVER ({part}ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}{c}) - 1) / 2"


@query(
    f"""WITH {U}, ur AS (SELECT community, round(score_mean, 12) AS score_mean, round(emotion_joy, 12) AS emotion_joy FROM users),
    k AS (SELECT community, {_MID.format(part='PARTITION BY community ', c='score_mean', by='community, ')} AS rx, {_MID.format(part='PARTITION BY community ', c='emotion_joy', by='community, ')} AS ry FROM ur),
    c AS (SELECT community, count(*) AS n, corr(rx, ry) AS r FROM k GROUP BY community)
    SELECT community, n, {rnd('r')} AS r, {rnd(_RT)} AS t, {rnd(Q.p_t(_RT, '(n - 2.0::DOUBLE)'), 5)} AS p FROM c"""
)
def spearman_by_community(spark, sf):
    """Means of equal parts tie up to the order of their sums; rounding makes the ties exact."""
    users = roles.users(spark, sf).withColumns({c: F.round(c, 12) for c in ("score_mean", "emotion_joy")})
    return rounded(G.spearman(users, "score_mean", "emotion_joy", ["community"]), p=5)


@query(
    f"""WITH k AS (SELECT {_MID.format(part='', c='l_extendedprice', by='')} AS rx, {_MID.format(part='', c='l_quantity', by='')} AS ry FROM lineitem),
    c AS (SELECT count(*) AS n, corr(rx, ry) AS r FROM k)
    SELECT n, {rnd('r')} AS r, {rnd(_RT, 4)} AS t, {rnd(Q.p_t(_RT, '(n - 2.0::DOUBLE)'), 5)} AS p FROM c"""
)
def spearman_correlation(spark, sf):
    return rounded(G.spearman(roles.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity"), t=4, p=5)


def _moderation_sql(group: str, a: str, b: str) -> str:
    z = "((atanh(ra) - atanh(rb)) / sqrt(1 / (na - 3.0::DOUBLE) + 1 / (nb - 3.0::DOUBLE)))"
    return f"""WITH {U}, c AS ({_r_sql('score_mean', roles.USER_EMOTIONS, by=group)}),
    w AS (SELECT feature, max(r) FILTER (WHERE {group} = '{a}') AS ra, max(n) FILTER (WHERE {group} = '{a}') AS na, max(r) FILTER (WHERE {group} = '{b}') AS rb, max(n) FILTER (WHERE {group} = '{b}') AS nb FROM c GROUP BY feature)
    SELECT feature, {rnd('ra')} AS r_a, na AS n_a, {rnd('rb')} AS r_b, nb AS n_b, {rnd(z)} AS z, {rnd(Q.p_norm(z), 5)} AS p FROM w WHERE na > 30 AND nb > 30"""


@query(_moderation_sql("age_predicted", "teen", "adult"))
def age_moderation(spark, sf):
    return rounded(G.moderation(roles.users(spark, sf), "score_mean", roles.USER_EMOTIONS, "age_predicted", "teen", "adult"), p=5)


@query(_moderation_sql("gender_predicted", "female", "male"))
def gender_moderation(spark, sf):
    return rounded(G.moderation(roles.users(spark, sf), "score_mean", roles.USER_EMOTIONS, "gender_predicted", "female", "male"), p=5)


# ---- contrasts ------------------------------------------------------------------------------


@query(
    f"""WITH {U}, q AS (SELECT quantile_cont(score_mean, 0.25) AS q1, quantile_cont(score_mean, 0.75) AS q3 FROM users),
    t AS (SELECT *, CASE WHEN score_mean <= q1 THEN 'low' WHEN score_mean >= q3 THEN 'high' END AS side FROM users, q),
    l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, side, {f} AS v FROM t WHERE side IS NOT NULL" for f in roles.USER_EMOTIONS)}),
    {_two_sql('s', 'l', 'side', "'high'", "'low'", 'v', 'feature')}
    SELECT feature, (SELECT {rnd('q1', 12)} FROM q) AS low_threshold, (SELECT {rnd('q3', 12)} FROM q) AS high_threshold, {_WELCH}, {_EFFECT} FROM s"""
)
def high_low_quartiles(spark, sf):
    return _tidy(G.quartile_contrast(roles.users(spark, sf), "score_mean", roles.USER_EMOTIONS), low_threshold=12, high_threshold=12)


_DOCFLAGS = f"""fl AS (SELECT id, quality, {', '.join(f'CAST({Q.matches("f", p)} AS INTEGER) AS has_{k}' for k, p in L.CONTENT_PATTERNS.items())}
    FROM (SELECT *, {Q.fold('body')} AS f FROM comments) JOIN labels ON doc_id = id)"""


@query(
    f"""WITH {roles.COMMENTS_SQL}, {_DOCFLAGS}, l AS ({' UNION ALL '.join(f"SELECT 'has_{k}' AS feature, quality = 1 AS high, has_{k} > 0 AS hit FROM fl" for k in L.CONTENT_PATTERNS)}),
    t AS (SELECT feature, CAST(count(*) FILTER (WHERE high AND hit) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE high AND NOT hit) AS DOUBLE) AS b,
      CAST(count(*) FILTER (WHERE NOT high AND hit) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE NOT high AND NOT hit) AS DOUBLE) AS d FROM l GROUP BY feature)
    SELECT feature, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, {rnd('a * 100 / (a + b)')} AS high_pct, {rnd('c * 100 / (c + d)')} AS low_pct,
      {rnd('CASE WHEN c > 0 THEN (a * 100 / (a + b)) / (c * 100 / (c + d)) END')} AS ratio, {rnd(_YATES)} AS chi2, {rnd(_PLAINCHI)} AS chi2_uncorrected,
      {rnd(f'sqrt({_YATES} / (a + b + c + d))')} AS cramers_v, {rnd(Q.p_chi2(_YATES, '1.0::DOUBLE'), 5)} AS p FROM t"""
)
def content_by_quality(spark, sf):
    """Share of each content flag among high and low quality documents."""
    flags = {k: c for k, c in T.content_flags().items()}
    df = roles.comments(spark, sf).join(roles.table(spark, sf, "labels"), F.col("id") == F.col("doc_id"))
    df = df.select("quality", *[c.alias(k) for k, c in flags.items()])
    return rounded(G.flag_contrast(df, F.col("quality") == 1, list(flags)), p=5)


@query(
    f"""WITH f AS (SELECT quality = 1 AS high, {', '.join(f'{Q.count("text", r)} AS {n}' for n, r in (('words', chr(92) + 'S+'), ('questions', chr(92) + '?'), ('exclamations', '!')))} FROM documents JOIN labels USING (doc_id)),
    l AS (SELECT 'word_count' AS feature, high, words AS v FROM f UNION ALL SELECT 'questions', high, questions FROM f UNION ALL SELECT 'exclamations', high, exclamations FROM f),
    {_two_sql('s', 'l', 'high', 'true', 'false', 'v', 'feature')}
    SELECT feature, {_WELCH}, {_EFFECT} FROM s"""
)
def language_by_quality(spark, sf):
    cols = {k: c for k, c in T.linguistic_features().items() if k in ("word_count", "questions", "exclamations")}
    df = roles.comments(spark, sf).join(roles.table(spark, sf, "labels"), F.col("id") == F.col("doc_id"))
    df = df.select("quality", *[c.alias(k) for k, c in cols.items()])
    return _tidy(G.mean_contrast(df, F.col("quality") == 1, list(cols)))


def _within_sql(level: str, min_n: int) -> str:
    return f"""WITH {U}, {_two_sql('s', 'users', 'age_predicted', "'teen'", "'adult'", 'score_mean', level)}
    SELECT {level}, {_WELCH}, {_EFFECT} FROM s WHERE n_a >= {min_n} AND n_b >= {min_n}"""


@query(_within_sql("community", 30))
def age_effect_within_communities(spark, sf):
    return _tidy(G.within_levels(roles.users(spark, sf), "age_predicted", "teen", "adult", "score_mean", "community"))


@query(_within_sql("gender_predicted", 10))
def age_effect_within_gender(spark, sf):
    return _tidy(G.within_levels(roles.users(spark, sf), "age_predicted", "teen", "adult", "score_mean", "gender_predicted", 10))


_SENS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80]


@query(
    f"""WITH {U}, t AS (SELECT CAST(unnest({_SENS}) AS DOUBLE) AS threshold), l AS (SELECT threshold, age_predicted, score_mean FROM users, t WHERE least(age_conf, gender_conf) >= threshold),
    {_two_sql('s', 'l', 'age_predicted', "'teen'", "'adult'", 'score_mean', 'threshold')}
    SELECT threshold, {_WELCH}, {_EFFECT}, CASE WHEN d > 0 THEN 'teen higher' ELSE 'adult higher' END AS direction FROM s WHERE n_a + n_b >= 100 AND n_a > 10 AND n_b > 10"""
)
def threshold_sensitivity(spark, sf):
    df = roles.users(spark, sf)
    return _tidy(G.threshold_sensitivity(df, "age_predicted", "teen", "adult", "score_mean", F.least("age_conf", "gender_conf"), _SENS))


@query(
    f"""WITH {U}, q AS (SELECT quantile_cont(score_mean, 0.25) AS q1, quantile_cont(score_mean, 0.75) AS q3 FROM users),
    b AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q), i AS (SELECT u.*, score_mean BETWEEN lower AND upper AS inside FROM users u, b), k AS (SELECT * FROM i WHERE inside),
    {_two_sql('s', 'k', 'age_predicted', "'teen'", "'adult'", 'score_mean')}
    SELECT (SELECT {rnd('lower')} FROM b) AS lower, (SELECT {rnd('upper')} FROM b) AS upper, (SELECT count(*) FROM i) AS n_total, (SELECT count(*) FROM i WHERE NOT inside) AS n_outliers, {_WELCH}, {_EFFECT} FROM s"""
)
def outlier_sensitivity(spark, sf):
    return _tidy(G.outlier_report(roles.users(spark, sf), "age_predicted", "teen", "adult", "score_mean"))


@query(
    f"""WITH {U}, c AS ({_r_sql('score_mean', _FEATS)}), p AS (SELECT feature, {Q.p_t(_RT, '(n - 2.0::DOUBLE)')} AS p FROM c),
    k AS (SELECT feature, p, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM p)
    SELECT feature, {rnd('p', 5)} AS p, {rnd('least(1, p * m)', 4)} AS p_bonferroni, {rnd('least(1, p * m / i)', 4)} AS p_bh_plain,
      {rnd('least(1, min(p * m / i) OVER (ORDER BY p, feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 4)} AS p_bh FROM k"""
)
def multiple_testing(spark, sf):
    p = G.pearson(roles.users(spark, sf), "score_mean", _FEATS).select("feature", "p")
    return rounded(G.adjust_p(p, key="feature"), 4, p=5)


@query(
    f"""SELECT o_orderpriority, count(*) AS n, {rnd('skewness(o_totalprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0::DOUBLE))')} AS skew, {rnd('kurtosis_pop(o_totalprice)')} AS excess,
      {rnd('count(*) / 6.0::DOUBLE * (pow(skewness(o_totalprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0::DOUBLE)), 2) + pow(kurtosis_pop(o_totalprice), 2) / 4)', 4)} AS jb,
      {rnd('exp(-count(*) / 12.0::DOUBLE * (pow(skewness(o_totalprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0::DOUBLE)), 2) + pow(kurtosis_pop(o_totalprice), 2) / 4))', 5)} AS p,
      exp(-count(*) / 12.0::DOUBLE * (pow(skewness(o_totalprice) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0::DOUBLE)), 2) + pow(kurtosis_pop(o_totalprice), 2) / 4)) > 0.05 AS normal
    FROM orders GROUP BY o_orderpriority"""
)
def normality_test(spark, sf):
    return rounded(G.jarque_bera(roles.table(spark, sf, "orders"), "o_totalprice", ["o_orderpriority"]), jb=4, p=5)


# ---- missingness ----------------------------------------------------------------------------

_MISS = f"""miss AS (SELECT author, CASE WHEN age_conf >= 0.6 THEN age_predicted END AS age_bucket,
    CASE WHEN gender_conf >= 0.7 THEN gender_predicted WHEN gender_conf >= 0.6 THEN 'unknown' END AS gender, score_mean FROM users)"""


def with_missing(spark, sf):
    """Users whose demographics count only when confident enough."""
    g = F.col("gender_conf")
    return roles.users(spark, sf).select(
        "author",
        F.when(F.col("age_conf") >= 0.6, F.col("age_predicted")).alias("age_bucket"),
        F.when(g >= 0.7, F.col("gender_predicted")).when(g >= 0.6, "unknown").alias("gender"),
        "score_mean",
    )


@query(
    f"""WITH {U}, {_MISS}, m AS (SELECT age_bucket IS NOT NULL AS a, coalesce(gender <> 'unknown', false) AS g FROM miss)
    SELECT count(*) AS n_total, count(*) FILTER (WHERE NOT a) AS n_missing_age, count(*) FILTER (WHERE NOT g) AS n_missing_gender, count(*) FILTER (WHERE a AND g) AS both_present,
      count(*) FILTER (WHERE a AND NOT g) AS age_only, count(*) FILTER (WHERE NOT a AND g) AS gender_only, count(*) FILTER (WHERE NOT a AND NOT g) AS both_missing,
      {rnd('count(*) FILTER (WHERE NOT a) / count(*)')} AS pct_missing_age, {rnd('count(*) FILTER (WHERE NOT g) / count(*)')} AS pct_missing_gender FROM m"""
)
def missing_pattern(spark, sf):
    return rounded(G.missing_pattern(with_missing(spark, sf)))


@query(
    f"""WITH {U}, {_MISS}, l AS (SELECT 'age' AS variable, CAST(age_bucket IS NOT NULL AS INTEGER) AS present, score_mean FROM miss
      UNION ALL SELECT 'gender', CAST(coalesce(gender <> 'unknown', false) AS INTEGER), score_mean FROM miss), {_two_sql('s', 'l', 'present', '1', '0', 'score_mean', 'variable')}
    SELECT variable, {_STUDENT}, {Q.p_t('student_t', 'student_df')} < 0.05 AS mnar FROM s WHERE n_a > 100 AND n_b > 100"""
)
def missing_outcome_difference(spark, sf):
    present = {"age": F.col("age_bucket").isNotNull(), "gender": F.coalesce(F.col("gender") != "unknown", F.lit(False))}
    return _tidy(G.missing_outcome(with_missing(spark, sf), present, "score_mean"))


@query(
    f"""WITH {U}, {_two_sql('s', 'users', 'age_predicted', "'teen'", "'adult'", 'score_mean', 'community')}
    SELECT community, {rnd('2 * abs(welch_t) / sqrt(welch_df)')} AS d_from_t, {rnd('d * d / (4 + d * d)')} AS r2,
      {rnd('(d * d / (4 + d * d)) / (1 - d * d / (4 + d * d))')} AS f2, CASE WHEN (d * d / (4 + d * d)) / (1 - d * d / (4 + d * d)) < 0.02 THEN 'negligible'
      WHEN (d * d / (4 + d * d)) / (1 - d * d / (4 + d * d)) < 0.15 THEN 'small' WHEN (d * d / (4 + d * d)) / (1 - d * d / (4 + d * d)) < 0.35 THEN 'medium' ELSE 'large' END AS f2_label FROM s"""
)
def effect_size_helpers(spark, sf):
    s = G.effect_size(G.welch(G.two_groups(roles.users(spark, sf), "age_predicted", "teen", "adult", "score_mean", ["community"]), False))
    r2 = F.col("d") * F.col("d") / (4 + F.col("d") * F.col("d"))
    f2 = S.f_squared(r2)
    return rounded(
        s.select("community", S.d_from_t(F.col("t"), F.col("df")).alias("d_from_t"), r2.alias("r2"), f2.alias("f2"), S.f2_label(f2).alias("f2_label"))
    )


# ---- classification metrics -----------------------------------------------------------------

_CLS = """cls AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN n_chars > 400 THEN 'good' ELSE 'bad' END AS predicted, CAST(n_chars AS DOUBLE) AS score, quality
    FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT unnest(['good', 'bad']) AS class), m0 AS (SELECT class, count(*) FILTER (WHERE truth = class) AS support, count(*) FILTER (WHERE predicted = class) AS called,
      count(*) FILTER (WHERE truth = class AND predicted = class) AS correct FROM cls, k GROUP BY class),
    m1 AS (SELECT *, CASE WHEN called > 0 THEN correct / called ELSE 0 END AS pr, CASE WHEN support > 0 THEN correct / support ELSE 0 END AS rc FROM m0),
    m AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m1)"""


def _classified(spark, sf):
    d = roles.table(spark, sf, "documents").select("doc_id", "n_chars").join(roles.table(spark, sf, "labels"), "doc_id")
    return d.select(
        "doc_id",
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"),
        F.when(F.col("n_chars") > 400, "good").otherwise("bad").alias("predicted"),
        F.col("n_chars").cast("double").alias("score"),
        "quality",
    )


@query(f"WITH {_CLS} SELECT class, support, called, correct, {rnd('pr')} AS precision, {rnd('rc')} AS recall, {rnd('f1')} AS f1 FROM m")
def classification_report(spark, sf):
    return rounded(CT.class_metrics(_classified(spark, sf), "truth", "predicted"))


@query(f"WITH {_CLS} SELECT CAST(sum(support) AS BIGINT) AS n, {rnd('sum(correct) / sum(support)')} AS accuracy, {rnd('avg(f1)')} AS macro_f1, {rnd('avg(rc)')} AS macro_recall, {rnd('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM m")
def classification_summary(spark, sf):
    return rounded(CT.overall_metrics(_classified(spark, sf), "truth", "predicted"))


@query(
    f"""WITH {_CLS}, h AS (SELECT score AS threshold, sum(quality) AS p, sum(1 - quality) AS q FROM cls GROUP BY score)
    SELECT threshold, {rnd('(sum(p) OVER (ORDER BY threshold DESC)) / (SELECT sum(p) FROM h)')} AS tpr, {rnd('(sum(q) OVER (ORDER BY threshold DESC)) / (SELECT sum(q) FROM h)')} AS fpr FROM h"""
)
def roc_curve(spark, sf):
    return rounded(CT.roc_points(_classified(spark, sf), "score", F.col("quality") == 1))


@query(
    f"""WITH {_CLS}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid FROM cls),
    g AS (SELECT CAST(sum(quality) AS DOUBLE) AS n1, CAST(sum(1 - quality) AS DOUBLE) AS n0, sum(mid) FILTER (WHERE quality = 1) AS ra FROM r)
    SELECT {rnd('(ra - n1 * (n1 + 1) / 2) / (n1 * n0)')} AS auroc, n1 AS n_positive, n0 AS n_negative FROM g"""
)
def auroc(spark, sf):
    return rounded(CT.auroc(_classified(spark, sf), "score", F.col("quality") == 1))


@query(
    f"""WITH {U}, l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, age_predicted, {f} AS v FROM users" for f in _FEATS)}),
    {_two_sql('s', 'l', 'age_predicted', "'teen'", "'adult'", 'v', 'feature')}
    SELECT feature, {_STUDENT.replace(', 6)', ', 3)').replace(', 5)', ', 4)')}, {Q.p_t('student_t', 'student_df')} < 0.05 AS significant FROM s"""
)
def feature_group_table(spark, sf):
    out = CT.feature_table(roles.users(spark, sf), "age_predicted", "teen", "adult", _FEATS)
    return rounded(out, 3, p=4)
