"""Queries on agreement and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import lexicons as L, text as T
from cohortlens.operators import agreement as V, groups as G, joins as J, rollup as R
from cohortlens.plans import roles, sqltext as Q
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.rollup import _wilson_sql
from cohortlens.plans.stats import _PAIR, _pairs, _two_sql, _EFFECT, _WELCH, _tidy
from cohortlens.plans.text import _ATTR

rnd = Q.rnd

_WIDE = f"""{roles.RATINGS_SQL}, wide0 AS (SELECT item, min(score) FILTER (WHERE rater = 'alpha') AS alpha, min(score) FILTER (WHERE rater = 'beta') AS beta,
      min(score) FILTER (WHERE rater = 'gamma') AS gamma FROM ratings GROUP BY item),
    wide AS (SELECT item, alpha, beta, gamma, a.score AS algorithm FROM wide0 FULL JOIN algorithm a USING (item)),
    rated0 AS (SELECT *, CAST(alpha IS NOT NULL AS INTEGER) + CAST(beta IS NOT NULL AS INTEGER) + CAST(gamma IS NOT NULL AS INTEGER) AS n_raters FROM wide),
    rated AS (SELECT *, CASE WHEN n_raters > 0 THEN (coalesce(alpha, 0) + coalesce(beta, 0) + coalesce(gamma, 0)) / n_raters END AS consensus_mean,
      greatest(alpha, beta, gamma) - least(alpha, beta, gamma) AS spread,
      CAST(round_even(CASE WHEN n_raters > 0 THEN (coalesce(alpha, 0) + coalesce(beta, 0) + coalesce(gamma, 0)) / n_raters END, 0) AS INTEGER) AS consensus FROM rated0)"""


def _wide(spark, sf):
    return J.rater_table(roles.ratings(spark, sf), roles.RATERS, reference=roles.algorithm(spark, sf))


def _rated(spark, sf):
    return V.consensus(_wide(spark, sf), roles.RATERS)


def _kappa_sql(source: str, by: str, a: str = "a", b: str = "b", numeric: bool = True, select: str | None = None) -> str:
    """CTE chain ending in ``kap`` with by, n, exact, kappa (and the weighted ones)."""
    g = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    using = f"USING ({by})" if by else "ON true"
    grp = f"GROUP BY {by}" if by else ""
    o = f"""cf AS (SELECT {sel}{a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS n FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
    ma AS (SELECT {sel}a, sum(n) AS r FROM cf GROUP BY ALL), mb AS (SELECT {sel}b, sum(n) AS c FROM cf GROUP BY ALL), tot AS (SELECT {sel}sum(n) AS t FROM cf {grp}),"""
    w = "sum(ma.r * mb.c / (t * t) * abs(a - b)) AS e1, sum(ma.r * mb.c / (t * t) * pow(a - b, 2)) AS e2," if numeric else ""
    w2 = ", sum(n * abs(a - b)) / sum(n) AS o1, sum(n * pow(a - b, 2)) / sum(n) AS o2, sum(n) FILTER (WHERE abs(a - b) <= 1) / sum(n) AS within_1" if numeric else ""
    return o + f"""
    ex AS (SELECT {sel}{w} sum(CASE WHEN a = b THEN ma.r * mb.c / (t * t) ELSE 0 END) AS pe FROM ma JOIN mb {using} JOIN tot {using} {grp}),
    ob AS (SELECT {sel}CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) / sum(n) AS po{w2} FROM cf {grp}),
    kap AS (SELECT *, CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END AS kappa{', 1 - o1 / e1 AS kappa_linear, 1 - o2 / e2 AS kappa_quadratic' if numeric else ''} FROM ob JOIN ex {using})"""


_KCOLS = f"""n, {rnd('po')} AS exact, {rnd('kappa')} AS kappa, {rnd('within_1')} AS within_1, {rnd('o1')} AS mean_abs_diff, {rnd('kappa_linear')} AS kappa_linear, {rnd('kappa_quadratic')} AS kappa_quadratic"""
_PAIRS3 = """pairs AS (SELECT 'alpha' AS first, 'beta' AS second, alpha AS a, beta AS b FROM wide UNION ALL SELECT 'alpha', 'gamma', alpha, gamma FROM wide UNION ALL SELECT 'beta', 'gamma', beta, gamma FROM wide),
    p1 AS (SELECT first || '|' || second AS pair, a, b FROM pairs)"""


@query(f"WITH {roles.RATINGS_SQL}, {_PAIR}, {_kappa_sql('pair', '', 'x', 'y')} SELECT {_KCOLS} FROM kap")
def score_version_kappa(spark, sf):
    """Unweighted, linear and quadratic kappa of two score versions."""
    return rounded(V.kappa(_pairs(spark, sf), "x", "y"))


@query(f"WITH {_WIDE}, {_PAIRS3}, {_kappa_sql('p1', 'pair')} SELECT split_part(pair, '|', 1) AS first, split_part(pair, '|', 2) AS second, {_KCOLS} FROM kap")
def rater_agreement(spark, sf):
    return rounded(V.pairwise_kappa(_wide(spark, sf), {r: r for r in roles.RATERS}))


@query(f"WITH {_WIDE}, {_PAIRS3}, {_kappa_sql('p1', 'pair')} SELECT count(*) AS n_pairs, {rnd('avg(po)')} AS mean_exact, {rnd('avg(kappa)')} AS mean_kappa FROM kap")
def rater_agreement_summary(spark, sf):
    return rounded(V.pairwise_summary(V.pairwise_kappa(_wide(spark, sf), {r: r for r in roles.RATERS})))


@query(
    f"""WITH {_WIDE}, {_PAIRS3}, {_kappa_sql('p1', 'pair')}, k AS (SELECT split_part(pair, '|', 1) AS first, split_part(pair, '|', 2) AS second, {rnd('CASE WHEN n >= 11 THEN kappa END')} AS kappa FROM kap)
    SELECT * FROM k UNION ALL SELECT second, first, kappa FROM k UNION ALL SELECT unnest(['alpha', 'beta', 'gamma']) AS first, unnest(['alpha', 'beta', 'gamma']), 1.0::DOUBLE"""
)
def rater_kappa_matrix(spark, sf):
    return rounded(V.kappa_matrix(_wide(spark, sf), {r: r for r in roles.RATERS}))


@query(f"WITH {_WIDE} SELECT item, n_raters, {rnd('consensus_mean')} AS consensus_mean, spread, consensus FROM rated")
def rater_consensus(spark, sf):
    return rounded(_rated(spark, sf).select("item", "n_raters", "consensus_mean", "spread", "consensus"))


@query(
    f"""WITH {_WIDE}, d AS (SELECT algorithm - consensus AS d FROM rated WHERE algorithm - consensus IS NOT NULL),
    s AS (SELECT count(*) AS n, avg(CAST(d = 0 AS INTEGER)) AS exact, avg(CAST(abs(d) <= 1 AS INTEGER)) AS within_1, avg(d) AS bias, avg(abs(d)) AS mae FROM d)
    SELECT n, {rnd('exact')} AS exact, {rnd('within_1')} AS within_1, {rnd('bias')} AS bias, {rnd('mae')} AS mean_abs_error,
      CASE WHEN bias > 0.3 THEN 'algorithm_overscores' WHEN bias < -0.3 THEN 'algorithm_underscores' ELSE 'roughly_aligned' END AS direction FROM s"""
)
def algorithm_against_consensus(spark, sf):
    return rounded(V.against_consensus(_rated(spark, sf)))


@query(f"WITH {_WIDE} SELECT consensus, algorithm, count(*) AS n FROM rated WHERE consensus IS NOT NULL AND algorithm IS NOT NULL GROUP BY ALL")
def consensus_confusion(spark, sf):
    return V.confusion(_rated(spark, sf), "consensus", "algorithm")


@query(f"WITH {_WIDE} SELECT item, consensus, algorithm, algorithm - consensus AS difference, n_raters FROM rated WHERE abs(algorithm - consensus) >= 2")
def high_disagreement(spark, sf):
    return V.high_disagreement(_rated(spark, sf)).select("item", "consensus", "algorithm", "difference", "n_raters")


@query(
    f"""WITH {_WIDE}, c AS (SELECT *, abs(algorithm - consensus) <= 1 AS algorithm_correct FROM rated WHERE n_raters >= 2 AND spread <= 1 AND algorithm IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY consensus ORDER BY n_raters DESC, algorithm_correct, item) AS rn FROM c)
    SELECT item, consensus, n_raters, spread, algorithm, algorithm_correct FROM r WHERE rn <= 4"""
)
def calibration_examples(spark, sf):
    out = V.calibration_examples(_rated(spark, sf), 4)
    return out.select("item", "consensus", "n_raters", "spread", "algorithm", "algorithm_correct")


_METHODS = f"""cl AS (SELECT author, CASE WHEN author % 3 <> 0 THEN age_predicted END AS truth, CASE WHEN age_conf >= 0.6 THEN CASE WHEN score_mean > 2.75 THEN 'adult' ELSE 'teen' END END AS community,
      CASE WHEN gender_conf >= 0.7 THEN CASE WHEN balance > 4500 THEN 'teen' ELSE 'adult' END END AS model, age_predicted AS ensemble FROM users)"""


def _methods(spark, sf):
    """Users with a truth for some and three methods covering different parts."""
    return roles.users(spark, sf).select(
        "author",
        F.when(F.col("author") % 3 != 0, F.col("age_predicted")).alias("truth"),
        F.when(F.col("age_conf") >= 0.6, F.when(F.col("score_mean") > 2.75, "adult").otherwise("teen")).alias("community"),
        F.when(F.col("gender_conf") >= 0.7, F.when(F.col("balance") > 4500, "teen").otherwise("adult")).alias("model"),
        F.col("age_predicted").alias("ensemble"),
    )


_METHOD_LONG = "ml AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, truth, {m} AS label FROM cl" for m in ("truth", "community", "model", "ensemble")) + ")"


@query(
    f"""WITH {roles.USERS_SQL}, {_METHODS}, {_METHOD_LONG}, {_kappa_sql('ml', 'method', 'truth', 'label', numeric=False)},
    cov AS (SELECT method, count(label) AS n_classified, avg(CAST(label IS NOT NULL AS INTEGER)) AS coverage FROM ml GROUP BY method)
    SELECT method, n_classified, {rnd('coverage')} AS coverage, n AS n_truth, {rnd('po')} AS accuracy, {rnd('kappa')} AS kappa FROM cov LEFT JOIN kap USING (method)"""
)
def method_comparison(spark, sf):
    methods = {m: m for m in ("truth", "community", "model", "ensemble")}
    return rounded(V.method_comparison(_methods(spark, sf), "truth", methods))


_MPAIRS = " UNION ALL ".join(
    f"SELECT '{a}|{b}' AS pair, {a} AS a, {b} AS b FROM cl" for a, b in
    (("truth", "community"), ("truth", "model"), ("truth", "ensemble"), ("community", "model"), ("community", "ensemble"), ("model", "ensemble"))
)


@query(
    f"""WITH {roles.USERS_SQL}, {_METHODS}, mp AS ({_MPAIRS}), {_kappa_sql('mp', 'pair', numeric=False)},
    k AS (SELECT split_part(pair, '|', 1) AS first, split_part(pair, '|', 2) AS second, {rnd('CASE WHEN n >= 11 THEN kappa END')} AS kappa FROM kap)
    SELECT * FROM k UNION ALL SELECT second, first, kappa FROM k UNION ALL SELECT unnest(['truth', 'community', 'model', 'ensemble']) AS first, unnest(['truth', 'community', 'model', 'ensemble']), 1.0::DOUBLE"""
)
def method_kappa_matrix(spark, sf):
    return rounded(V.kappa_matrix(_methods(spark, sf), {m: m for m in ("truth", "community", "model", "ensemble")}))


@query(
    f"""WITH {roles.RATINGS_SQL}, {_PAIR} SELECT count(*) AS n, {rnd('avg(x)')} AS mean_old, {rnd('median(x)')} AS median_old, {rnd('stddev_samp(x)')} AS sd_old, {rnd('avg(y)')} AS mean_new, {rnd('median(y)')} AS median_new,
      {rnd('stddev_samp(y)')} AS sd_new, {rnd('avg(CAST(x = y AS INTEGER))')} AS exact, {rnd('avg(CAST(abs(x - y) <= 1 AS INTEGER))')} AS within_1, count(*) FILTER (WHERE y > x) AS raised, count(*) FILTER (WHERE y < x) AS lowered,
      count(*) FILTER (WHERE y = x) AS same, {rnd('avg(y - x) / stddev_samp(y - x)')} AS d_paired, {rnd('count(*) FILTER (WHERE y > x) * 100 / count(*)')} AS pct_raised, {rnd('count(*) FILTER (WHERE y < x) * 100 / count(*)')} AS pct_lowered FROM pair"""
)
def score_version_comparison(spark, sf):
    return rounded(V.version_comparison(_pairs(spark, sf), "x", "y"))


_LO, _HI = _wilson_sql("n", "total::DOUBLE")


@query(
    f"""WITH {roles.RATINGS_SQL}, {_PAIR}, l AS (SELECT 'old' AS version, x AS s FROM pair UNION ALL SELECT 'new', y FROM pair), g AS (SELECT version, count(*) AS total FROM l GROUP BY version),
    c AS (SELECT version, total, CAST(level AS INTEGER) AS level, (SELECT count(*) FROM l WHERE l.version = g.version AND l.s = level) AS n FROM g, range(1, 6) t(level))
    SELECT version, total, level, n, {rnd('n / total')} AS share, {rnd(_LO)} AS ci_low, {rnd(_HI)} AS ci_high FROM c"""
)
def score_version_levels(spark, sf):
    return rounded(V.version_levels(_pairs(spark, sf), {"old": "x", "new": "y"}, [1, 2, 3, 4, 5]))


def _paired_orders(spark, sf):
    o = roles.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("subreddit"))
    return _pairs(spark, sf).join(o, "item")


_PO = f"po AS (SELECT p.*, o_orderpriority AS subreddit FROM pair p JOIN orders ON o_orderkey = item)"


@query(
    f"""WITH {roles.RATINGS_SQL}, {_PAIR}, {_PO} SELECT subreddit, CAST(grouping(subreddit) AS INTEGER) AS is_total, count(*) AS n, {rnd('avg(y - x)')} AS mean_diff, {rnd('avg(x)')} AS old_mean, {rnd('avg(y)')} AS new_mean,
      count(*) FILTER (WHERE y - x <= -2) AS big_drops, count(*) FILTER (WHERE y - x >= 2) AS big_gains, count(*) FILTER (WHERE x = 2 AND y = 1) AS shift_2_to_1 FROM po WHERE x > 0 AND y > 0 GROUP BY ROLLUP (subreddit)"""
)
def score_divergence(spark, sf):
    out = V.divergence(_paired_orders(spark, sf), "x", "y", "subreddit")
    return rounded(out.withColumn("is_total", F.col("is_total").cast("int")))


@query(
    f"""WITH {roles.RATINGS_SQL}, {_PAIR}, k AS (SELECT *, CASE WHEN y - x <= -2 THEN 'drop' WHEN y - x >= 2 THEN 'gain' END AS kind FROM pair WHERE x > 0 AND y > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5('42:' || CAST(item AS VARCHAR)), item) AS rn FROM k WHERE kind IS NOT NULL)
    SELECT item, x, y, kind FROM r WHERE rn <= 10"""
)
def divergent_samples(spark, sf):
    return V.divergent_samples(_pairs(spark, sf), "x", "y", "item").select("item", "x", "y", "kind")


@query(
    f"""WITH {roles.COMMENTS_SQL}, {_ATTR}, p AS (SELECT a.*, 1 + quality + toxic AS x, 2 - quality + toxic AS y FROM attributed a JOIN labels ON doc_id = id),
    l AS (SELECT unnest(['bot_attributed', 'self_expressed', 'neither']) AS class), c AS (SELECT class, x, y FROM p, l WHERE (class = 'bot_attributed' AND bot_attributed) OR (class = 'self_expressed' AND self_expressed) OR (class = 'neither' AND NOT bot_attributed AND NOT self_expressed))
    SELECT l.class, count(c.x) AS n, {rnd('coalesce(avg(x), 0)')} AS old_mean, {rnd('coalesce(avg(y), 0)')} AS new_mean, {rnd('coalesce(avg(y - x), 0)')} AS mean_diff FROM l LEFT JOIN c ON l.class = c.class GROUP BY l.class"""
)
def attribution_impact(spark, sf):
    docs = T.with_attribution(roles.comments(spark, sf)).join(roles.table(spark, sf, "labels"), F.col("id") == F.col("doc_id"))
    docs = docs.withColumns({"x": 1 + F.col("quality") + F.col("toxic"), "y": 2 - F.col("quality") + F.col("toxic")})
    bot, own = F.col("bot_attributed"), F.col("self_expressed")
    return rounded(V.attribution_impact(docs, "x", "y", {"bot_attributed": bot, "self_expressed": own, "neither": ~bot & ~own}))


_SCALES = [0.9, 0.95, 1.0, 1.05, 1.1]


@query(
    f"""WITH {roles.USERS_SQL}, s AS (SELECT -(score_mean - 2) / 5 AS s, CASE segment WHEN 'BUILDING' THEN 'teen' WHEN 'FURNITURE' THEN 'young_adult' WHEN 'HOUSEHOLD' THEN 'adult' END AS truth FROM users),
    k AS (SELECT CAST(unnest({_SCALES}) AS DOUBLE) AS k), c AS (SELECT k, truth, CASE WHEN s < -0.22 * k THEN 'teen' WHEN s < -0.1 * k THEN 'young_adult' ELSE 'adult' END AS called FROM s, k)
    SELECT k AS threshold_scale, {rnd('avg(CAST(called = truth AS INTEGER)) FILTER (WHERE truth IS NOT NULL)')} AS accuracy, count(called) AS n_classified FROM c GROUP BY k"""
)
def threshold_scale_accuracy(spark, sf):
    seg = F.col("segment")
    df = roles.users(spark, sf).select(
        (-(F.col("score_mean") - 2) / 5).alias("s"),
        F.when(seg == "BUILDING", "teen").when(seg == "FURNITURE", "young_adult").when(seg == "HOUSEHOLD", "adult").alias("truth"),
    )
    return rounded(V.threshold_scale_accuracy(df, "s", "truth", L.AGE_CUTS_THREE, ["teen", "young_adult", "adult"], _SCALES))


def _hits_sql() -> str:
    from cohortlens.plans.registry import SQL

    cols = ["ngram_anthro_total", "ngram_deanthro_total", *[f"ngram_{k}" for k in (*L.HUMANISING_NGRAMS, *L.TOOL_NGRAMS)]]
    return f"""WITH g AS ({SQL['ngram_features']}), j AS (SELECT g.*, quality AS score FROM g LEFT JOIN labels ON doc_id = id),
    l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} > 0 AS hit, score FROM j" for c in cols)})
    SELECT feature, count(*) FILTER (WHERE hit) AS n_hit, {rnd('avg(CAST(hit AS INTEGER))')} AS hit_share, {rnd('avg(score) FILTER (WHERE hit)')} AS mean_hit, {rnd('avg(score) FILTER (WHERE NOT hit)')} AS mean_no_hit,
      {rnd('avg(score) FILTER (WHERE hit) - avg(score) FILTER (WHERE NOT hit)')} AS difference FROM l GROUP BY feature"""


@query(_hits_sql())
def ngram_hit_diagnostic(spark, sf):
    cols = ["ngram_anthro_total", "ngram_deanthro_total", *[f"ngram_{k}" for k in (*L.HUMANISING_NGRAMS, *L.TOOL_NGRAMS)]]
    labels = roles.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("score"))
    df = T.with_ngram_features(roles.comments(spark, sf)).join(labels, F.col("id") == F.col("doc_id"), "left")
    return rounded(V.hit_diagnostic(df, cols, "score"))


@query(
    f"""WITH {roles.RATINGS_SQL}, b AS (SELECT 'main' AS sample, score FROM algorithm UNION ALL SELECT 'confirmatory', score FROM ratings WHERE rater = 'beta'),
    {_two_sql('s', 'b', 'sample', "'main'", "'confirmatory'", 'score')}, g AS (SELECT sample, count(*) AS n, {rnd('avg(score)')} AS mean, {rnd('avg(CAST(score = 1 AS INTEGER))')} AS share_1, {rnd('avg(CAST(score >= 4 AS INTEGER))')} AS share_4plus FROM b GROUP BY sample)
    SELECT g.*, {rnd('d')} AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS d_label FROM g, s"""
)
def replication_check(spark, sf):
    return rounded(V.replication(roles.algorithm(spark, sf), roles.ratings(spark, sf).where("rater = 'beta'")))


@query(
    f"""WITH {roles.USERS_SQL}, t AS (SELECT *, CASE WHEN author % 3 <> 0 THEN age_predicted END AS truth FROM users), k AS (SELECT * FROM t WHERE truth IS NOT NULL),
    {_two_sql('s', 'k', 'truth', "'teen'", "'adult'", 'score_mean')} SELECT {_WELCH}, {_EFFECT} FROM s"""
)
def declared_truth_effect(spark, sf):
    """The age effect among users whose age is self-declared."""
    truth = _methods(spark, sf).select("author", "truth").where("truth IS NOT NULL")
    df = roles.users(spark, sf).join(truth, "author")
    return _tidy(G.effect_size(G.welch(G.two_groups(df, "truth", "teen", "adult", "score_mean"))))


@query(
    f"""WITH {roles.SCORED_SQL} SELECT source, count(*) AS n, {rnd('count(*) / (SELECT count(*) FROM scored)')} AS share, {rnd('sum(processing_time_ms)', 2)} AS total_ms, {rnd('avg(processing_time_ms)', 4)} AS mean_ms,
      {rnd('sum(value) * 0.10 / 1000000 + count(*) * 100 * 0.40 / 1000000', 8)} AS cost FROM scored GROUP BY source"""
)
def scoring_run_statistics(spark, sf):
    from cohortlens.operators.scoring import run_statistics

    df = roles.scored(spark, sf).withColumns({"input_tokens": F.col("value"), "output_tokens": F.lit(100)})
    return rounded(run_statistics(df), total_ms=2, mean_ms=4, cost=8)
