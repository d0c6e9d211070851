"""Queries at user and community level, joins, samples, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import lexicons as L, text as T
from cohortlens.operators import clean as C, joins as J, ranks, rollup as R, sampling as SM
from cohortlens.plans import roles, sqltext as Q
from cohortlens.plans.registry import query, rounded
from cohortlens.plans.text import _ATTR
from cohortlens.session import local_scratch
from cohortlens.sources import comments as IO

rnd = Q.rnd

# ---- users ----------------------------------------------------------------------------------


@query(
    f"""WITH {roles.SCORED_SQL} SELECT author, {rnd('avg(score)')} AS score_mean, max(score) AS score_max, min(score) AS score_min,
      {rnd('coalesce(stddev_samp(score), 0)')} AS score_std, count(*) AS score_count, {rnd('median(score)')} AS score_median,
      list_sort(list(DISTINCT subreddit)) AS communities FROM scored WHERE score > 0 GROUP BY author"""
)
def user_scores(spark, sf):
    return rounded(R.user_scores(roles.scored(spark, sf)))


@query(
    f"""WITH {roles.SCORED_SQL}, s AS (SELECT author, count(*) AS score_count, count(*) FILTER (WHERE score = 1) AS score_1_count,
      count(*) FILTER (WHERE score = 2) AS score_2_count, count(*) FILTER (WHERE score >= 3) AS score_3plus_count,
      count(*) FILTER (WHERE score >= 4) AS score_4plus_count, bool_or(score >= 4) AS any_4plus FROM scored WHERE score > 0 GROUP BY author)
    SELECT *, {rnd('score_2_count / score_count')} AS pct_score_2, {rnd('score_3plus_count / score_count')} AS pct_score_3plus,
      {rnd('score_4plus_count / score_count')} AS pct_score_4plus, CAST(score_3plus_count > 0 AS INTEGER) AS has_score_3plus,
      CAST(score_4plus_count > 0 AS INTEGER) AS has_score_4plus FROM s"""
)
def user_score_shares(spark, sf):
    return rounded(R.score_shares(roles.scored(spark, sf)))


@query(
    f"""WITH {roles.USERS_SQL}, long AS (
      SELECT 'mean' AS method, score_mean AS v FROM users UNION ALL SELECT 'max', score_max FROM users
      UNION ALL SELECT 'std', score_std FROM users UNION ALL SELECT 'count', score_count FROM users
      UNION ALL SELECT 'high', n_high FROM users)
    SELECT method, count(v) AS n, {rnd('avg(v)')} AS mean, {rnd('stddev_samp(v)')} AS std, {rnd('min(v)', 10)} AS min, {rnd('max(v)', 10)} AS max,
      {rnd('avg(CAST(v = 0 AS INTEGER))')} AS pct_zero, {rnd('avg(CAST(v > 0 AS INTEGER))')} AS pct_positive,
      CASE WHEN avg(CAST(v = 0 AS INTEGER)) > 0.7 THEN 'SEVERE' WHEN avg(CAST(v = 0 AS INTEGER)) > 0.5 THEN 'MODERATE'
           WHEN avg(CAST(v = 0 AS INTEGER)) > 0.3 THEN 'MILD' ELSE 'MINIMAL' END AS severity
    FROM long GROUP BY method"""
)
def aggregation_methods(spark, sf):
    cols = {"mean": "score_mean", "max": "score_max", "std": "score_std", "count": "score_count", "high": "n_high"}
    return rounded(R.aggregation_table(roles.users(spark, sf), cols), min=10, max=10)


_EMO = """emo AS (SELECT o_custkey AS author, emotion_joy, emotion_sadness, emotion_anger, emotion_fear,
    CASE WHEN o_orderstatus = 'F' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS emotion_surprise,
    CASE WHEN o_orderstatus = 'O' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS emotion_disgust, emotion_neutral,
    CASE WHEN o_orderstatus = 'P' THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END AS bot_attribution_score
  FROM (SELECT *, """ + ", ".join(
    f"CASE WHEN o_orderpriority = '{p}' THEN o_totalprice / 500000 ELSE 0.0::DOUBLE END AS {e}"
    for p, e in zip(roles._PRIORITIES, roles.USER_EMOTIONS)
) + " FROM orders))"


def _emotion_rows(spark, sf):
    """Orders as comments with seven emotion scores."""
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    return roles.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("author"),
        *[F.when(F.col("o_orderpriority") == p, price / 500000).otherwise(0.0).alias(e)
          for p, e in zip(roles._PRIORITIES, roles.USER_EMOTIONS)],
        F.when(status == "F", 0.25).otherwise(0.0).alias("emotion_surprise"),
        F.when(status == "O", 0.5).otherwise(0.0).alias("emotion_disgust"),
        F.when(status == "P", 0.0).otherwise(0.4).alias("bot_attribution_score"),
    )


def _argmax_sql(prefix: str, empty: str | None = None) -> str:
    top = f"greatest({', '.join(prefix + e for e in L.EMOTIONS)})"
    case = "CASE " + " ".join(f"WHEN {prefix}{e} = {top} THEN '{e}'" for e in L.EMOTIONS) + " END"
    if empty is None:
        return case
    return f"CASE WHEN {' + '.join(prefix + e for e in L.EMOTIONS)} > 0 THEN {case} ELSE '{empty}' END"


@query(
    f"""WITH {_EMO}, w AS (SELECT *, {', '.join(f'emotion_{e} * bot_attribution_score AS bot_emotion_{e}' for e in L.EMOTIONS)} FROM emo),
    l AS (SELECT author, {_argmax_sql('emotion_')} AS dominant, {_argmax_sql('bot_emotion_', '')} AS bot_dominant FROM w)
    SELECT dominant, bot_dominant, count(*) AS n FROM l GROUP BY ALL"""
)
def comment_dominant_emotions(spark, sf):
    df = _emotion_rows(spark, sf)
    df = df.select("*", *[c.alias(k) for k, c in T.weighted_emotions().items()])
    df = df.select(T.dominant().alias("dominant"), T.dominant("bot_emotion_", "").alias("bot_dominant"))
    return df.groupBy("dominant", "bot_dominant").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_EMO}, w AS (SELECT *, {', '.join(f'emotion_{e} * bot_attribution_score AS bot_emotion_{e}' for e in L.EMOTIONS)} FROM emo),
    u AS (SELECT author, {', '.join(f'round(avg({p}{e}), 12) AS {p}{e}' for p in ('emotion_', 'bot_emotion_') for e in L.EMOTIONS)},
          avg(bot_attribution_score) AS bot_attribution_score FROM w GROUP BY author)
    SELECT author, {', '.join(f'{rnd(p + e, 12)} AS {p}{e}' for p in ('emotion_', 'bot_emotion_') for e in L.EMOTIONS)},
      {rnd('bot_attribution_score', 12)} AS bot_attribution_score, {_argmax_sql('emotion_')} AS dominant_emotion,
      {rnd('greatest(' + ', '.join('emotion_' + e for e in L.EMOTIONS) + ')', 12)} AS dominant_emotion_score,
      {_argmax_sql('bot_emotion_', '')} AS bot_dominant_emotion FROM u"""
)
def user_emotions(spark, sf):
    """Means of emotions and the largest one, ties (to 12 digits) to the first label."""
    df = _emotion_rows(spark, sf)
    return rounded(R.user_emotions(df.select("*", *[c.alias(k) for k, c in T.weighted_emotions().items()])), 12)


@query(
    f"""WITH {roles.SCORED_SQL} SELECT author, {rnd('avg(CAST(hour(ts) <= 4 AS INTEGER))')} AS late_night_ratio,
      {rnd('avg(CAST(hour(ts) BETWEEN 9 AND 14 AS INTEGER))')} AS school_hours_ratio, {rnd('avg(CAST(isodow(ts) >= 6 AS INTEGER))')} AS weekend_ratio,
      CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS activity_span_days, {rnd('avg(value)')} AS avg_comment_length,
      count(*) AS comment_count, {rnd('count(DISTINCT subreddit) / count(*)')} AS subreddit_diversity FROM scored GROUP BY author"""
)
def user_behaviour(spark, sf):
    return rounded(R.behaviour(roles.scored(spark, sf), length=F.col("value")))


@query(
    f"""WITH {roles.SCORED_SQL} SELECT author, count(*) AS comment_count, {rnd('avg(value)')} AS avg_comment_length,
      {rnd('stddev_samp(value)')} AS std_comment_length, {rnd('avg(hour(ts))')} AS hour_mean, {rnd('stddev_samp(hour(ts))')} AS hour_std,
      {rnd('avg(CAST(isodow(ts) >= 6 AS INTEGER))')} AS weekend_ratio FROM scored GROUP BY author"""
)
def user_activity(spark, sf):
    return rounded(R.activity(roles.scored(spark, sf), length=F.col("value")))


@query(
    f"""WITH {roles.RAW_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_utc, id) AS rn FROM raw)
    SELECT author, string_agg(body, ' ' ORDER BY rn) AS document, count(*) AS n_comments FROM r WHERE rn <= 50 GROUP BY author"""
)
def user_documents(spark, sf):
    return R.user_documents(roles.raw(spark, sf), 50)


@query(
    f"""WITH {roles.RAW_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_utc, id) AS rn FROM raw)
    SELECT author, string_agg(body[1:200], chr(10) ORDER BY rn) AS document, count(*) AS n_comments FROM r WHERE rn <= 20 GROUP BY author"""
)
def scorer_context(spark, sf):
    """First 20 comments per user, each cut to 200 characters (the cut is the scorer's input format)."""
    return R.user_documents(roles.raw(spark, sf), 20, cut=200, sep="\n")


@query(
    f"""WITH {roles.SCORED_SQL}, p AS (SELECT author, lower(subreddit) AS subreddit, count(*) AS n FROM scored GROUP BY ALL HAVING count(*) >= 3)
    SELECT author, list_sort(list(subreddit)) AS communities, count(*) AS n_communities FROM p GROUP BY author"""
)
def community_participation(spark, sf):
    return R.participation(roles.scored(spark, sf))


@query(
    f"""WITH {roles.SCORED_SQL}, p AS (SELECT author, subreddit, count(*) AS n FROM scored GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY n DESC, subreddit) AS rn, sum(n) OVER (PARTITION BY author) AS t FROM p)
    SELECT author, subreddit AS primary_community, n AS primary_comments, CAST(t AS BIGINT) AS total_comments, {rnd('n / t')} AS primary_share
    FROM r WHERE rn = 1"""
)
def primary_communities(spark, sf):
    return rounded(R.primary_community(roles.scored(spark, sf)))


_VOCAB = """pairs AS (SELECT DISTINCT o_custkey % 97 AS author, CAST(l_suppkey AS VARCHAR) AS subreddit FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    vocab AS (SELECT subreddit, count(*) AS n_users, row_number() OVER (ORDER BY count(*) DESC, subreddit) - 1 AS position FROM pairs
              GROUP BY subreddit HAVING count(*) >= 10 ORDER BY n_users DESC, subreddit LIMIT 500)"""


def _memberships(spark, sf):
    line, orders = roles.table(spark, sf, "lineitem"), roles.table(spark, sf, "orders")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") % 97).alias("author"), F.col("l_suppkey").cast("string").alias("subreddit")
    )


@query(f"WITH {_VOCAB} SELECT p.author, v.subreddit, CAST(v.position AS INTEGER) AS position FROM pairs p JOIN vocab v USING (subreddit)")
def community_matrix(spark, sf):
    """Binary user × community matrix over the 500 most common communities, long form."""
    df = _memberships(spark, sf)
    return R.community_membership(df, R.community_vocabulary(df, 500))


@query(
    f"""WITH {roles.USERS_SQL}, c AS (SELECT community, count(*) AS n, {rnd('avg(score_mean)')} AS mean, {rnd('stddev_samp(score_mean)')} AS sd,
      {rnd('avg(CAST(score_mean >= 3 AS INTEGER)) * 100')} AS high_pct, {rnd("avg(CAST(age_predicted = 'teen' AS INTEGER)) * 100")} AS pct_teen,
      {rnd("avg(CAST(gender_predicted = 'female' AS INTEGER)) * 100")} AS pct_female, {rnd('median(score_mean)')} AS median FROM users GROUP BY community)
    SELECT *, {rnd('n / sum(n) OVER ()')} AS share FROM c WHERE n >= 50"""
)
def community_profiles(spark, sf):
    flags = {"pct_teen": F.col("age_predicted") == "teen", "pct_female": F.col("gender_predicted") == "female"}
    return rounded(R.community_profile(roles.users(spark, sf), "score_mean", "community", flags))


# ---- distributions --------------------------------------------------------------------------


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054::DOUBLE"
    p = f"({k} / {n})"
    centre = f"(({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}))"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n}))"
    return f"{centre} - {half}", f"{centre} + {half}"


_LO, _HI = _wilson_sql("n", "total::DOUBLE")


@query(
    f"""WITH {roles.SCORED_SQL}, v AS (SELECT * FROM scored WHERE score > 0),
    g AS (SELECT subreddit, count(*) AS total FROM v GROUP BY subreddit),
    l AS (SELECT subreddit, total, unnest(range(1, 6)) AS level FROM g),
    c AS (SELECT l.subreddit, l.total, CAST(l.level AS INTEGER) AS level, count(v.id) AS n FROM l LEFT JOIN v ON v.subreddit = l.subreddit AND v.score = l.level GROUP BY ALL)
    SELECT *, {rnd('n / total')} AS share, {rnd(_LO)} AS ci_low, {rnd(_HI)} AS ci_high FROM c"""
)
def score_level_distribution(spark, sf):
    df = C.valid_scores(roles.scored(spark, sf))
    return rounded(R.level_distribution(df, "score", [1, 2, 3, 4, 5], ["subreddit"]))


_PCT = ", ".join(f"{rnd(f'quantile_cont(score_mean, {p})', 12)} AS {k}" for k, p in R.PERCENTILES.items())
_DESCRIBE = f"""count(*) AS n, {rnd('avg(score_mean)')} AS mean, {rnd('stddev_samp(score_mean)')} AS sd, {rnd('min(score_mean)', 10)} AS min,
      {rnd('max(score_mean)', 10)} AS max, {rnd('skewness(score_mean) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0::DOUBLE))')} AS skew_pop,
      {rnd('skewness(score_mean)')} AS skew, {rnd('kurtosis(score_mean)')} AS kurtosis, {rnd('avg(CAST(score_mean >= 3 AS INTEGER))')} AS pct_high"""


@query(f"WITH {roles.USERS_SQL} SELECT {_DESCRIBE}, {_PCT} FROM users")
def score_distribution(spark, sf):
    df = R.describe(roles.users(spark, sf), "score_mean", flags={"pct_high": F.col("score_mean") >= 3})
    return rounded(df, min=10, max=10, **{k: 12 for k in R.PERCENTILES})


@query(f"WITH {roles.USERS_SQL} SELECT segment, {_DESCRIBE}, {_PCT} FROM users GROUP BY segment")
def score_distribution_by_segment(spark, sf):
    df = R.describe(roles.users(spark, sf), "score_mean", ["segment"], {"pct_high": F.col("score_mean") >= 3})
    return rounded(df, min=10, max=10, **{k: 12 for k in R.PERCENTILES})


@query(
    f"""SELECT o_orderpriority, {', '.join(f'{rnd(f"quantile_cont(o_totalprice, {p})", 4)} AS {k}' for k, p in R.PERCENTILES.items())}
    FROM orders GROUP BY o_orderpriority"""
)
def exact_price_percentiles(spark, sf):
    """Exact quantiles of a continuous column without collecting any group."""
    df = roles.table(spark, sf, "orders")
    return rounded(ranks.quantiles(df, "o_totalprice", R.PERCENTILES, ["o_orderpriority"]), 4)


@query(
    f"""WITH {roles.USERS_SQL} SELECT age_predicted, gender_predicted, count(*) AS n, {rnd('avg(score_mean)')} AS mean,
      {rnd('stddev_samp(score_mean)')} AS sd, {rnd('var_samp(score_mean)')} AS variance, CAST(grouping_id(age_predicted, gender_predicted) AS BIGINT) AS level,
      {rnd('stddev_samp(score_mean) / avg(score_mean)')} AS cv FROM users GROUP BY CUBE (age_predicted, gender_predicted)"""
)
def subgroup_table(spark, sf):
    return rounded(R.cell_table(roles.users(spark, sf), "score_mean", ["age_predicted", "gender_predicted"]))


@query(
    f"""WITH {roles.USERS_SQL}, c AS (SELECT age_predicted, gender_predicted, count(*) AS n FROM users GROUP BY ALL)
    SELECT *, {rnd('n / sum(n) OVER (PARTITION BY age_predicted)')} AS row_share, {rnd('n / sum(n) OVER ()')} AS share FROM c"""
)
def demographic_crosstab(spark, sf):
    return rounded(R.crosstab(roles.users(spark, sf), "age_predicted", "gender_predicted"))


@query(
    f"""WITH {roles.USERS_SQL}, l AS (
      SELECT 'age_predicted' AS dimension, age_predicted AS level, score_mean AS v FROM users UNION ALL SELECT 'gender_predicted', gender_predicted, score_mean FROM users
      UNION ALL SELECT 'community', community, score_mean FROM users UNION ALL SELECT 'segment', nullif(segment, 'MACHINERY'), score_mean FROM users),
    g AS (SELECT dimension, coalesce(level, 'unknown') AS level, count(*) AS n, {rnd('avg(v)')} AS mean, {rnd('stddev_samp(v)')} AS sd, {rnd('min(v)', 10)} AS min, {rnd('max(v)', 10)} AS max
          FROM l GROUP BY ALL)
    SELECT *, {rnd('n / sum(n) OVER (PARTITION BY dimension)')} AS share FROM g"""
)
def demographic_description(spark, sf):
    df = roles.users(spark, sf).withColumn("segment", F.nullif(F.col("segment"), F.lit("MACHINERY")))
    out = R.demographics_table(df, ["age_predicted", "gender_predicted", "community", "segment"], "score_mean")
    return rounded(out, min=10, max=10)


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    f"""WITH m AS (SELECT user_id AS author, {', '.join(f"count(*) FILTER (WHERE event_type = '{t}') / count(*) AS topic_{t}" for t in _TYPES)} FROM events GROUP BY user_id)
    SELECT author, {', '.join(f'{rnd("topic_" + t)} AS topic_{t}' for t in _TYPES)},
      CASE {' '.join(f"WHEN topic_{t} = greatest({', '.join('topic_' + x for x in _TYPES)}) THEN '{t}'" for t in _TYPES)} END AS dominant_topic,
      {rnd('greatest(' + ', '.join('topic_' + x for x in _TYPES) + ')')} AS dominant_share FROM m"""
)
def user_topic_mix(spark, sf):
    df = roles.scored(spark, sf)
    return rounded(R.topic_mix(df, "subreddit", _TYPES))


_THRESHOLDS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.80, 0.90]


@query(
    f"""WITH {roles.USERS_SQL}, t AS (SELECT CAST(unnest({_THRESHOLDS}) AS DOUBLE) AS threshold),
    c AS (SELECT threshold, count(*) AS n_total, count(*) FILTER (WHERE gender_conf >= threshold) AS n_gender, count(*) FILTER (WHERE age_conf >= threshold) AS n_age,
          count(*) FILTER (WHERE gender_conf >= threshold AND age_conf >= threshold) AS n_both FROM users, t GROUP BY threshold)
    SELECT *, {rnd('n_gender / n_total')} AS pct_gender, {rnd('n_age / n_total')} AS pct_age, {rnd('n_both / n_total')} AS pct_both FROM c"""
)
def confidence_coverage(spark, sf):
    return rounded(R.threshold_coverage(roles.users(spark, sf), _THRESHOLDS, {"gender": "gender_conf", "age": "age_conf"}))


@query(
    f"""WITH {roles.RAW_SQL}, k AS (SELECT * FROM raw WHERE trim(author) NOT IN {Q.in_list(L.BOT_AUTHORS)})
    SELECT r.subreddit, r.n AS raw_comments, coalesce(k.n, 0) AS comments, coalesce(k.u, 0) AS users, {rnd('coalesce(k.n, 0) / r.n')} AS retained
    FROM (SELECT subreddit, count(*) AS n FROM raw GROUP BY ALL) r
    LEFT JOIN (SELECT subreddit, count(*) AS n, count(DISTINCT author) AS u FROM k GROUP BY ALL) k USING (subreddit)"""
)
def corpus_inventory(spark, sf):
    raw = roles.raw(spark, sf)
    return rounded(R.inventory(raw.where(C.is_person()), raw=raw))


@query(f"WITH {roles.SCORED_SQL} SELECT author, count(*) AS n FROM scored GROUP BY author ORDER BY n DESC, author LIMIT 10")
def top_authors(spark, sf):
    return R.top_authors(roles.scored(spark, sf))


@query(
    """WITH s AS (SELECT * FROM (VALUES (0, 'click', 'view'), (1, 'signup', 'purchase'), (2, 'error', 'absent')) t(pair, first, second)),
    u AS (SELECT event_type AS c, count(DISTINCT user_id) AS n FROM events GROUP BY ALL)
    SELECT pair, first, second, coalesce(a.n, 0) AS first_users, coalesce(b.n, 0) AS second_users,
           coalesce(a.n, 0) >= 10 AND coalesce(b.n, 0) >= 10 AS valid
    FROM s LEFT JOIN u a ON a.c = first LEFT JOIN u b ON b.c = second"""
)
def seed_pair_coverage(spark, sf):
    pairs = [("Click", "View"), ("Signup", "Purchase"), ("Error", "Absent")]
    return R.seed_coverage(roles.scored(spark, sf), pairs, 10)


def _enrichment_sql() -> str:
    from cohortlens.plans.registry import SQL

    grams = [*L.HUMANISING_NGRAMS, *L.TOOL_NGRAMS]
    base = SQL["ngram_features"]
    return f"""WITH g AS ({base}), a AS (WITH {roles.COMMENTS_SQL}, {_ATTR} SELECT id, attribution_type FROM attributed)
    SELECT count(*) AS n, {', '.join(f"count(*) FILTER (WHERE attribution_type = '{k}') AS n_{k}" for k in ('bot', 'self', 'mixed', 'none'))},
      {', '.join(f"{rnd(f'''avg(CAST(attribution_type = '{k}' AS INTEGER))''')} AS share_{k}" for k in ('bot', 'self', 'mixed', 'none'))},
      {', '.join(f'CAST(sum(ngram_{g}) AS BIGINT) AS hits_{g}' for g in grams)},
      {', '.join(f'count(*) FILTER (WHERE ngram_{g} > 0) AS comments_{g}' for g in grams)},
      {rnd('avg(ngram_net_signal)')} AS mean_net_signal FROM g JOIN a USING (id)"""


@query(_enrichment_sql())
def corpus_enrichment(spark, sf):
    df = T.with_attribution(T.with_ngram_features(roles.comments(spark, sf).select("id", "body")))
    return rounded(R.enrichment_summary(df))


@query(
    f"""WITH {roles.USERS_SQL}, s AS (SELECT min(score_mean) AS lo, max(score_mean) AS hi, (max(score_mean) - min(score_mean)) / 30 AS w FROM users),
    b AS (SELECT age_predicted, CAST(least(floor((score_mean - lo) / w), 29) AS INTEGER) AS bin, lo, w, count(*) AS n FROM users, s GROUP BY ALL)
    SELECT age_predicted, bin, {rnd('lo + bin * w')} AS "left", n, {rnd('n / sum(n) OVER (PARTITION BY age_predicted) / w')} AS density FROM b"""
)
def score_histogram(spark, sf):
    return rounded(R.equal_width_histogram(roles.users(spark, sf), "score_mean", 30, ["age_predicted"]))


# ---- joins and windows ----------------------------------------------------------------------


@query(
    f"""WITH {roles.COMMENTS_SQL} SELECT CAST(l.doc_id AS VARCHAR) AS id, quality AS score, author, subreddit FROM labels l LEFT JOIN comments c ON CAST(c.id AS VARCHAR) = CAST(l.doc_id AS VARCHAR)"""
)
def scores_with_metadata(spark, sf):
    scores = roles.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("score"))
    return J.with_metadata(scores, roles.comments(spark, sf))


@query(
    f"""WITH {roles.SCORED_SQL}, s AS (SELECT author, avg(score) AS score_mean FROM scored WHERE score > 0 GROUP BY author),
    g AS (SELECT c_custkey AS author, c_mktsegment AS segment, c_acctbal AS confidence FROM customer),
    p AS (SELECT o_custkey AS author, avg(o_totalprice) AS previous FROM orders GROUP BY ALL)
    SELECT author, {rnd('score_mean')} AS score_mean, segment AS age_predicted, confidence AS age_conf, {rnd('previous', 8)} AS previous_mean
    FROM s LEFT JOIN g USING (author) LEFT JOIN p USING (author)"""
)
def analysis_dataset(spark, sf):
    """User scores with demographics and a previous score by left joins on one key."""
    scores = R.user_scores(roles.scored(spark, sf)).select("author", "score_mean")
    people = roles.table(spark, sf, "customer").withColumnRenamed("c_custkey", "author")
    before = roles.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.avg("o_totalprice").alias("previous"))
    out = J.star(
        scores,
        {
            "age": (people, {"c_mktsegment": "age_predicted", "c_acctbal": "age_conf"}),
            "previous": (before, {"previous": "previous_mean"}),
        },
    )
    return rounded(out, previous_mean=8)


@query(
    """WITH a AS (SELECT user_id AS author, CAST(count(*) AS DOUBLE) AS n_events FROM events GROUP BY ALL),
    b AS (SELECT o_custkey % 300 AS author, CAST(count(*) AS DOUBLE) AS n_orders FROM orders GROUP BY ALL)
    SELECT author, coalesce(n_events, 0) AS n_events, coalesce(n_orders, 0) AS n_orders FROM a FULL JOIN b USING (author)"""
)
def feature_blocks(spark, sf):
    a = roles.table(spark, sf, "events").groupBy(F.col("user_id").alias("author")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events")
    )
    b = roles.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 300).alias("author")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders")
    )
    return J.feature_union([a, b])


@query("SELECT d.doc_id AS id, quality, toxic, n_chars FROM documents d JOIN labels l USING (doc_id)")
def labelled_documents(spark, sf):
    d = roles.table(spark, sf, "documents").select("doc_id", "n_chars")
    return d.join(roles.table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "quality", "toxic", "n_chars")


@query("SELECT event_id AS id, user_id AS author FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def restricted_to_train_users(spark, sf):
    allowed = roles.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("author"))
    return J.restrict(roles.scored(spark, sf).select("id", "author"), allowed, "author")


@query(
    f"""WITH {roles.SCORED_SQL} SELECT author, arg_min(id, (ts, id)) AS id, arg_min(subreddit, (ts, id)) AS subreddit FROM scored GROUP BY author"""
)
def first_comment_per_user(spark, sf):
    df = roles.scored(spark, sf).select("author", "id", "subreddit", "ts")
    return C.first_per_key(df, ["author"], ["ts", "id"]).drop("ts")


@query(
    f"""WITH {roles.SCORED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY ts, id) AS rn FROM scored)
    SELECT author, id, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 5"""
)
def first_five_comments(spark, sf):
    return R.first_n(roles.scored(spark, sf).select("author", "id", "ts"), 5, ["author"], ["ts", "id"]).withColumnRenamed(
        "_rn", "rn"
    ).drop("ts")


@query(
    f"""WITH u AS (SELECT author, n, row_number() OVER (PARTITION BY author ORDER BY g) AS rn FROM (
        SELECT user_id AS author, count(*) AS n, 0 AS g FROM events GROUP BY ALL
        UNION ALL SELECT o_custkey AS author, count(*) AS n, 1 AS g FROM orders GROUP BY ALL))
    SELECT author, n FROM u WHERE rn = 1"""
)
def merged_interactions(spark, sf):
    """Union with the existing row winning over the new one."""
    old = roles.table(spark, sf, "events").groupBy(F.col("user_id").alias("author")).agg(F.count(F.lit(1)).alias("n"))
    new = roles.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("author")).agg(F.count(F.lit(1)).alias("n"))
    return IO.merged(old, new, ["author"])


@query(
    f"""WITH {roles.SCORED_SQL} SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT id FROM scored WHERE source <> 'error')"""
)
def pending_comments(spark, sf):
    todo = roles.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return IO.pending(todo, roles.scored(spark, sf))


@query(
    f"""WITH {roles.RATINGS_SQL}, w AS (SELECT item, min(score) FILTER (WHERE rater = 'alpha') AS alpha, min(score) FILTER (WHERE rater = 'beta') AS beta,
      min(score) FILTER (WHERE rater = 'gamma') AS gamma FROM ratings GROUP BY item)
    SELECT item, alpha, beta, gamma, a.score AS algorithm FROM w FULL JOIN algorithm a USING (item)"""
)
def rater_sheets(spark, sf):
    return J.rater_table(roles.ratings(spark, sf), roles.RATERS, reference=roles.algorithm(spark, sf))


# ---- samples --------------------------------------------------------------------------------

_SAMPLE = f"""h AS (SELECT id, author, subreddit, score, row_number() OVER (PARTITION BY score ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rn FROM scored WHERE score > 0),
    s AS (SELECT id, author, subreddit, score, row_number() OVER (ORDER BY md5('43:' || CAST(id AS VARCHAR)), id) AS item FROM h WHERE rn <= 40)"""


@query(f"WITH {roles.SCORED_SQL}, {_SAMPLE} SELECT id, author, subreddit, score, CAST(item AS INTEGER) AS item FROM s")
def stratified_annotation_sample(spark, sf):
    df = C.valid_scores(roles.scored(spark, sf)).select("id", "author", "subreddit", "score")
    return SM.stratified_sample(df, "id", "score", 40)


@query(f"WITH {roles.SCORED_SQL}, {_SAMPLE} SELECT CAST(item AS INTEGER) AS item, id, score, author FROM s")
def annotation_answer_key(spark, sf):
    return SM.answer_key(stratified_annotation_sample(spark, sf), "id", "score", ["author"])


@query(
    f"""WITH {roles.SCORED_SQL}, {_SAMPLE} SELECT CAST(item AS INTEGER) AS item, CAST(id AS VARCHAR) AS text, subreddit,
      CAST(NULL AS VARCHAR) AS your_score, CAST(NULL AS VARCHAR) AS reasoning, CAST(NULL AS VARCHAR) AS confidence FROM s"""
)
def annotation_blind_sheet(spark, sf):
    sample = stratified_annotation_sample(spark, sf).withColumn("body", F.col("id").cast("string"))
    return SM.blind_sheet(sample)


@query("SELECT event_id AS id FROM events ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id LIMIT 500")
def simple_sample(spark, sf):
    return SM.simple_sample(roles.table(spark, sf, "events").select(F.col("event_id").alias("id")), "id", 500)


_RANKED = f"""r AS (SELECT author, age_predicted, row_number() OVER (PARTITION BY age_predicted ORDER BY md5('42:' || CAST(author AS VARCHAR)), author) AS rank,
    count(*) OVER (PARTITION BY age_predicted) AS n FROM users)"""


@query(f"WITH {roles.USERS_SQL}, {_RANKED} SELECT author, age_predicted, rank <= round(n * 0.2) AS is_test FROM r")
def train_test_split(spark, sf):
    return SM.train_test(roles.users(spark, sf).select("author", "age_predicted"), "author", "age_predicted")


@query(f"WITH {roles.USERS_SQL}, {_RANKED} SELECT author, age_predicted, CAST((rank - 1) % 5 AS INTEGER) AS fold FROM r")
def stratified_folds(spark, sf):
    return SM.folds(roles.users(spark, sf).select("author", "age_predicted"), "author", "age_predicted")


# ---- sources --------------------------------------------------------------------------------


def _scratch(spark) -> str:
    """A fresh folder on the storage the session's jobs share."""
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/cohortlens-{uuid.uuid4().hex}" if shared else local_scratch(spark)


@query(
    f"""WITH {roles.RAW_SQL}
    SELECT _file || '_comments' AS _file, count(*) AS parsed, count(*) FILTER (WHERE conv_bad) AS malformed FROM (SELECT *, false AS conv_bad FROM raw) GROUP BY ALL"""
)
def jsonl_round_trip(spark, sf):
    """Raw comments written as JSON lines in one folder per file name, scanned back by glob."""
    base = _scratch(spark)
    raw = roles.raw(spark, sf)
    raw.drop("_pos").write.mode("overwrite").partitionBy("_file").json(f"{base}/jsonl")
    back = IO.read_jsonl(spark, f"{base}/jsonl/_file=*/*.json", keep_corrupt=True)
    folder = F.regexp_extract(F.col("_folder"), "_file=([^/]+)/", 1)
    return IO.line_counts(back, F.concat(folder, F.lit("_comments")))


@query(
    """SELECT doc_id AS item, text, source AS subreddit,
      CASE WHEN doc_id % 7 BETWEEN 1 AND 5 THEN CAST(doc_id % 7 AS INTEGER) END AS score, lang AS reasoning,
      CAST(NULL AS VARCHAR) AS confidence FROM documents"""
)
def annotation_csv_round_trip(spark, sf):
    """Whole multi-line texts through quoted CSV; scores outside 1–5 become null."""
    path = _scratch(spark) + "/sheet"
    sheet = roles.table(spark, sf, "documents").select(
        F.col("doc_id").alias("Item #"),
        F.col("text").alias("Comment Text"),
        F.col("source").alias("Subreddit"),
        (F.col("doc_id") % 7).cast("string").alias("Your Score (1-5)"),
        F.col("lang").alias("reasoning"),
    )
    sheet.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("lineSep", "\n").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return IO.read_annotations(spark, path).withColumn("item", F.col("item").cast("long"))


@query("SELECT doc_id AS id, n_chars FROM documents WHERE lang = 'en'")
def pruned_parquet_scan(spark, sf):
    return IO.read_parquet(spark, f"{sf}/documents.parquet", ["doc_id", "n_chars", "lang"]).where("lang = 'en'").select(
        F.col("doc_id").alias("id"), "n_chars"
    )


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN text END AS body FROM documents WHERE doc_id % 5 > 0")
def text_table_round_trip(spark, sf):
    """A JSON table of whole texts, some missing, read back without the missing ones."""
    path = _scratch(spark) + "/texts"
    docs = roles.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("body")
    )
    IO.write(docs, path, "json")
    return IO.read_text_table(spark, path, fmt="json").select("id", "body")


@query(
    """SELECT user_id AS author, event_type AS subreddit, CAST(count(*) AS INTEGER) AS count FROM events GROUP BY ALL
    UNION ALL SELECT user_id AS author, 'merged', 1 FROM events GROUP BY user_id"""
)
def merge_saved_interactions(spark, sf):
    """Interactions of one half of the users written, those of the other half merged in, then new and repeated ones."""
    base = _scratch(spark)
    events = roles.table(spark, sf, "events").select(F.col("user_id").alias("author"), F.col("event_type").alias("subreddit"))
    every = events.groupBy("author", "subreddit").agg(F.count(F.lit(1)).cast("int").alias("count"))
    IO.write(every.where("author % 2 = 0"), f"{base}/interactions")
    IO.merge_save(spark, f"{base}/interactions", every.where("author % 2 = 1"))
    new = events.select("author").distinct().select("author", F.lit("merged").alias("subreddit"), F.lit(1).alias("count"))
    IO.merge_save(spark, f"{base}/interactions", new.unionByName(every.withColumn("count", F.lit(-1))))
    return spark.read.parquet(IO.current(spark, f"{base}/interactions"))


@query(f"WITH {roles.USERS_SQL} SELECT author, score_mean > 1.5 AS conditional FROM users WHERE gender_conf >= 0.6 AND age_conf >= 0.6 AND score_mean > 1")
def confident_users(spark, sf):
    """The conditional sample: both confidences at the threshold and a mean above the floor."""
    df = C.confident(roles.users(spark, sf))
    return df.select("author", (F.col("score_mean") > 1.5).alias("conditional"))


@query("SELECT d.doc_id AS id, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def complete_case_documents(spark, sf):
    d = roles.table(spark, sf, "documents").select("doc_id").join(roles.table(spark, sf, "labels"), "doc_id", "left")
    return C.complete_cases(d, ["quality", "toxic"]).select(F.col("doc_id").alias("id"), "quality", "toxic")
