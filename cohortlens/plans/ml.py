"""Queries on demographics from communities, classifiers, scoring and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from cohortlens.functions import lexicons as L, text as T
from cohortlens.functions.hashing import stable_key
from cohortlens.functions.letters import letter_shares
from cohortlens.functions.scalar import NORMAL_QUANTILE
from cohortlens.operators import classify as K, clean as C, demographics as D, density as DE, importances as IMP, rollup as R, scaling as SCALE, scoring as SC
from cohortlens.plans import roles, sqltext as Q
from cohortlens.plans.models import design
from cohortlens.plans.registry import SQL, query, rounded
from cohortlens.plans.rollup import _scratch
from cohortlens.plans.text import _ATTR, _PRE
from cohortlens.streaming import ingest as ST

rnd = Q.rnd
PAIRS = [(0, 1), (2, 3), (10, 25), (4, 999999999)]

_VEC = """vec AS (SELECT vec_id AS community, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    mem AS (SELECT DISTINCT o_custkey AS author, l_suppkey AS community FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    sp AS (SELECT * FROM (VALUES (0, 1), (2, 3), (10, 25), (4, 999999999)) t(a, b)),
    df AS (SELECT list_transform(list_zip(x.v, y.v), lambda z: z[2] - z[1]) AS d FROM sp JOIN vec x ON x.community = a JOIN vec y ON y.community = b),
    ax AS (SELECT i, avg(d[i]) AS m FROM df, range(1, 65) t(i) GROUP BY i),
    nrm AS (SELECT sqrt(sum(m * m)) AS size FROM ax), dim AS (SELECT list(m / size ORDER BY i) AS dim FROM ax, nrm),
    proj AS (SELECT community, list_dot_product(v, dim) AS s FROM vec, dim),
    us AS (SELECT author, coalesce(avg(s), 0) AS score FROM mem LEFT JOIN proj USING (community) GROUP BY author)"""


def _vectors(spark, sf):
    return roles.table(spark, sf, "embeddings").select(F.col("vec_id").alias("community"), F.col("embedding").alias("vector"))


def _memberships(spark, sf):
    line, orders = roles.table(spark, sf, "lineitem"), roles.table(spark, sf, "orders")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("author"), F.col("l_suppkey").alias("community")
    )


def _user_scores(spark, sf):
    v = _vectors(spark, sf)
    return D.project_users(_memberships(spark, sf), v, D.dimension(v, PAIRS))


@query(f"WITH {_VEC} SELECT i - 1 AS i, {rnd('dim[i]')} AS weight, (SELECT count(*) FROM df) AS valid_pairs FROM dim, range(1, 65) t(i)")
def community_dimension(spark, sf):
    d = D.dimension(_vectors(spark, sf), PAIRS).select(F.posexplode("dimension").alias("i", "weight"), "valid_pairs")
    return rounded(d.withColumn("i", F.col("i").cast("long")))


@query(f"WITH {_VEC} SELECT author, {rnd('score')} AS score FROM us")
def user_projection(spark, sf):
    return rounded(_user_scores(spark, sf))


def _cut_sql(s: str, cuts) -> str:
    labels = [b for b, _, _ in L.AGE_BUCKETS]
    return "CASE " + " ".join(f"WHEN {s} < {c} THEN '{b}'" for c, b in zip(cuts, labels)) + f" ELSE '{labels[-1]}' END"


@query(
    f"""WITH {_VEC}, ur AS (SELECT author, round(score, 12) AS score FROM us),
    q AS (SELECT {', '.join(f'quantile_cont(score, {i / 5}) AS q{i}' for i in range(1, 5))}, quantile_cont(abs(score), 0.7) AS t FROM ur)
    SELECT author, {_cut_sql('score', ['q1', 'q2', 'q3', 'q4'])} AS age_quintile, CASE WHEN abs(score) < t THEN 'unknown' WHEN score < 0 THEN 'female' ELSE 'male' END AS gender_strong,
      {_cut_sql('score', L.AGE_CUTS_CALIBRATED)} AS age_calibrated, CASE WHEN abs(score - {L.GENDER_CENTRE}) < 0.05 THEN 'unknown' WHEN score - {L.GENDER_CENTRE} > 0 THEN 'male' ELSE 'female' END AS gender_calibrated
    FROM ur, q"""
)
def score_classes(spark, sf):
    """Buckets from projection scores: quintiles, strong signs, calibrated cut-offs.

    Users of the same communities tie up to the order of their sums; rounding makes the ties exact.
    """
    scores = _user_scores(spark, sf).withColumn("score", F.round("score", 12))
    s = D.gender_from_score(D.age_from_score(scores, out="age_quintile"), out="gender_strong")
    return s.select(
        "author", "age_quintile", "gender_strong", D.age_calibrated(F.col("score")).alias("age_calibrated"),
        D.gender_calibrated(F.col("score")).alias("gender_calibrated"),
    )


def _ballot_frame(spark, sf):
    a, seg = F.col("author"), F.col("segment")
    return roles.users(spark, sf).select(
        "author",
        F.when(a % 4 == 0, F.when(seg == "BUILDING", "13-18").when(seg == "FURNITURE", "19-25").otherwise("26-40")).alias("age_bucket_self_declared"),
        F.when(a % 3 != 0, F.when(F.col("score_mean") < 2.4, "13-18").when(F.col("score_mean") < 2.9, "26-40").otherwise("61-80")).alias("age_bucket_community"),
        F.when(a % 3 != 0, F.col("balance") / 10000).alias("age_community_score"),
        F.when(a % 5 != 0, F.when(F.col("n_high") > 0, "19-25").otherwise("26-40")).alias("age_bucket_llm"),
        F.when(a % 5 != 0, F.col("gender_conf")).alias("confidence_llm"),
        F.when(a % 6 == 0, F.col("gender_predicted")).alias("gender_self_declared"),
        F.when(a % 2 == 0, F.col("gender_predicted")).alias("gender_community"),
    )


@query(
    f"""WITH {roles.USERS_SQL}, b AS (SELECT author, CASE WHEN author % 4 = 0 THEN CASE segment WHEN 'BUILDING' THEN '13-18' WHEN 'FURNITURE' THEN '19-25' ELSE '26-40' END END AS s,
      CASE WHEN author % 3 <> 0 THEN CASE WHEN score_mean < 2.4 THEN '13-18' WHEN score_mean < 2.9 THEN '26-40' ELSE '61-80' END END AS c, CASE WHEN author % 3 <> 0 THEN balance / 10000 END AS cs,
      CASE WHEN author % 5 <> 0 THEN CASE WHEN n_high > 0 THEN '19-25' ELSE '26-40' END END AS m, CASE WHEN author % 5 <> 0 THEN gender_conf END AS mc,
      CASE WHEN author % 6 = 0 THEN gender_predicted END AS gs, CASE WHEN author % 2 = 0 THEN gender_predicted END AS gc FROM users),
    v AS (SELECT author, s AS bucket, 1 AS pos, 1.0::DOUBLE AS w FROM b WHERE s IS NOT NULL UNION ALL SELECT author, c, 2, 0.7::DOUBLE * least(1.0::DOUBLE, abs(cs) * 2) FROM b WHERE c IS NOT NULL UNION ALL SELECT author, m, 3, 0.6::DOUBLE * mc FROM b WHERE m IS NOT NULL),
    g AS (SELECT author, bucket, min(pos) AS pos, sum(w) AS t FROM v GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY t DESC, pos) AS rn FROM g)
    SELECT b.author, r.bucket AS age_bucket, {rnd('CASE WHEN t IS NULL THEN 0 ELSE least(1, t / 2.3::DOUBLE) END')} AS confidence, concat_ws(',', CASE WHEN s IS NOT NULL THEN 'self_decl' END, CASE WHEN c IS NOT NULL THEN 'community' END, CASE WHEN m IS NOT NULL THEN 'llm' END) AS methods_used,
      coalesce(gs, gc) AS gender FROM b LEFT JOIN r ON r.author = b.author AND rn = 1"""
)
def ensemble_vote(spark, sf):
    return rounded(D.vote(_ballot_frame(spark, sf)).select("author", "age_bucket", "confidence", "methods_used", "gender"))


_ANCHORS = {"romantic": 0, "friendship": 1, "dependency": 2, "tool_usage": 3}


@query(
    f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label FROM embeddings),
    m AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) t(i) WHERE label < 4 GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label),
    s AS (SELECT vec_id, {', '.join(f'list_cosine_similarity(v, (SELECT c FROM c WHERE label = {i})) AS sim_{k}' for k, i in _ANCHORS.items())} FROM e)
    SELECT vec_id, {', '.join(f'{rnd("sim_" + k)} AS sim_{k}' for k in _ANCHORS)}, {rnd('sim_romantic + sim_friendship + sim_dependency - sim_tool_usage')} AS relationship_score FROM s"""
)
def relationship_language(spark, sf):
    e = roles.table(spark, sf, "embeddings")
    named = F
    for k, i in _ANCHORS.items():
        named = named.when(F.col("label") == i, k)
    anchors = e.select(named.alias("category"), "embedding")
    return rounded(D.relationship_scores(e.select("vec_id", "embedding"), anchors).drop("embedding"))


# ---- MLlib ----------------------------------------------------------------------------------

FEATURES = ["score_mean", "score_std", "score_count", "balance", *roles.USER_EMOTIONS[:4]]


def labelled(spark, sf):
    return design(spark, sf).withColumn("label", F.col("is_teen"))


@query(
    """WITH mem AS (SELECT DISTINCT o_custkey AS author, l_suppkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT CAST(c AS VARCHAR) AS community, 100 AS size FROM mem GROUP BY c HAVING count(*) >= 3"""
)
def community_word_vectors(spark, sf):
    lists = R.participation(_memberships(spark, sf).withColumn("c", F.col("community").cast("string")), community="c", min_count=1)
    v = K.community_vectors(lists, "communities")
    return v.select("community", F.size("vector").alias("size"))


@query(
    """WITH mem AS (SELECT DISTINCT o_custkey AS author, l_suppkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    known AS (SELECT c FROM mem GROUP BY c HAVING count(*) >= 10 ORDER BY count(*) DESC, c LIMIT 500)
    SELECT author, CAST(count(known.c) AS INTEGER) AS n_known FROM mem LEFT JOIN known USING (c) GROUP BY author"""
)
def community_count_vectors(spark, sf):
    lists = R.participation(_memberships(spark, sf), community="community", min_count=1, lower=False)
    out = K.membership_vectors(lists)
    return out.select("author", F.size(F.filter(K.vector_to_array("features"), lambda x: x > 0)).alias("n_known"))


@query()
def stacked_classifier(spark, sf):
    signals = {"scores": ["score_mean", "score_std", "score_count"], "emotions": roles.USER_EMOTIONS[:4]}
    out = K.stacked(labelled(spark, sf), signals, "author", "label", k=5)
    return K.with_confidence(out, ["adult", "teen"], 0.6).select("author", "label", "predicted", "confidence", "prob_teen")


def _hidden():
    return F.substring(stable_key("author"), 1, 1).isin("0", "1", "2")


_HIDDEN = "substr(md5('42:' || CAST(author AS VARCHAR)), 1, 1) IN ('0', '1', '2')"


@query(f"WITH {roles.USERS_SQL} SELECT author, {_HIDDEN} AS unlabelled, true AS sums_to_one, true AS confident_label FROM users")
def stacked_predictions(spark, sf):
    """A stack learned from the labelled users predicts all of them, those whose label is hidden too."""
    signals = {"scores": ["score_mean", "score_std", "score_count"], "emotions": roles.USER_EMOTIONS[:4]}
    users = labelled(spark, sf).withColumn("unlabelled", _hidden())
    stack = K.fit_stack(users.where(~F.col("unlabelled")), signals, "author", "label", k=5)
    out = stack.predict(users.select("author", "unlabelled", *signals["scores"], *signals["emotions"]), ["adult", "teen"], 0.6)
    best = F.when(F.col("prob_teen") > F.col("prob_adult"), "teen").otherwise("adult")
    right = F.col("predicted").eqNullSafe(F.when(F.col("confidence") >= 0.6, best))
    return out.select("author", "unlabelled", (F.abs(F.col("prob_adult") + F.col("prob_teen") - 1) < 1e-9).alias("sums_to_one"), right.alias("confident_label"))


@query()
def class_weight_search(spark, sf):
    return rounded(K.weight_search(labelled(spark, sf), FEATURES, "author", "label", [1.0, 1.1, 1.2, 1.3, 1.4, 1.5], k=5))


@query()
def regularisation_grid(spark, sf):
    return rounded(K.grid_search(labelled(spark, sf), FEATURES, "author", "label", [0.0, 0.01, 0.1], k=5))


@query()
def boosted_weight_search(spark, sf):
    """Class weight of boosted trees under the limits on accuracy and recall."""
    trees = K.boosted_estimator("label", depth=3)
    return rounded(K.weight_search(labelled(spark, sf), FEATURES, "author", "label", [1.0, 1.1, 1.2, 1.3, 1.4, 1.5], k=3, estimator=trees))


@query()
def boosted_grid(spark, sf):
    """Depth and learning rate of boosted trees by cross-validation."""
    return rounded(K.boosted_grid(labelled(spark, sf), FEATURES, "author", "label", [2, 4], [0.05, 0.1], k=3))


@query()
def boosted_groups(spark, sf):
    """Age and gender as four classes: boosted one against the rest on the training users, predicted for the held-out ones."""
    users = roles.users(spark, sf).withColumn("group", F.concat_ws("-", "age_predicted", "gender_predicted"))
    users = users.where("age_predicted IS NOT NULL AND gender_predicted IS NOT NULL").na.drop(subset=FEATURES)
    names = [r[0] for r in users.select("group").distinct().orderBy("group").collect()]  # one row per class
    users = K.indexed(users, "group").withColumn("held_out", _hidden())
    model = K.boosted(users.where("NOT held_out"), FEATURES, "label", n_classes=len(names))
    out = K.with_confidence(model.transform(K.assembled(users.where("held_out"), FEATURES)), names)
    return rounded(out.select("author", "group", "predicted", "confidence"))


_SCALED = ["score_mean", "balance"]


@query(
    f"WITH {roles.USERS_SQL} SELECT author, "
    + ", ".join(f"{rnd(f'({c} - (SELECT avg({c}) FROM users)) / (SELECT stddev_pop({c}) FROM users)')} AS {c}" for c in _SCALED)
    + " FROM users"
)
def standard_scaling(spark, sf):
    return rounded(K.standardised(roles.users(spark, sf).select("author", *_SCALED), _SCALED))


_MARKS = 1000


def _phi_sql(p: str) -> str:
    """The rational normal quantile as SQL."""
    def poly(r, c):
        return "(" * (len(c) - 1) + f"{c[-1]!r}::DOUBLE" + "".join(f" * ({r}) + {x!r}::DOUBLE)" for x in c[-2::-1])

    middle, tail, far = NORMAL_QUANTILE
    q, t = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    rational = lambda r, cd: f"{poly(r, cd[0])} / {poly(r, cd[1])}"
    return f"""CASE WHEN abs({q}) <= 0.425 THEN {q} * {rational(f'0.180625::DOUBLE - {q} * {q}', middle)}
        ELSE sign({q}) * CASE WHEN {t} <= 5 THEN {rational(f'{t} - 1.6::DOUBLE', tail)} ELSE {rational(f'{t} - 5', far)} END END"""


@query(
    f"""WITH {roles.USERS_SQL}, u AS (SELECT author, {_HIDDEN} AS held_out, balance, CAST(score_count AS DOUBLE) AS score_count FROM users),
    long AS (SELECT author, held_out, unnest(['balance', 'score_count']) AS name, unnest([balance, score_count]) AS x FROM u),
    marks AS (SELECT name, quantile_cont(x, [{', '.join(f'{i} / {_MARKS - 1}.0::DOUBLE' for i in range(_MARKS))}]) AS m FROM long WHERE NOT held_out GROUP BY name),
    placed AS (SELECT author, held_out, name, x, m, len(list_filter(m, lambda y: y < x)) AS under, len(list_filter(m, lambda y: y <= x)) AS upto FROM long JOIN marks USING (name)),
    share AS (SELECT *, greatest(1e-7, least(1 - 1e-7, CASE WHEN upto = 0 THEN 0 WHEN under = {_MARKS} THEN 1 WHEN upto > under THEN (under + upto - 1) / 2.0::DOUBLE / {_MARKS - 1}
        ELSE (under - 1 + (x - m[under]) / (m[under + 1] - m[under])) / {_MARKS - 1} END)) AS p FROM placed),
    z AS (SELECT author, held_out, name, {_phi_sql('p')} AS z FROM share)
    SELECT author, held_out, {rnd("max(z) FILTER (WHERE name = 'balance')")} AS balance, {rnd("max(z) FILTER (WHERE name = 'score_count')")} AS score_count FROM z GROUP BY author, held_out"""
)
def quantile_normal_transform(spark, sf):
    """Two columns mapped to normal scores by the marks of the training users; the held-out users take no part in the fit."""
    users = roles.users(spark, sf).select("author", "balance", F.col("score_count").cast("double").alias("score_count"))
    users = users.withColumn("held_out", _hidden())
    columns = ["balance", "score_count"]
    return rounded(SCALE.to_normal(users, SCALE.quantile_marks(users.where("NOT held_out"), columns, _MARKS), columns, landmarks=_MARKS))


#: A fixed linear scorer, as a transformer of MLlib.
_RULE = "1.5 * score_mean + 0.2 * score_std - 0.05 * score_count + balance / 4000.0 - 3.0 * emotion_joy + emotion_fear > 1.0"


def _sql_f1() -> str:
    cases = ", ".join(f"CASE WHEN f.feature = '{c}' THEN o.{c} ELSE t.{c} END AS {c}" for c in FEATURES)
    return f"""WITH {roles.USERS_SQL}, test AS (SELECT author, CAST(age_predicted = 'teen' AS INTEGER) AS label, {', '.join(FEATURES)},
        row_number() OVER (ORDER BY md5('42:' || author), author) AS i FROM users WHERE {_HIDDEN}),
    donor AS (SELECT r.rep, row_number() OVER (PARTITION BY r.rep ORDER BY md5('7961:' || r.rep || ':' || author), author) AS i, test.* EXCLUDE (i) FROM test, range(5) r(rep)),
    long AS (SELECT f.feature, o.rep, t.label, {cases} FROM test t JOIN donor o USING (i), (SELECT unnest({FEATURES}) AS feature) f
        UNION ALL SELECT NULL, -1, label, {', '.join(FEATURES)} FROM test),
    scored AS (SELECT feature, rep, label, CAST({_RULE} AS INTEGER) AS prediction FROM long),
    part AS (SELECT feature, rep, c, count(*) FILTER (WHERE label = c AND prediction = c) AS hit, count(*) FILTER (WHERE label = c) + count(*) FILTER (WHERE prediction = c) AS either
        FROM scored, (SELECT unnest([0, 1]) AS c) GROUP BY feature, rep, c),
    f1 AS (SELECT feature, rep, avg(2 * hit / CAST(either AS DOUBLE)) AS f1 FROM part WHERE either > 0 GROUP BY feature, rep)
    SELECT feature, {rnd('avg(base.f1 - f1.f1)')} AS importance, {rnd('stddev_pop(base.f1 - f1.f1)')} AS sd FROM f1, (SELECT f1 FROM f1 WHERE feature IS NULL) base WHERE feature IS NOT NULL GROUP BY feature"""


@query(_sql_f1())
def permutation_importance(spark, sf):
    """Importance for a fixed linear rule on held-out users, five repeats of every column."""
    rule = SQLTransformer(statement=f"SELECT *, CAST({_RULE} AS DOUBLE) AS prediction FROM __THIS__")
    return rounded(IMP.permutation_importance(rule, labelled(spark, sf).where(_hidden()), FEATURES, "author", "label"))


@query()
def trained_model_importance(spark, sf):
    """Importance for boosted trees fitted on the training users, on the held-out ones."""
    users = labelled(spark, sf).withColumn("held_out", _hidden())
    model = K.boosted(users.where("NOT held_out"), FEATURES, "label")
    return rounded(IMP.permutation_importance(model, users.where("held_out"), FEATURES, "author", "label"))


@query()
def tree_importance(spark, sf):
    return rounded(K.tree_importances(labelled(spark, sf), FEATURES, "label"))


@query()
def topic_clusters(spark, sf):
    out = K.topics(roles.table(spark, sf, "embeddings"), "embedding", k=8)
    return out.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñóí"


@query()
def topic_density_clusters(spark, sf):
    """Comments by the shares of their letters, clustered by density: languages stand apart, odd texts are -1; no number is given."""
    comments = roles.comments(spark, sf).where("body IS NOT NULL")
    return DE.topics(comments.select("id", letter_shares(F.lower("body"), _LETTERS).alias("shares")), "id", "shares")


# ---- scoring --------------------------------------------------------------------------------


def _lexicon_sql() -> str:
    return f"""WITH g AS ({SQL['ngram_features']}), a AS (WITH {roles.COMMENTS_SQL}, {_ATTR} SELECT id, bot_attribution_score FROM attributed),
    n AS (SELECT id, ngram_anthro_total - ngram_deanthro_total AS net, bot_attribution_score FROM g JOIN a USING (id))
    SELECT id, CAST(least(5, CASE WHEN net <= 0 THEN 1 WHEN net <= 1 THEN 2 WHEN net <= 3 THEN 3 ELSE 4 END + CAST(bot_attribution_score > 0.5 AS INTEGER)) AS INTEGER) AS score FROM n"""


@query(_lexicon_sql())
def lexicon_scores(spark, sf):
    return SC.lexicon_score(roles.comments(spark, sf).select("id", "body")).select("id", "score")


def word_scorer(texts: pd.Series) -> pd.DataFrame:
    """A stand-in for a model: longer texts score higher."""
    n = texts.str.count(r"\S+")
    return pd.DataFrame({"score": (1 + n // 40).clip(1, 5), "reasoning": "words=" + n.astype(str)})


@query(
    f"""WITH {roles.COMMENTS_SQL}, {_PRE}, w AS (SELECT p.id, reason, {Q.count('body', r'\S+')} AS n FROM pre p JOIN comments c ON c.id = p.id)
    SELECT id, CAST(CASE WHEN reason <> 'needs_scoring' THEN 1 ELSE least(5, 1 + n // 40) END AS INTEGER) AS score, CASE WHEN reason <> 'needs_scoring' THEN 'prefilter:' || reason ELSE 'words=' || CAST(n AS VARCHAR) END AS reasoning,
      CASE WHEN reason <> 'needs_scoring' THEN 'prefilter' ELSE 'model' END AS source FROM w"""
)
def batch_scoring(spark, sf):
    """Prefilter, then a pluggable scorer over Arrow batches of whole texts."""
    return SC.score_with(roles.comments(spark, sf), word_scorer).select("id", "score", "reasoning", "source")


# ---- streams --------------------------------------------------------------------------------


@query(SQL["comments_cleaned"])
def streamed_ingest(spark, sf):
    """Comments arrive as JSON files and leave cleaned and unique as Parquet."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = _scratch(spark)
    roles.raw(spark, sf).drop("_file", "_pos").write.mode("overwrite").json(f"{base}/in")
    ST.ingest(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "3650 days").awaitTermination()
    return ST.ingested(spark, f"{base}/out").select(*C.COMMENT_COLUMNS)


@query(
    f"""WITH {roles.SCORED_SQL} SELECT date_trunc('day', ts) AS period, subreddit, count(*) AS n, {rnd('avg(score)')} AS mean, max(score) AS max FROM scored WHERE score > 0 GROUP BY ALL"""
)
def daily_scores(spark, sf):
    return rounded(ST.period_scores(roles.scored(spark, sf)))


@query(SQL["daily_scores"])
def streamed_daily_scores(spark, sf):
    """The same periods from a stream of the event file, saved batch by batch."""
    base = _scratch(spark)
    schema = roles.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    v = F.col("value")
    stream = events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("subreddit"),
        F.when(v >= 150, 0).otherwise((1 + F.floor(F.least(v, F.lit(149.99)) / 30)).cast("int")).alias("score"),
    )
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ST.upsert_periods(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return rounded(ST.periods(spark, f"{base}/out").withColumn("period", F.col("period").cast("timestamp_ntz")))
