"""The flagship query: from raw texts to a profile of every community and language, and a group effect."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.operators import clean as C, groups as G
from cohortlens.plans import roles, sqltext as Q
from cohortlens.plans.registry import SQL, query, rounded
from cohortlens.plans.stats import _two_sql
from cohortlens.plans.text import _ATTR, _PRE, _QUALITY

rnd = Q.rnd


def _features(spark, sf):
    docs = roles.comments(spark, sf).where(C.has_quality_text())
    docs = T.with_attribution(T.with_ngram_features(T.with_prefilter(docs, out="pre")))
    docs = docs.select(
        "id", "subreddit", "lang", F.col("pre.skip").alias("skip"), "ngram_anthro_total", "ngram_net_signal",
        "bot_attribution_score", "attribution_type", T.word_count(F.col("body")).alias("words"),
    )
    labels = roles.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return docs.join(labels, "id", "left")


_FEATURES = f"""ng AS ({SQL['ngram_features']}), base AS (WITH {roles.COMMENTS_SQL}, {_ATTR}, {_PRE}
      SELECT c.id, c.subreddit, c.lang, p.reason <> 'needs_scoring' AS skip, ngram_anthro_total, ngram_net_signal, bot_attribution_score, attribution_type, {Q.count('body', r'\S+')} AS words, quality
      FROM comments c JOIN pre p ON p.id = c.id JOIN ng ON ng.id = c.id JOIN attributed a ON a.id = c.id LEFT JOIN labels ON doc_id = c.id WHERE {_QUALITY})"""


@query(
    f"""WITH {_FEATURES} SELECT subreddit, lang, count(*) AS n, {rnd('avg(CAST(skip AS INTEGER))')} AS skipped_share, {rnd('avg(words)')} AS mean_words, {rnd('avg(ngram_net_signal)', 5)} AS mean_net_signal,
      CAST(sum(ngram_anthro_total) AS BIGINT) AS anthro_hits, {rnd('avg(bot_attribution_score)')} AS mean_attribution, count(*) FILTER (WHERE attribution_type <> 'none') AS n_attributed,
      count(quality) AS n_labelled, {rnd('avg(quality)')} AS quality_share FROM base GROUP BY GROUPING SETS ((subreddit, lang), (subreddit), (lang), ())"""
)
def cohort_text_profile(spark, sf):
    """Cleaning, prefilter, n-grams and attribution over all documents, rolled up by community and language."""
    df = _features(spark, sf)
    out = df.cube("subreddit", "lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("skip").cast("double")).alias("skipped_share"),
        F.avg("words").alias("mean_words"),
        F.avg("ngram_net_signal").alias("mean_net_signal"),
        F.sum("ngram_anthro_total").cast("long").alias("anthro_hits"),
        F.avg("bot_attribution_score").alias("mean_attribution"),
        F.count_if(F.col("attribution_type") != "none").alias("n_attributed"),
        F.count("quality").alias("n_labelled"),
        F.avg("quality").alias("quality_share"),
    )
    return rounded(out, mean_net_signal=5)


@query(
    f"""WITH {_FEATURES}, {_two_sql('s', 'base', 'quality', '1', '0', 'words')}
    SELECT n_a, n_b, {rnd('mean_a')} AS mean_a, {rnd('mean_b')} AS mean_b, {rnd('diff')} AS diff, {rnd('welch_t')} AS t, {rnd('d')} AS d FROM s"""
)
def quality_text_effect(spark, sf):
    """Effect of document quality on length among the cleaned, labelled documents."""
    s = G.effect_size(G.welch(G.two_groups(_features(spark, sf), "quality", 1, 0, "words"), p_value=False))
    return rounded(s.select("n_a", "n_b", "mean_a", "mean_b", "diff", "t", "d"))
