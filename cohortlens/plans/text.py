"""Queries over text: cleaning, prefilter, normalisation, lexicons, declarations, language."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import lexicons as L, scalar as S, text as T
from cohortlens.operators import clean as C
from cohortlens.plans import roles, sqltext as Q
from cohortlens.plans.registry import query, rounded

# ---- cleaning -------------------------------------------------------------------------------

_PERSON = f"({Q.strip('author')} <> '' AND {Q.strip('author')} NOT IN {Q.in_list(L.BOT_AUTHORS)})"
_QUALITY = (
    f"(length({Q.strip('body')}) BETWEEN {L.MIN_LENGTH} AND {L.MAX_LENGTH} "
    f"AND length({Q.strip(Q.without_urls('body'))}) >= {L.MIN_LENGTH})"
)
_STD = """std AS (
  SELECT id, author, body, created_utc, subreddit, '' AS link_id, '' AS parent_id, 0::BIGINT AS score,
         nullif(author_flair_text, '') AS author_flair_text, _file, _pos FROM raw WHERE id <> '' AND author <> '')"""


@query(f"WITH {roles.RAW_SQL}, {_STD} SELECT * EXCLUDE (_file, _pos) FROM std")
def comments_standardised(spark, sf):
    return C.standardise(roles.raw(spark, sf))


@query(
    f"""WITH {roles.RAW_SQL}, {_STD},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY _file, id ORDER BY _pos) AS rn FROM std),
    kept AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY _file, _pos) AS k FROM firsts
             WHERE rn = 1 AND {_PERSON} AND {_QUALITY})
    SELECT * EXCLUDE (_file, _pos, rn, k) FROM kept WHERE k = 1"""
)
def comments_cleaned(spark, sf):
    return C.clean(roles.raw(spark, sf))


@query(
    f"""WITH {roles.COMMENTS_SQL}
    SELECT id, author, subreddit, length(body) AS n FROM comments WHERE {_PERSON} AND {_QUALITY}"""
)
def quality_filter(spark, sf):
    df = roles.comments(spark, sf).where(C.is_person() & C.has_quality_text())
    return df.select("id", "author", "subreddit", F.length("body").cast("long").alias("n"))


@query(
    """SELECT text AS body, arg_min(doc_id, doc_id) AS id, arg_min(source, doc_id) AS subreddit
       FROM documents GROUP BY text"""
)
def exact_copies_removed(spark, sf):
    df = roles.comments(spark, sf).select("id", "body", "subreddit")
    return C.first_per_key(df, ["body"], ["id"])


@query(
    f"""WITH {roles.RAW_SQL}, {_STD},
    firsts AS (SELECT *, row_number() OVER (PARTITION BY _file, id ORDER BY _pos) AS rn FROM std),
    f AS (SELECT * FROM firsts WHERE rn = 1)
    SELECT r._file, r.n AS initial_count, count(f.id) AS after_standardization,
           count(f.id) FILTER (WHERE {_PERSON}) AS after_bot_filter,
           count(f.id) FILTER (WHERE {_PERSON} AND {_QUALITY}) AS after_text_filter,
           count(f.id) FILTER (WHERE {_PERSON} AND {_QUALITY}) AS after_deduplication,
           count(f.id) FILTER (WHERE {_PERSON} AND {_QUALITY}) AS final_count
    FROM (SELECT _file, count(*) AS n FROM raw GROUP BY _file) r LEFT JOIN f ON f._file = r._file GROUP BY ALL"""
)
def cleaning_funnel(spark, sf):
    return C.funnel(roles.raw(spark, sf))


@query(
    f"""WITH {roles.RAW_SQL}
    SELECT id, author FROM raw WHERE NOT regexp_matches(lower(author), '{'|'.join(L.BOT_NAME_PARTS)}') AND length(body) >= 10
      AND id NOT IN (SELECT 'c' || CAST(doc_id AS VARCHAR) FROM labels)"""
)
def replication_comments(spark, sf):
    """Substring bot filter, and no overlap with the labelled main set."""
    main = roles.table(spark, sf, "labels").select(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"))
    df = roles.raw(spark, sf).where(C.is_replication_text()).select("id", "author")
    return C.exclude_ids(df, main)


_PRE = f"""pre AS (
  SELECT id, subreddit, CASE WHEN body IS NULL OR length(body) = 0 THEN 'empty'
    WHEN length(c) < {L.PREFILTER_MIN_CHARS} THEN 'too_short'
    WHEN {Q.count('c', r'\S+')} < {L.PREFILTER_MIN_WORDS} THEN 'too_few_words'
    WHEN NOT {Q.matches(Q.fold('c'), L.AI_REFERENCE)} AND {Q.keywords('lower(c)', L.TECHNICAL_TERMS)} >= 2 THEN 'technical_only'
    ELSE 'needs_scoring' END AS reason
  FROM (SELECT *, {Q.strip('body')} AS c FROM comments))"""


@query(
    f"""WITH {roles.COMMENTS_SQL}, {_PRE}
    SELECT id, reason <> 'needs_scoring' AS skip, CASE WHEN reason <> 'needs_scoring' THEN 1 ELSE 0 END AS score, reason
    FROM pre"""
)
def scoring_prefilter(spark, sf):
    return T.with_prefilter(roles.comments(spark, sf).select("id", "body"), out="p").select("id", "p.*")


@query(
    f"""WITH {roles.COMMENTS_SQL}, shown AS (
      SELECT id, {Q.display('body')} AS shown FROM comments),
    bare AS (SELECT *, {Q.strip(r"regexp_replace(shown, '\[(image|link)\]', '', 'g')")} AS bare FROM shown)
    SELECT id, shown, CASE WHEN length(shown) > 200 THEN shown[:200] || '...' ELSE shown END AS preview,
           length(bare) >= 30 AND {Q.count('bare', chr(92) + '[')} <= 3 AS eligible FROM bare"""
)
def annotation_text(spark, sf):
    shown = T.display_text(F.col("body"))
    return roles.comments(spark, sf).select(
        "id", shown.alias("shown"), T.truncated(shown, 200).alias("preview"), T.annotation_eligible().alias("eligible")
    )


# ---- normalisation --------------------------------------------------------------------------

_RUNS = """list_transform(list_zip(ch, [NULL] || ch[:len(ch) - 1], [NULL, NULL] || ch[:len(ch) - 2]),
      lambda z: CASE WHEN z[1] = z[2] AND z[1] = z[3] AND z[1] <> chr(10) THEN '' ELSE z[1] END)"""


@query(
    f"""WITH {roles.COMMENTS_SQL}, c AS (SELECT id, string_split(body, '') AS ch FROM comments)
    SELECT id, array_to_string({_RUNS}, '') AS body FROM c"""
)
def elongation_collapsed(spark, sf):
    return roles.comments(spark, sf).select("id", T.collapse_elongation(F.col("body")).alias("body"))


_SLANG_CASE = "CASE lower(t) " + " ".join(
    f"WHEN {Q.lit(k)} THEN {Q.lit(v)}" for k, v in L.SLANG.items() if "/" not in k
) + " END"
_SLANG_SQL = f"""array_to_string(list_transform(regexp_extract_all({{text}}, '[\\p{{{{L}}}}\\p{{{{N}}}}_]+|[^\\p{{{{L}}}}\\p{{{{N}}}}_]+'),
   lambda t: coalesce(CASE WHEN t[1:1] = upper(t[1:1]) AND t[1:1] <> lower(t[1:1])
                    THEN upper(({_SLANG_CASE})[1:1]) || ({_SLANG_CASE})[2:] ELSE {_SLANG_CASE} END, t)), '')"""


@query(f"WITH {roles.RAW_SQL} SELECT id, {_SLANG_SQL.format(text='body')} AS body FROM raw")
def slang_expanded(spark, sf):
    return roles.raw(spark, sf).select("id", T.expand_slang(F.col("body")).alias("body"))


_EMOJI_SQL = Q.strip(r"regexp_replace(regexp_replace(body, '[\p{So}\x{1F3FB}-\x{1F3FF}\x{200D}\x{FE0F}]', '', 'g'), '\s+', ' ', 'g')")


@query(
    f"""WITH {roles.COMMENTS_SQL}, c AS (SELECT id, string_split(body, '') AS ch FROM comments), e AS (SELECT id, array_to_string({_RUNS}, '') AS body FROM c),
    s AS (SELECT id, {_SLANG_SQL.format(text='body')} AS body FROM e) SELECT id, {_EMOJI_SQL} AS body FROM s"""
)
def text_normalised(spark, sf):
    """Elongation, slang and emoji in one go, over all documents."""
    return roles.comments(spark, sf).select("id", T.normalise(F.col("body")).alias("body"))


@query(
    f"WITH {roles.COMMENTS_SQL} SELECT id, {_EMOJI_SQL} AS body FROM comments"
)
def emoji_removed(spark, sf):
    return roles.comments(spark, sf).select("id", T.remove_emoji(F.col("body")).alias("body"))


def _bounded_sql(expr: str, tier: list[str], token: str) -> str:
    """Two passes: a match may have used up the separator its right neighbour needs."""
    pattern = r"(?i)(^|[^\p{L}\p{N}_])" + T.entity_pattern(tier) + r"($|[^\p{L}\p{N}_])"
    for _ in range(2):
        expr = f"regexp_replace({expr}, {Q.lit(pattern)}, {Q.lit(chr(92) + '1' + token + chr(92) + '2')}, 'g')"
    return expr


def _entities_sql(expr: str, token: str) -> str:
    for tier in T.entity_tiers():
        expr = _bounded_sql(expr, tier, token)
    return expr


_ANY = r"(?:^|[^\p{L}\p{N}_])" + T.entity_pattern([v for t in T.entity_tiers() for v in t]) + r"(?:$|[^\p{L}\p{N}_])"


@query(
    f"""WITH {roles.COMMENTS_SQL}
    SELECT id, {_entities_sql('body', L.ENTITY_TOKEN)} AS body, {Q.matches('body', _ANY)} AS has_entity FROM comments"""
)
def entities_normalised(spark, sf):
    return roles.comments(spark, sf).select(
        "id", T.replace_entities(F.col("body")).alias("body"), T.has_entity(F.col("body")).alias("has_entity")
    )


_VARIANTS = "variants AS (SELECT unnest([" + ", ".join(Q.lit(v) for v in L.ENTITY_VARIANTS) + "]) AS variant)"


@query(
    f"""WITH {roles.COMMENTS_SQL}, {_VARIANTS},
    low AS (SELECT id, {Q.fold('lower(body)')} AS t FROM comments),
    pieces AS (SELECT id, variant, string_split_regex(t, '\\b' || replace(replace(variant, '.', '\\.'), '-', '\\-') || '\\b') AS p
               FROM low, variants WHERE contains(t, variant)),
    ks AS (SELECT id, variant, p, unnest(range(1, len(p))) AS k FROM pieces WHERE len(p) > 1)
    SELECT id, variant,
           CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(variant) AS INTEGER) AS "start",
           CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + k * length(variant) AS INTEGER) AS "end"
    FROM ks"""
)
def entity_positions(spark, sf):
    df = T.with_entity_positions(roles.comments(spark, sf).select("id", "body"))
    return T.exploded(df, "positions", "o", "id").select("id", "o.*")


@query(
    f"""WITH {roles.COMMENTS_SQL},
    s AS (SELECT id, unnest(list_filter(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
                 lambda x: length({Q.strip('x')}) > 0)) AS sentence FROM comments)
    SELECT id, {_entities_sql('sentence', L.MASK_TOKEN)} AS sentence FROM s WHERE {Q.matches('sentence', _ANY)}"""
)
def masked_sentences(spark, sf):
    df = roles.comments(spark, sf).withColumn("s", T.masked_sentences(F.col("body")))
    return T.exploded(df, "s", "sentence", "id")


# ---- n-grams --------------------------------------------------------------------------------


def _ngram_sql() -> str:
    def n(pair):
        bi, tri = pair
        e = f"len(list_filter(bi, lambda g: g IN {Q.in_list(bi)}))"
        return e + (f" + len(list_filter(tri, lambda g: g IN {Q.in_list(tri)}))" if tri else "")

    human = {k: n(v) for k, v in L.HUMANISING_NGRAMS.items()}
    tool = {k: n(v) for k, v in L.TOOL_NGRAMS.items()}
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS ngram_{k}" for k, e in {**human, **tool}.items())
    a = " + ".join(f"ngram_{k}" for k in human)
    d = " + ".join(f"ngram_{k}" for k in tool)
    return f"""WITH {roles.COMMENTS_SQL},
    tok AS (SELECT id, subreddit, lang, regexp_extract_all(lower(body), {Q.lit(L.TOKEN)}) AS tok FROM comments),
    grams AS (SELECT *, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]) AS bi,
                     list_transform(range(1, len(tok) - 1), lambda i: tok[i] || ' ' || tok[i + 1] || ' ' || tok[i + 2]) AS tri
              FROM tok),
    counted AS (SELECT id, {cols}, len(bi) + len(tri) AS total FROM grams),
    sums AS (SELECT *, {a} AS ngram_anthro_total, {d} AS ngram_deanthro_total FROM counted)
    SELECT * EXCLUDE (total),
      {Q.rnd('CASE WHEN total > 0 THEN ngram_anthro_total / total ELSE 0 END')} AS ngram_anthro_density,
      {Q.rnd('CASE WHEN total > 0 THEN ngram_deanthro_total / total ELSE 0 END')} AS ngram_deanthro_density,
      {Q.rnd('CASE WHEN ngram_anthro_total + ngram_deanthro_total > 0 THEN (ngram_anthro_total - ngram_deanthro_total) / (ngram_anthro_total + ngram_deanthro_total) ELSE 0 END')} AS ngram_net_signal
    FROM sums"""


@query(_ngram_sql())
def ngram_features(spark, sf):
    df = T.with_ngram_features(roles.comments(spark, sf))
    return rounded(df.drop("body", "subreddit", "lang", "author"))


@query(
    f"""WITH {roles.COMMENTS_SQL},
    tok AS (SELECT lang, regexp_extract_all(lower(body), {Q.lit(L.TOKEN)}) AS tok FROM comments),
    bi AS (SELECT lang, unnest(list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1])) AS gram FROM tok)
    SELECT lang, gram, count(*) AS n FROM bi GROUP BY ALL ORDER BY n DESC, lang, gram LIMIT 100"""
)
def top_bigrams(spark, sf):
    """Report of the most frequent bigrams; counts are combined map-side before the top-k."""
    df = roles.comments(spark, sf).withColumn("tok", T.tokens(F.col("body"))).withColumn("b", T.bigrams(F.col("tok")))
    df = T.exploded(df, "b", "gram", "lang")
    return df.groupBy("lang", "gram").count().withColumnRenamed("count", "n").orderBy(
        F.desc("n"), "lang", "gram"
    ).limit(100)


# ---- attribution ----------------------------------------------------------------------------

_ATTR = f"""attr AS (
  SELECT id, author, subreddit, {Q.hits('b', L.BOT_EMOTION_PATTERNS)} AS n_bot, {Q.hits('b', L.SELF_EMOTION_PATTERNS)} AS n_self,
         ({' || '.join(f'regexp_extract_all(b, {Q.lit("(?i)" + p)})' for p in L.BOT_EMOTION_PATTERNS)}) AS matched_patterns
  FROM (SELECT *, {Q.strip(Q.fold('body'))} AS b FROM comments)),
attributed AS (
  SELECT *, n_bot > 0 AS bot_attributed, n_self > 0 AS self_expressed,
         CASE WHEN n_bot > 0 AND n_self > 0 THEN 'mixed' WHEN n_bot > 0 THEN 'bot' WHEN n_self > 0 THEN 'self' ELSE 'none' END AS attribution_type,
         CASE WHEN n_bot > 0 AND n_self > 0 THEN n_bot / (n_bot + n_self) WHEN n_bot > 0 THEN least(1.0::DOUBLE, n_bot * 0.4::DOUBLE)
              ELSE 0.0::DOUBLE END AS bot_attribution_score
  FROM attr)"""


@query(
    f"""WITH {roles.COMMENTS_SQL}, {_ATTR}
    SELECT id, n_bot, n_self, bot_attributed, self_expressed, attribution_type,
           {Q.rnd('bot_attribution_score')} AS bot_attribution_score, matched_patterns FROM attributed"""
)
def emotion_attribution(spark, sf):
    df = T.with_attribution(roles.comments(spark, sf))
    return rounded(
        df.select(
            "id", "n_bot", "n_self", "bot_attributed", "self_expressed", "attribution_type", "bot_attribution_score",
            "matched_patterns",
        )
    )


# ---- self declarations ----------------------------------------------------------------------


def _age_sql(text: str) -> str:
    low = Q.fold(f"lower(coalesce({text}, ''))")
    tries = []
    for p in L.AGE_PATTERNS:
        a = f"TRY_CAST(regexp_extract({low}, {Q.lit('(?i)' + p)}, 1) AS INTEGER)"
        tries.append(f"CASE WHEN {a} BETWEEN 13 AND 80 THEN {a} END")
    return f"coalesce({', '.join(tries)})"


def _gender_sql(text: str) -> str:
    low = Q.fold(f"lower(coalesce({text}, ''))")
    return "CASE " + " ".join(
        f"WHEN {Q.matches(low, '(?:' + '|'.join(ps) + ')')} THEN {Q.lit(g)}" for g, ps in L.GENDER_PATTERNS.items()
    ) + " END"


def _bucket_sql(age: str) -> str:
    return "CASE " + " ".join(f"WHEN {age} BETWEEN {lo} AND {hi} THEN '{b}'" for b, lo, hi in L.AGE_BUCKETS) + " ELSE 'unknown' END"


_DECL = f"""decl AS (
  SELECT id, author, created_utc, coalesce({_age_sql('author_flair_text')}, {_age_sql('body')}) AS age,
         coalesce({_gender_sql('author_flair_text')}, {_gender_sql('body')}) AS gender FROM raw)"""
_THREE = "CASE {b} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.BUCKET_TO_THREE.items()) + " END"


@query(
    f"""WITH {roles.RAW_SQL}, {_DECL}, b AS (SELECT *, CASE WHEN age IS NOT NULL THEN {_bucket_sql('age')} END AS bucket FROM decl)
    SELECT id, age, gender, bucket, {_THREE.format(b='bucket')} AS three,
           CASE WHEN bucket = '13-18' THEN 'teen' ELSE 'adult' END AS two FROM b"""
)
def self_declarations(spark, sf):
    from cohortlens.operators.demographics import declarations

    b = F.col("age_bucket_self_declared")
    return declarations(roles.raw(spark, sf)).select(
        "id",
        F.col("age_self_declared").alias("age"),
        F.col("gender_self_declared").alias("gender"),
        b.alias("bucket"),
        S.three_bucket(b).alias("three"),
        S.binary_bucket(b).alias("two"),
    )


@query(
    f"""WITH {roles.RAW_SQL}, {_DECL}
    SELECT author, arg_min(age, (created_utc, id)) FILTER (WHERE age IS NOT NULL) AS age_self_declared,
           arg_min({_bucket_sql('age')}, (created_utc, id)) FILTER (WHERE age IS NOT NULL) AS age_bucket_self_declared,
           arg_min(gender, (created_utc, id)) FILTER (WHERE gender IS NOT NULL) AS gender_self_declared
    FROM decl GROUP BY author"""
)
def user_self_declarations(spark, sf):
    from cohortlens.operators.demographics import user_declarations

    return user_declarations(roles.raw(spark, sf))


# ---- language and content -------------------------------------------------------------------


def _ling_sql() -> str:
    w = Q.count("body", r"\S+")
    letters = r"coalesce(list_sum(list_transform(regexp_extract_all(body, '\S+'), lambda x: length(x))), 0)"
    sent = f"greatest(1, len(list_filter(string_split_regex(body, '[.!?]+'), lambda x: length({Q.strip('x')}) > 0)))"
    cols = {
        "word_count": f"CAST({w} AS INTEGER)",
        "sentence_count": f"CAST({sent} AS INTEGER)",
        "words_per_sentence": Q.rnd(f"{w} / {sent}"),
        "avg_word_length": Q.rnd(f"CASE WHEN {w} > 0 THEN {letters} / {w} ELSE 0 END"),
        **{f"{k}_pct": Q.rnd(f"{Q.count('low', p)} / greatest(1, {w}) * 100") for k, p in L.PRONOUNS.items()},
        "questions": "CAST(length(body) - length(replace(body, '?', '')) AS INTEGER)",
        "exclamations": "CAST(length(body) - length(replace(body, '!', '')) AS INTEGER)",
        "emoticons": f"CAST({Q.count('body', L.EMOTICON)} AS INTEGER)",
        "all_caps": f"CAST({Q.count('f', L.ALL_CAPS)} AS INTEGER)",
    }
    return f"""WITH {roles.COMMENTS_SQL}, f AS (SELECT *, {Q.fold('body')} AS f, lower({Q.fold('body')}) AS low FROM comments)
    SELECT id, {', '.join(f'{e} AS {k}' for k, e in cols.items())} FROM f"""


@query(_ling_sql())
def linguistic_features(spark, sf):
    df = roles.comments(spark, sf)
    return rounded(df.select("id", *[c.alias(k) for k, c in T.linguistic_features().items()]))


def _keyword_sql(lists, prefix) -> str:
    return ", ".join(f"{Q.keywords('lower(body)', v)} AS {prefix}{k}" for k, v in lists.items())


@query(
    f"""WITH {roles.COMMENTS_SQL}, c AS (SELECT id, {_keyword_sql(L.LONELINESS, 'loneliness_')} FROM comments)
    SELECT *, CAST({' + '.join('loneliness_' + k for k in L.LONELINESS)} AS INTEGER) AS loneliness_total,
           CAST({' + '.join('loneliness_' + k for k in L.LONELINESS)} > 0 AS INTEGER) AS has_loneliness FROM c"""
)
def loneliness_lexicon(spark, sf):
    cols = T.keyword_features("body", L.LONELINESS, "loneliness_", "loneliness_total")
    df = roles.comments(spark, sf).select("id", *[c.alias(k) for k, c in cols.items()])
    return df.withColumn("has_loneliness", (F.col("loneliness_total") > 0).cast("int"))


@query(
    f"""WITH {roles.COMMENTS_SQL}, c AS (SELECT id, {_keyword_sql(L.CONTENT, 'content_')} FROM comments)
    SELECT *, {', '.join(f'CAST(content_{k} > 0 AS INTEGER) AS has_{k}' for k in L.CONTENT)} FROM c"""
)
def content_categories(spark, sf):
    cols = T.keyword_features("body", L.CONTENT, "content_")
    df = roles.comments(spark, sf).select("id", *[c.alias(k) for k, c in cols.items()])
    return df.select("*", *[(F.col(f"content_{k}") > 0).cast("int").alias(f"has_{k}") for k in L.CONTENT])


@query(
    f"""WITH {roles.COMMENTS_SQL}, f AS (SELECT *, {Q.fold('body')} AS f FROM comments)
    SELECT id, {', '.join(f'CAST({Q.matches("f", p)} AS INTEGER) AS has_{k}' for k, p in L.CONTENT_PATTERNS.items())},
           CAST({Q.count('f', chr(92) + 'b' + chr(92) + 'w+' + chr(92) + 'b')} AS INTEGER) AS word_count,
           CAST(length(f) AS INTEGER) AS char_count FROM f"""
)
def content_flags(spark, sf):
    cols = {**T.content_flags(), **T.vocabulary_signals()}
    return roles.comments(spark, sf).select("id", *[c.alias(k) for k, c in cols.items()])


_LOW = Q.fold("lower(body)")
_MARKERS = f"""m AS (SELECT author,
    sum({Q.hits('low', L.FEMALE_MARKERS)}) AS f, sum({Q.hits('low', L.MALE_MARKERS)}) AS m, sum({Q.count('body', r'\S+')}) AS w,
    sum(coalesce(list_sum(list_transform(regexp_extract_all(lower(body), '\\S+'), lambda x: length(x))), 0)) AS letters,
    sum({Q.count('body', '!')}) AS ex, sum({Q.count('body', chr(92) + '?')}) AS qu, sum({Q.count('lower(body)', L.MARKER_EMOTICON)}) AS em
  FROM (SELECT *, {_LOW} AS low FROM comments) GROUP BY author)"""


@query(
    f"""WITH {roles.COMMENTS_SQL}, {_MARKERS}
    SELECT author, {Q.rnd('f / greatest(w, 1) * 1000')} AS female_marker_rate, {Q.rnd('m / greatest(w, 1) * 1000')} AS male_marker_rate,
      {Q.rnd('(f + 1) / (m + 1)')} AS marker_ratio, {Q.rnd('CASE WHEN w > 0 THEN letters / w ELSE 5 END')} AS avg_word_length,
      {Q.rnd('ex / greatest(w, 1) * 100')} AS exclamation_rate, {Q.rnd('qu / greatest(w, 1) * 100')} AS question_rate,
      {Q.rnd('em / greatest(w, 1) * 100')} AS emoji_rate FROM m"""
)
def gendered_markers(spark, sf):
    from cohortlens.operators.rollup import marker_rates

    return rounded(marker_rates(roles.comments(spark, sf)))


# ---- dates, numbers, replies ----------------------------------------------------------------


@query(
    f"""WITH {roles.RAW_SQL}, t AS (SELECT id, make_timestamp(created_utc * 1000000) AS ts FROM raw)
    SELECT id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(year(ts) AS INTEGER) AS year,
           isodow(ts) >= 6 AS is_weekend FROM t"""
)
def date_parts(spark, sf):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = roles.raw(spark, sf)
    return df.select("id", *[c.alias(k) for k, c in S.date_parts(S.from_epoch(F.col("created_utc"))).items()])


@query(
    f"""WITH {roles.USERS_SQL}
    SELECT author, {Q.rnd('ln(1 + score_count)')} AS log_count,
      {Q.rnd('ln((emotion_joy + 1e-6) / (emotion_neutral + 1e-6))')} AS alr_joy,
      {Q.rnd('atanh(least(0.999999, greatest(-0.999999, balance / 10000)))')} AS z,
      {Q.rnd('exp(score_std)')} AS e, {Q.rnd('greatest(1, least(5, score_mean))', 12)} AS clipped,
      {Q.rnd('ln((age_conf + 1e-10) / (gender_conf + 1e-10))')} AS log_odds FROM users"""
)
def scalar_math(spark, sf):
    return rounded(
        roles.users(spark, sf).select(
            "author",
            F.log1p("score_count").alias("log_count"),
            S.log_ratio(F.col("emotion_joy"), F.col("emotion_neutral")).alias("alr_joy"),
            S.fisher_z(F.col("balance") / 10000).alias("z"),
            F.exp("score_std").alias("e"),
            S.clipped(F.col("score_mean"), 1.0, 5.0).alias("clipped"),
            S.log_odds(F.col("age_conf"), F.col("gender_conf")).alias("log_odds"),
        ),
        clipped=12,
    )


@query(
    """WITH replies AS (
      SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'not json' WHEN 1 THEN replace(props, '"k"', '"score"')
             WHEN 2 THEN '{"score": ' || CAST(event_id % 5 AS VARCHAR) || ', "r": "' || event_type || '"}'
             WHEN 3 THEN '{"score": "4", "reasoning": "' || event_type || '"}' ELSE '{"r": "none"}' END AS reply FROM events),
    p AS (SELECT id, CASE WHEN json_valid(reply) THEN TRY_CAST(json_extract(reply, '$.score') AS VARCHAR) END AS s,
                 CASE WHEN json_valid(reply) THEN coalesce(json_extract_string(reply, '$.r'), json_extract_string(reply, '$.reasoning')) END AS r
          FROM replies)
    SELECT id, CASE WHEN s IS NULL OR TRY_CAST(s AS DOUBLE) IS NULL THEN 0
                    ELSE CAST(greatest(1, least(5, trunc(CAST(s AS DOUBLE)))) AS INTEGER) END AS score,
           coalesce(r, '') AS reasoning FROM p"""
)
def model_replies(spark, sf):
    """Stored JSON replies: clamped numbers, quoted or missing scores, broken JSON."""
    i = F.col("event_id")
    reply = (
        F.when(i % 5 == 0, "not json")
        .when(i % 5 == 1, F.replace("props", F.lit('"k"'), F.lit('"score"')))
        .when(i % 5 == 2, F.concat(F.lit('{"score": '), (i % 5).cast("string"), F.lit(', "r": "'), "event_type", F.lit('"}')))
        .when(i % 5 == 3, F.concat(F.lit('{"score": "4", "reasoning": "'), "event_type", F.lit('"}')))
        .otherwise('{"r": "none"}')
    )
    df = roles.table(spark, sf, "events").select(i.alias("id"), T.parse_reply(reply).alias("p"))
    return df.select("id", "p.*")


@query(
    f"""WITH p AS (SELECT l_orderkey AS id, l_discount * 5 AS p_h, l_tax * 5 AS p_n FROM lineitem),
    s AS (SELECT id, ln((p_h + 1e-10) / (p_n + 1e-10)) AS s FROM p)
    SELECT id, {Q.rnd('avg(s)', 5)} AS mean, {Q.rnd('median(s)', 5)} AS median, {Q.rnd('stddev_pop(s)', 5)} AS std, count(*) AS n FROM s GROUP BY id"""
)
def pronoun_log_odds(spark, sf):
    """Per text summary of sentence log odds from given token probabilities."""
    df = roles.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        S.log_odds(F.col("l_discount") * 5, F.col("l_tax") * 5).alias("s"),
    )
    return rounded(
        df.groupBy("id").agg(
            F.avg("s").alias("mean"), F.median("s").alias("median"), F.stddev_pop("s").alias("std"), F.count("s").alias("n")
        ),
        5,
    )


@query(
    f"""WITH {roles.USERS_SQL}
    SELECT author, CAST(segment = 'BUILDING' AS DOUBLE) AS age_BUILDING, CAST(segment = 'FURNITURE' AS DOUBLE) AS age_FURNITURE,
      CAST(segment = 'HOUSEHOLD' AS DOUBLE) AS age_HOUSEHOLD, CAST(segment = 'MACHINERY' AS DOUBLE) AS age_MACHINERY,
      CAST(gender_predicted = 'female' AS DOUBLE) AS gender_female,
      CAST(segment = 'BUILDING' AND gender_predicted = 'female' AS DOUBLE) AS age_BUILDING_x_gender_female,
      CAST(segment = 'FURNITURE' AND gender_predicted = 'female' AS DOUBLE) AS age_FURNITURE_x_gender_female,
      CAST(segment = 'HOUSEHOLD' AND gender_predicted = 'female' AS DOUBLE) AS age_HOUSEHOLD_x_gender_female,
      CAST(segment = 'MACHINERY' AND gender_predicted = 'female' AS DOUBLE) AS age_MACHINERY_x_gender_female FROM users"""
)
def dummy_coding(spark, sf):
    df = roles.users(spark, sf)
    age = S.dummies("segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "AUTOMOBILE", "age_")
    gender = S.dummies("gender_predicted", ["male", "female"], "male", "gender_")
    df = df.select("author", *[c.alias(k) for k, c in {**age, **gender}.items()])
    return df.select("*", *[c.alias(k) for k, c in S.interactions(list(age), list(gender)).items()])
