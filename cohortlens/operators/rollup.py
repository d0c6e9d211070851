"""Comment rows to user, community and group level."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.functions import lexicons as L, text as T
from cohortlens.operators import ranks
from cohortlens.operators.clean import valid_scores

Z95 = 1.959963984540054


# ---- users ----------------------------------------------------------------------------------


def user_scores(df: DataFrame, author: str = "author", score: str = "score", community: str = "subreddit") -> DataFrame:
    """Per user mean, max, min, sd (0 for one comment), count, median, communities; errors left out.

    Scores take five values, so the median's buffer is a five-entry map.
    """
    s = F.col(score)
    return valid_scores(df, score).groupBy(author).agg(
        F.avg(s).alias("score_mean"),
        F.max(s).alias("score_max"),
        F.min(s).alias("score_min"),
        F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("score_std"),
        F.count(s).alias("score_count"),
        F.median(s).alias("score_median"),
        F.array_sort(F.collect_set(community)).alias("communities"),
    )


def score_shares(df: DataFrame, author: str = "author", score: str = "score") -> DataFrame:
    """Counts and shares of score levels per user."""
    s = F.col(score)
    out = valid_scores(df, score).groupBy(author).agg(
        F.count(s).alias("score_count"),
        F.count_if(s == 1).alias("score_1_count"),
        F.count_if(s == 2).alias("score_2_count"),
        F.count_if(s >= 3).alias("score_3plus_count"),
        F.count_if(s >= 4).alias("score_4plus_count"),
        F.bool_or(s >= 4).alias("any_4plus"),
    )
    n = F.col("score_count")
    return out.select(
        "*",
        (F.col("score_2_count") / n).alias("pct_score_2"),
        (F.col("score_3plus_count") / n).alias("pct_score_3plus"),
        (F.col("score_4plus_count") / n).alias("pct_score_4plus"),
        (F.col("score_3plus_count") > 0).cast("int").alias("has_score_3plus"),
        (F.col("score_4plus_count") > 0).cast("int").alias("has_score_4plus"),
    )


def aggregation_table(users: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One row per alternative aggregate: mean, sd, range, floor share and its grade."""
    long = users.unpivot([], [F.col(c).cast("double").alias(k) for k, c in columns.items()], "method", "v")
    out = long.groupBy("method").agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.avg((F.col("v") == 0).cast("double")).alias("pct_zero"),
        F.avg((F.col("v") > 0).cast("double")).alias("pct_positive"),
    )
    z = F.col("pct_zero")
    grade = F.when(z > 0.7, "SEVERE").when(z > 0.5, "MODERATE").when(z > 0.3, "MILD").otherwise("MINIMAL")
    return out.withColumn("severity", grade)


def user_emotions(df: DataFrame, author: str = "author", prefix: str = "emotion_", bot: str | None = "bot_emotion_",
                  weight: str | None = "bot_attribution_score") -> DataFrame:
    """Mean emotions per user and the largest; means that are equal to 12 digits tie, whatever the order of their sums."""
    cols = [f"{p}{e}" for p in (prefix, bot) if p for e in L.EMOTIONS] + ([weight] if weight else [])
    out = df.groupBy(author).agg(*[F.round(F.avg(c), 12).alias(c) for c in cols])
    out = out.withColumns({"dominant_emotion": T.dominant(prefix), "dominant_emotion_score": T.dominant_score(prefix)})
    return out.withColumn("bot_dominant_emotion", T.dominant(bot, "")) if bot else out


def behaviour(df: DataFrame, author: str = "author", ts: str = "ts", length: Column | None = None,
              community: str = "subreddit") -> DataFrame:
    """Posting habits of a user: night, school hours, weekend, span in whole days, diversity."""
    t = F.col(ts)
    share = lambda c: F.avg(c.cast("double"))
    seconds = F.unix_micros(t.cast("timestamp"))
    return df.groupBy(author).agg(
        share(F.hour(t) <= 4).alias("late_night_ratio"),
        share(F.hour(t).between(9, 14)).alias("school_hours_ratio"),
        share(F.weekday(t) >= 5).alias("weekend_ratio"),
        F.floor((F.max(seconds) - F.min(seconds)) / 86400000000).alias("activity_span_days"),
        F.avg(length if length is not None else F.length("body")).alias("avg_comment_length"),
        F.count(F.lit(1)).alias("comment_count"),
        (F.count_distinct(community) / F.count(F.lit(1))).alias("subreddit_diversity"),
    )


def activity(df: DataFrame, author: str = "author", ts: str | None = "ts", length: Column | None = None) -> DataFrame:
    """Count, length and hour moments; 12 / 6 / 0.29 stand in where no time is known."""
    n = length if length is not None else F.length("body")
    aggs = [
        F.count(F.lit(1)).alias("comment_count"),
        F.avg(n).alias("avg_comment_length"),
        F.stddev_samp(n).alias("std_comment_length"),
    ]
    if ts is None:
        out = df.groupBy(author).agg(*aggs)
        return out.select("*", F.lit(12.0).alias("hour_mean"), F.lit(6.0).alias("hour_std"), F.lit(0.29).alias("weekend_ratio"))
    t = F.col(ts)
    weekend = F.coalesce(F.weekday(t) >= 5, F.lit(False)).cast("double")
    out = df.groupBy(author).agg(
        *aggs,
        F.count(t).alias("_timed"),
        F.avg(F.hour(t)).alias("_hm"),
        F.stddev_samp(F.hour(t)).alias("_hs"),
        F.avg(weekend).alias("_we"),
    )
    none = F.col("_timed") == 0
    return out.select(
        author,
        "comment_count",
        "avg_comment_length",
        "std_comment_length",
        F.when(none, 12.0).otherwise(F.col("_hm")).alias("hour_mean"),
        F.when(none, 6.0).otherwise(F.col("_hs")).alias("hour_std"),
        F.when(none, 0.29).otherwise(F.col("_we")).alias("weekend_ratio"),
    )


def marker_rates(df: DataFrame, author: str = "author", text: str = "body") -> DataFrame:
    """Gendered markers per 1000 words and punctuation per 100 words of all of a user's text."""
    counts = T.marker_counts(text)
    s = df.select(author, *[c.alias(k) for k, c in counts.items()]).groupBy(author).agg(
        *[F.sum(k).alias(k) for k in counts]
    )
    w = F.greatest(F.col("words"), F.lit(1))
    return s.select(
        author,
        (F.col("female_count") / w * 1000).alias("female_marker_rate"),
        (F.col("male_count") / w * 1000).alias("male_marker_rate"),
        ((F.col("female_count") + 1) / (F.col("male_count") + 1)).alias("marker_ratio"),
        F.coalesce(F.try_divide("letters", "words"), F.lit(5.0)).alias("avg_word_length"),
        (F.col("exclaims") / w * 100).alias("exclamation_rate"),
        (F.col("asks") / w * 100).alias("question_rate"),
        (F.col("emoticons") / w * 100).alias("emoji_rate"),
    )


def first_n(df: DataFrame, n: int, by: Sequence[str], order: Sequence) -> DataFrame:
    """Head of every group.

    ``row_number() <= n`` is planned with a group limit before the shuffle, so a hot group sends
    at most n rows per map task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def user_documents(df: DataFrame, n: int | None = None, author: str = "author", text: str = "body",
                   order: Sequence[str] = ("created_utc", "id"), cut: int | None = None, sep: str = " ") -> DataFrame:
    """A user's comments in order as one text; only the first ``n`` or so many characters of each where asked for."""
    body = F.col(text) if cut is None else F.substring(text, 1, cut)
    head = df if n is None else first_n(df, n, [author], list(order))
    head = head.select(author, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], body.alias("_b"))
    parts = F.array_sort(F.collect_list(F.struct(*[f"_o{k}" for k in range(len(order))], "_b")))
    return head.groupBy(author).agg(
        F.array_join(F.transform(parts, lambda s: s["_b"]), sep).alias("document"), F.count(F.lit(1)).alias("n_comments")
    )


# ---- communities ----------------------------------------------------------------------------


def participation(df: DataFrame, author: str = "author", community: str = "subreddit", min_count: int = 3,
                  lower: bool = True) -> DataFrame:
    """Communities a user took part in at least ``min_count`` times."""
    c = F.lower(community) if lower else F.col(community)
    pairs = df.groupBy(author, c.alias(community)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return pairs.groupBy(author).agg(
        F.array_sort(F.collect_list(community)).alias("communities"), F.count(F.lit(1)).alias("n_communities")
    )


def primary_community(df: DataFrame, author: str = "author", community: str = "subreddit") -> DataFrame:
    """Most used community per user (ties: first by name) and its share."""
    pairs = df.groupBy(author, community).agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy(author).agg(
        F.min_by(F.struct(community, "n"), F.struct(-F.col("n"), F.col(community))).alias("_p"),
        F.sum("n").alias("total_comments"),
    )
    return out.select(
        author,
        F.col(f"_p.{community}").alias("primary_community"),
        F.col("_p.n").alias("primary_comments"),
        "total_comments",
        (F.col("_p.n") / F.col("total_comments")).alias("primary_share"),
    )


def community_vocabulary(df: DataFrame, k: int = 500, min_users: int = 10, author: str = "author",
                         community: str = "subreddit") -> DataFrame:
    """The k communities with most users (at least ``min_users``), with their position."""
    users = df.select(author, community).distinct().groupBy(community).agg(F.count(F.lit(1)).alias("n_users"))
    top = users.where(F.col("n_users") >= min_users).orderBy(F.desc("n_users"), community).limit(k)
    w = Window.orderBy(F.desc("n_users"), community)  # k rows
    return top.withColumn("position", F.row_number().over(w) - 1)


def community_membership(df: DataFrame, vocabulary: DataFrame, author: str = "author", community: str = "subreddit") -> DataFrame:
    """Binary user × community matrix in long form; the vocabulary is bounded by its k."""
    pairs = df.select(author, community).distinct()
    return pairs.join(F.broadcast(vocabulary.select(community, "position")), community)


def community_profile(df: DataFrame, value: str, community: str = "subreddit", flags: Mapping[str, Column] | None = None,
                      min_size: int = 50, high: float = 3) -> DataFrame:
    """Size, moments, median, shares per community, largest first."""
    v = F.col(value)
    stats = df.groupBy(community).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        (F.avg((v >= high).cast("double")) * 100).alias("high_pct"),
        *[(F.avg(c.cast("double")) * 100).alias(k) for k, c in (flags or {}).items()],
    )
    med = ranks.medians(df, value, [community])
    total = Window.partitionBy(F.lit(0))  # one row per community
    return (
        stats.join(med, community)
        .withColumn("share", F.col("n") / F.sum("n").over(total))
        .where(F.col("n") >= min_size)
        .orderBy(F.desc("n"), community)
    )


# ---- distributions --------------------------------------------------------------------------


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    k, n = k.cast("double"), n.cast("double")  # n squared leaves 64 bits
    p = F.try_divide(k, n)
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return centre - half, centre + half


def level_distribution(df: DataFrame, value: str, levels: Sequence, by: Sequence[str] = ()) -> DataFrame:
    """Count, share and Wilson interval for every level, absent levels included."""
    total = F.count(value).alias("total")
    wide = df.groupBy(*by).agg(total, *[F.count_if(F.col(value) == x).alias(str(x)) for x in levels])
    kind = "int" if all(isinstance(x, int) for x in levels) else "string"
    long = wide.unpivot([*by, "total"], [str(x) for x in levels], "level", "n").withColumn("level", F.col("level").cast(kind))
    lo, hi = wilson(F.col("n"), F.col("total"))
    return long.select("*", F.try_divide("n", "total").alias("share"), lo.alias("ci_low"), hi.alias("ci_high"))


PERCENTILES = {"p5": 0.05, "p10": 0.10, "p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def describe(df: DataFrame, value: str, by: Sequence[str] = (), flags: Mapping[str, Column] | None = None) -> DataFrame:
    """Moments, bias-corrected and population skewness and kurtosis, exact percentiles, flag shares."""
    v = F.col(value)
    n = F.count(v).cast("double")
    g1, g2 = F.skewness(v), F.kurtosis(v)
    stats = df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        g1.alias("skew_pop"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        *[F.avg(c.cast("double")).alias(k) for k, c in (flags or {}).items()],
    )
    q = ranks.quantiles(df, value, PERCENTILES, by)
    return stats.join(q, list(by)) if by else stats.join(F.broadcast(q))  # one row each


def cell_table(df: DataFrame, value: str, dims: Sequence[str]) -> DataFrame:
    """Cells, margins and total of the group statistics in one scan."""
    v = F.col(value)
    out = df.cube(*dims).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.var_samp(v).alias("variance"),
        F.grouping_id(*dims).alias("level"),
    )
    return out.withColumn("cv", F.try_divide("sd", "mean"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table with row and total shares."""
    counts = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, whole = Window.partitionBy(a), Window.partitionBy(F.lit(0))  # levels × levels rows
    return counts.select(
        "*", (F.col("n") / F.sum("n").over(rows)).alias("row_share"), (F.col("n") / F.sum("n").over(whole)).alias("share")
    )


def demographics_table(df: DataFrame, dims: Sequence[str], value: str) -> DataFrame:
    """Distribution and score statistics by level of every dimension, from one scan."""
    v = F.col(value)
    filled = df.select(value, *[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dims])
    long = filled.unpivot([value], list(dims), "dimension", "level")
    out = long.groupBy("dimension", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    w = Window.partitionBy("dimension")  # one row per level
    return out.withColumn("share", F.col("n") / F.sum("n").over(w))


def topic_mix(df: DataFrame, topic: str, topics: Sequence, author: str = "author") -> DataFrame:
    """Topic shares per user, wide, with the dominant topic (ties: first listed)."""
    wide = df.groupBy(author).agg(
        F.count(topic).alias("_n"), *[F.count_if(F.col(topic) == t).alias(f"topic_{t}") for t in topics]
    )
    out = wide.select(author, *[F.try_divide(f"topic_{t}", "_n").alias(f"topic_{t}") for t in topics])
    cols = [F.col(f"topic_{t}") for t in topics]
    top = F.greatest(*cols)
    label = F
    for t, c in zip(topics, cols):
        label = label.when(c == top, F.lit(str(t)))
    return out.select("*", label.alias("dominant_topic"), top.alias("dominant_share"))


def threshold_coverage(df: DataFrame, thresholds: Sequence[float], confidences: Mapping[str, str]) -> DataFrame:
    """Users passing each confidence, and all of them, at every threshold; one scan."""
    def passing(t: float) -> Column:
        tests = {k: F.col(c) >= t for k, c in confidences.items()}
        both = F.lit(True)
        for x in tests.values():
            both = both & x
        return F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count(F.lit(1)).alias("n_total"),
            *[F.count_if(x).alias(f"n_{k}") for k, x in tests.items()],
            F.count_if(both).alias("n_both"),
        )

    rows = df.agg(F.array(*[passing(t) for t in thresholds]).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    names = [*confidences, "both"]
    return rows.select("*", *[F.try_divide(f"n_{k}", "n_total").alias(f"pct_{k}") for k in names])


def inventory(df: DataFrame, community: str = "subreddit", author: str = "author", raw: DataFrame | None = None,
              exact: bool = True) -> DataFrame:
    """Comments and users per community, and how much of a raw corpus was kept."""
    users = F.count_distinct(author) if exact else F.approx_count_distinct(author)
    out = df.groupBy(community).agg(F.count(F.lit(1)).alias("comments"), users.alias("users"))
    if raw is None:
        return out
    before = raw.groupBy(community).agg(F.count(F.lit(1)).alias("raw_comments"))
    return before.join(out, community, "left").na.fill(0, ["comments", "users"]).withColumn(
        "retained", F.try_divide("comments", "raw_comments")
    )


def top_authors(df: DataFrame, k: int = 10, author: str = "author") -> DataFrame:
    return df.groupBy(author).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), author).limit(k)


def seed_coverage(df: DataFrame, pairs: Sequence[tuple[str, str]], min_users: int = 1, author: str = "author",
                  community: str = "subreddit") -> DataFrame:
    """Distinct users per seed community; a pair is valid when both sides have enough."""
    spark = df.sparkSession
    seeds = spark.createDataFrame(
        [(i, side, c.lower()) for i, p in enumerate(pairs) for side, c in zip(("first", "second"), p)],
        "pair int, side string, community string",
    )
    wanted = sorted({c.lower() for p in pairs for c in p})
    found = df.where(F.lower(community).isin(wanted)).groupBy(F.lower(community).alias("community")).agg(
        F.count_distinct(author).alias("users")
    )
    return (
        seeds.join(found, "community", "left")
        .groupBy("pair")
        .agg(
            *[F.max(F.when(F.col("side") == s, F.col("community"))).alias(s) for s in ("first", "second")],
            *[
                F.max(F.when(F.col("side") == s, F.coalesce("users", F.lit(0)))).alias(f"{s}_users")
                for s in ("first", "second")
            ],
        )
        .withColumn("valid", (F.col("first_users") >= min_users) & (F.col("second_users") >= min_users))
    )


def enrichment_summary(df: DataFrame) -> DataFrame:
    """Attribution types and n-gram hits over a corpus with both feature sets, one row."""
    kind = F.col("attribution_type")
    grams = [*L.HUMANISING_NGRAMS, *L.TOOL_NGRAMS]
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(kind == k).alias(f"n_{k}") for k in ("bot", "self", "mixed", "none")],
        *[F.avg((kind == k).cast("double")).alias(f"share_{k}") for k in ("bot", "self", "mixed", "none")],
        *[F.sum(f"ngram_{g}").cast("long").alias(f"hits_{g}") for g in grams],
        *[F.count_if(F.col(f"ngram_{g}") > 0).alias(f"comments_{g}") for g in grams],
        F.avg("ngram_net_signal").alias("mean_net_signal"),
    )


def equal_width_histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts and density per bin; the bins span the whole data's range, the top edge is closed."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    x = df.where(F.col(value).isNotNull()).join(F.broadcast(span))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = x.select(*by, F.coalesce(b, F.lit(0)).alias("bin"), "_lo", width.alias("_w")).groupBy(*by, "bin", "_lo", "_w").agg(
        F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy(*(by or [F.lit(0)]))  # at most ``bins`` rows per group
    return counts.select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"),
        "n",
        (F.col("n") / F.sum("n").over(w) / F.col("_w")).alias("density"),
    )
