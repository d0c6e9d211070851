"""The given tables seen as the library's entities, once for Spark and once as SQL for the check.

``raw``       conversations as raw comments (bots, accounts, flairs, times follow from ids)
``comments``  documents as comments
``scored``    events as scored comments of users in communities (score 0 = scoring error)
``users``     customers with their orders as one row per user (scores, confidences, emotion shares)
``ratings``   line items as ratings of items by three raters
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.functions.lexicons import EMOTIONS
from cohortlens.sources.comments import spread

EPOCH = 1704067200  # 2024-01-01 UTC, first second of the event table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- raw comments ---------------------------------------------------------------------------

RAW_SQL = f"""raw AS (
  SELECT 'c' || CAST(conv_id * 100 + turn AS VARCHAR) AS id,
         CASE role WHEN 'system' THEN 'AutoModerator'
                   WHEN 'assistant' THEN ' HelperBot' || CAST(conv_id % 3 AS VARCHAR)
                   ELSE 'user' || CAST(conv_id % 40 AS VARCHAR) END AS author,
         text AS body,
         {EPOCH} + conv_id * 25200 + turn * 600 AS created_utc,
         'Community' || CAST(conv_id % 5 AS VARCHAR) AS subreddit,
         CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id % 90 AS VARCHAR) || CASE WHEN conv_id % 2 = 0 THEN 'M' ELSE 'F' END
              WHEN conv_id % 3 = 1 THEN '' END AS author_flair_text,
         'part' || CAST(conv_id % 4 AS VARCHAR) AS _file, conv_id * 100 + turn AS _pos
  FROM conversations)"""


def _splits(spark: SparkSession) -> int | None:
    """Partitions for text work, if the session asks for them (one-file test tables): ``spark.cohortlens.textPartitions``."""
    asked = spark.conf.get("spark.cohortlens.textPartitions", None)
    return int(asked) if asked else None


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return spread(table(spark, sf_dir, "conversations"), "conv_id", _splits(spark)).select(
        F.concat(F.lit("c"), (c * 100 + F.col("turn")).cast("string")).alias("id"),
        F.when(F.col("role") == "system", "AutoModerator")
        .when(F.col("role") == "assistant", F.concat(F.lit(" HelperBot"), (c % 3).cast("string")))
        .otherwise(F.concat(F.lit("user"), (c % 40).cast("string")))
        .alias("author"),
        F.col("text").alias("body"),
        (F.lit(EPOCH) + c * 25200 + F.col("turn") * 600).cast("long").alias("created_utc"),
        F.concat(F.lit("Community"), (c % 5).cast("string")).alias("subreddit"),
        F.when(c % 3 == 0, F.concat((c % 90).cast("string"), F.when(c % 2 == 0, "M").otherwise("F")))
        .when(c % 3 == 1, "")
        .alias("author_flair_text"),
        F.concat(F.lit("part"), (c % 4).cast("string")).alias("_file"),
        (c * 100 + F.col("turn")).alias("_pos"),
    )


# ---- comments -------------------------------------------------------------------------------

COMMENTS_SQL = """comments AS (
  SELECT doc_id AS id, text AS body, source AS subreddit, lang, source || '_' || lang AS author FROM documents)"""


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id", _splits(spark)).select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("body"),
        F.col("source").alias("subreddit"),
        "lang",
        F.concat_ws("_", "source", "lang").alias("author"),
    )


# ---- scored comments ------------------------------------------------------------------------

SCORED_SQL = """scored AS (
  SELECT event_id AS id, user_id AS author, event_type AS subreddit, ts, value,
         CASE WHEN value >= 150 THEN 0 ELSE CAST(1 + floor(least(value, 149.99) / 30) AS INTEGER) END AS score,
         CASE WHEN value >= 150 THEN 'error' WHEN value < 10 THEN 'prefilter' ELSE 'model' END AS source,
         value * 1.5 AS processing_time_ms
  FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("author"),
        F.col("event_type").alias("subreddit"),
        "ts",
        "value",
        F.when(v >= 150, 0).otherwise((1 + F.floor(F.least(v, F.lit(149.99)) / 30)).cast("int")).alias("score"),
        F.when(v >= 150, "error").when(v < 10, "prefilter").otherwise("model").alias("source"),
        (v * 1.5).alias("processing_time_ms"),
    )


# ---- users ----------------------------------------------------------------------------------

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
USER_EMOTIONS = ["emotion_joy", "emotion_sadness", "emotion_anger", "emotion_fear", "emotion_neutral"]

USERS_SQL = """users AS (
  SELECT c_custkey AS author,
         CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'teen' ELSE 'adult' END AS age_predicted,
         CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender_predicted,
         c_mktsegment AS segment,
         r_name AS community,
         0.5 + abs(c_acctbal) / 20000 AS age_conf,
         0.5 + (c_custkey % 50) / 100.0::DOUBLE AS gender_conf,
         score_mean, score_max, score_std, score_count, n_high, """ + ", ".join(USER_EMOTIONS) + """,
         c_acctbal AS balance
  FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT o_custkey, avg(o_totalprice) / 100000 AS score_mean, max(o_totalprice) / 100000 AS score_max,
               coalesce(stddev_samp(o_totalprice / 100000), 0) AS score_std, count(*) AS score_count,
               count(*) FILTER (WHERE o_totalprice >= 450000) AS n_high,
               """ + ",\n               ".join(
    f"avg(CASE WHEN o_orderpriority = '{p}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {e}"
    for p, e in zip(_PRIORITIES, USER_EMOTIONS)
) + """
        FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    rolled = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        (F.avg(price) / 100000).alias("score_mean"),
        (F.max(price) / 100000).alias("score_max"),
        F.coalesce(F.stddev_samp(price / 100000), F.lit(0.0)).alias("score_std"),
        F.count(F.lit(1)).alias("score_count"),
        F.count_if(price >= 450000).alias("n_high"),
        *[
            F.avg((F.col("o_orderpriority") == p).cast("double")).alias(e)
            for p, e in zip(_PRIORITIES, USER_EMOTIONS)
        ],
    )
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(rolled, F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("c_custkey").alias("author"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "teen").otherwise("adult").alias("age_predicted"),
            F.when(F.col("c_nationkey") % 2 == 0, "female").otherwise("male").alias("gender_predicted"),
            F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("community"),
            (0.5 + F.abs("c_acctbal") / 20000).alias("age_conf"),
            (0.5 + (F.col("c_custkey") % 50) / 100.0).alias("gender_conf"),
            "score_mean",
            "score_max",
            "score_std",
            "score_count",
            "n_high",
            *USER_EMOTIONS,
            F.col("c_acctbal").alias("balance"),
        )
    )


# ---- ratings --------------------------------------------------------------------------------

RATERS = ["alpha", "beta", "gamma"]
RATINGS_SQL = """ratings AS (
  SELECT l_orderkey AS item,
         CASE l_linenumber % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS rater,
         CAST(min(1 + CAST(l_quantity AS INTEGER) % 5) AS INTEGER) AS score
  FROM lineitem GROUP BY ALL),
algorithm AS (SELECT o_orderkey AS item, CAST(1 + floor(least(o_totalprice, 499999) / 100000) AS INTEGER) AS score FROM orders)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber") % 3
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").alias("item"),
            F.when(line == 0, "alpha").when(line == 1, "beta").otherwise("gamma").alias("rater"),
            (1 + F.col("l_quantity").cast("int") % 5).alias("score"),
        )
        .groupBy("item", "rater")
        .agg(F.min("score").alias("score"))
    )


def algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item"),
        (1 + F.floor(F.least(F.col("o_totalprice"), F.lit(499999)) / 100000)).cast("int").alias("score"),
    )


def emotion_columns(prefix: str = "emotion_") -> list[str]:
    return [f"{prefix}{e}" for e in EMOTIONS]
