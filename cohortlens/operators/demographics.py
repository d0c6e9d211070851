"""Age and gender of users: declarations, community projection, vote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions import lexicons as L, scalar as S
from cohortlens.operators import ranks


def declarations(df: DataFrame, text: str = "body", flair: str = "author_flair_text", strict: bool = False) -> DataFrame:
    """Age and gender per comment; the flair wins over the body."""
    sources = [c for c in (flair, text) if c in df.columns]
    df = df.withColumns({f"_t_{c}": S.declaration_text(F.col(c)) for c in sources})
    df = df.withColumns(
        {
            "age_self_declared": F.coalesce(*[S.declared_age(F.col(f"_t_{c}"), strict) for c in sources]),
            "gender_self_declared": F.coalesce(*[S.declared_gender(F.col(f"_t_{c}"), strict) for c in sources]),
        }
    ).drop(*[f"_t_{c}" for c in sources])
    bucket = F.when(F.col("age_self_declared").isNotNull(), S.age_bucket(F.col("age_self_declared")))
    return df.withColumn("age_bucket_self_declared", bucket)


def _first(c: str, order: Column) -> Column:
    """Earliest non-null value; rows without one take no part (null order is ignored)."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)


def user_declarations(
    df: DataFrame, author: str = "author", order: tuple[str, ...] = ("created_utc", "id"), **kw
) -> DataFrame:
    key = F.struct(*order)
    return declarations(df, **kw).groupBy(author).agg(
        *[_first(c, key) for c in ("age_self_declared", "age_bucket_self_declared", "gender_self_declared")]
    )


# ---- community dimension --------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def dimension(vectors: DataFrame, pairs: Sequence[tuple], community: str = "community", vector: str = "vector") -> DataFrame:
    """Unit mean of (second − first) over the seed pairs whose both ends have a vector: one row."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[community]
    seeds = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"pair int, a {kind}, b {kind}")
    ends = [x for p in pairs for x in p]
    v = vectors.where(F.col(community).isin(ends)).select(F.col(community).alias("_c"), F.col(vector).alias("_v"))
    j = (
        seeds.join(v.withColumnsRenamed({"_c": "a", "_v": "va"}), "a")
        .join(v.withColumnsRenamed({"_c": "b", "_v": "vb"}), "b")
        .select("pair", F.posexplode(F.zip_with("va", "vb", lambda x, y: y.cast("double") - x)).alias("i", "d"))
    )
    mean = j.groupBy("i").agg(F.avg("d").alias("d"), F.count(F.lit(1)).alias("n"))
    packed = mean.agg(  # one entry per vector component
        F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda s: s["d"]).alias("dimension"),
        F.max("n").alias("valid_pairs"),
    )
    size = norm(F.col("dimension"))
    unit = F.when(size > 0, F.transform("dimension", lambda x: x / size)).otherwise(F.col("dimension"))
    return packed.select(unit.alias("dimension"), F.coalesce("valid_pairs", F.lit(0)).alias("valid_pairs"))


def project_users(membership: DataFrame, vectors: DataFrame, axis: DataFrame, author: str = "author",
                  community: str = "community", vector: str = "vector", out: str = "score") -> DataFrame:
    """Mean projection of a user's known communities, 0 without any.

    The projection is linear, so each community is projected once and users average numbers, not vectors.
    """
    scores = vectors.join(F.broadcast(axis)).select(  # one row
        F.col(community), dot(F.col(vector), F.col("dimension")).alias("_s")
    )
    j = membership.select(author, community).distinct().join(scores, community, "left")
    return j.groupBy(author).agg(F.coalesce(F.avg("_s"), F.lit(0.0)).alias(out))


_LABELS = [b for b, _, _ in L.AGE_BUCKETS]


def age_from_score(df: DataFrame, score: str = "score", out: str = "age_bucket_community", rule: str = "quantile") -> DataFrame:
    """Quintile buckets (rule ``quantile``) or fixed cut-offs (rule ``fixed``), whatever the number of users."""
    if rule == "fixed":
        return df.withColumn(out, S.cut(F.col(score), L.AGE_CUTS_FALLBACK, _LABELS))
    q = ranks.quantiles(df, score, {f"_q{i}": i / 5 for i in range(1, 5)})
    by_rank = S.cut(F.col(score), [F.col(f"_q{i}") for i in range(1, 5)], _LABELS)
    return df.join(F.broadcast(q)).withColumn(out, by_rank).drop(*[f"_q{i}" for i in range(1, 5)])  # one row


def gender_from_score(df: DataFrame, score: str = "score", out: str = "gender_community", percentile: float = 0.70,
                      rule: str = "quantile") -> DataFrame:
    """Strong scores only, the sign picks the pole: those whose size reaches the percentile (rule ``quantile``) or 0.1 (``fixed``)."""
    s = F.col(score)
    if rule == "fixed":
        return df.withColumn(out, F.when(s < -0.1, "female").when(s > 0.1, "male").otherwise("unknown"))
    d = df.withColumn("_abs", F.abs(score))
    q = ranks.quantiles(d, "_abs", {"_t": percentile})
    strong = F.when(F.col("_abs") < F.col("_t"), "unknown").when(s < 0, "female").otherwise("male")
    return d.join(F.broadcast(q)).withColumn(out, strong).drop("_abs", "_t")  # one row


def age_calibrated(score: Column) -> Column:
    return S.cut(score, L.AGE_CUTS_CALIBRATED, _LABELS)


def gender_calibrated(score: Column, centre: float = L.GENDER_CENTRE, dead_zone: float = 0.05) -> Column:
    c = score - centre
    return F.when(F.abs(c) < dead_zone, "unknown").when(c > 0, "male").otherwise("female")


# ---- vote -----------------------------------------------------------------------------------


def vote(df: DataFrame) -> DataFrame:
    """Weighted vote of declaration, community and model; the first cast of equal votes wins.

    Expects age_bucket_self_declared, age_bucket_community, age_community_score, age_bucket_llm,
    confidence_llm and, where known, gender_self_declared and gender_community.
    """
    w = L.VOTE_WEIGHTS
    strength = F.when(F.col("age_community_score").isNull(), 1.0).otherwise(
        F.least(F.lit(1.0), F.abs("age_community_score") * 2)
    )
    ballots = F.array(
        F.struct(F.col("age_bucket_self_declared").alias("v"), F.lit(w["self_decl"]).alias("w")),
        F.struct(F.col("age_bucket_community").alias("v"), (w["community"] * strength).alias("w")),
        F.struct(F.col("age_bucket_llm").alias("v"), (w["llm"] * F.coalesce("confidence_llm", F.lit(0.0))).alias("w")),
    )
    valid = F.filter(ballots, lambda b: F.coalesce(b["v"].isin(_LABELS), F.lit(False)))
    df = df.withColumn("_b", valid)
    total = lambda v: F.aggregate(
        F.filter("_b", lambda b: b["v"] == v), F.lit(0.0), lambda s, b: s + b["w"]
    )
    scored = F.transform("_b", lambda b: F.struct(b["v"].alias("v"), total(b["v"]).alias("t")))
    df = df.withColumn("_s", scored).withColumn("_top", F.array_max(F.transform("_s", lambda s: s["t"])))
    winner = F.element_at(F.filter("_s", lambda s: s["t"] == F.col("_top")), 1)
    named = {"self_decl": "age_bucket_self_declared", "community": "age_bucket_community", "llm": "age_bucket_llm"}
    used = F.concat_ws(",", *[F.when(F.col(c).isNotNull(), k) for k, c in named.items()])
    df = df.withColumns(
        {
            "age_bucket": F.when(F.size("_b") > 0, winner["v"]),
            "confidence": F.when(F.size("_b") > 0, F.least(F.lit(1.0), F.col("_top") / sum(w.values()))).otherwise(0.0),
            "methods_used": used,
        }
    ).drop("_b", "_s", "_top")
    if "gender_self_declared" in df.columns:
        other = F.col("gender_community") if "gender_community" in df.columns else F.lit(None).cast("string")
        df = df.withColumn("gender", F.coalesce("gender_self_declared", other))
    return df


def relationship_scores(texts: DataFrame, anchors: DataFrame, vector: str = "embedding", category: str = "category",
                        signs: Mapping[str, int] | None = None) -> DataFrame:
    """Cosine similarity to the centroid of each anchor category, and their signed sum.

    ``anchors`` holds phrase vectors by category; its centroids are one row per category.
    """
    signs = signs or {"romantic": 1, "friendship": 1, "dependency": 1, "tool_usage": -1}
    parts = anchors.where(F.col(category).isin(*signs)).select(category, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(category, "i").agg(F.avg("x").alias("m"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    cents = means.groupBy(category).agg(packed.alias("c"))  # one vector per category
    wide = cents.agg(*[F.max(F.when(F.col(category) == k, F.col("c"))).alias(f"_{k}") for k in signs])
    out = texts.join(F.broadcast(wide))  # one row
    out = out.withColumns({f"sim_{k}": cosine(F.col(vector), F.col(f"_{k}")) for k in signs})
    total = sum((F.col(f"sim_{k}") * s for k, s in signs.items()), F.lit(0.0))
    return out.withColumn("relationship_score", total).drop(*[f"_{k}" for k in signs])
