"""Cleaning, filters and de-duplication of comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.functions import lexicons as L
from cohortlens.functions.text import strip, without_urls

COMMENT_COLUMNS = {
    "id": ("string", ""),
    "author": ("string", ""),
    "body": ("string", ""),
    "created_utc": ("long", 0),
    "subreddit": ("string", ""),
    "link_id": ("string", ""),
    "parent_id": ("string", ""),
    "score": ("long", 0),
    "author_flair_text": ("string", None),
}


def standardise(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The nine comment columns, cast with defaults; rows without id or author are dropped.

    A number that does not parse invalidates its row, a missing one becomes the default.
    """
    cols, bad = [], F.lit(False)
    for name, (kind, default) in COMMENT_COLUMNS.items():
        if name not in df.columns:
            cols.append(F.lit(default).cast(kind).alias(name))
            continue
        cast = F.col(name).try_cast(kind)
        if kind == "long":
            bad = bad | (F.col(name).isNotNull() & cast.isNull())
        value = F.nullif(cast, F.lit("")) if default is None else F.coalesce(cast, F.lit(default))
        cols.append(value.alias(name))
    return df.where(~bad).select(*cols, *keep).where((F.col("id") != "") & (F.col("author") != ""))


def is_person(author: str = "author", bots: Sequence[str] = tuple(L.BOT_AUTHORS)) -> Column:
    name = strip(F.coalesce(F.col(author), F.lit("")))
    return (name != "") & ~name.isin(*bots)


def has_quality_text(text: str = "body", low: int = L.MIN_LENGTH, high: int = L.MAX_LENGTH) -> Column:
    body = F.coalesce(F.col(text), F.lit(""))
    return F.length(strip(body)).between(low, high) & (F.length(strip(without_urls(body))) >= low)


def is_replication_text(author: str = "author", text: str = "body", low: int = 10) -> Column:
    """Substring bot filter; a missing author is kept."""
    botlike = F.coalesce(F.lower(F.col(author)).rlike("|".join(L.BOT_NAME_PARTS)), F.lit(False))
    return ~botlike & (F.length(F.coalesce(F.col(text), F.lit(""))) >= low)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``.

    An aggregate, not a window: every map task reduces a hot key to one row before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def dedupe(df: DataFrame, order: Sequence[str], key: str = "id") -> DataFrame:
    """First copy per id in ``order``."""
    return first_per_key(df, [key], order)


def clean(df: DataFrame, file: str | None = "_file", order: Sequence[str] = ("_pos",)) -> DataFrame:
    """Standardise, first copy per id within its file, bot and text filters, first copy over all files.

    Copies within a file go before the filters, as a dropped first copy must not let a later one in.
    """
    keep = [c for c in ([file] if file else []) + list(order) if c in df.columns]
    std = standardise(df, keep)
    ok = is_person() & has_quality_text()
    if not [c for c in order if c in df.columns]:
        raise ValueError(f"clean needs a row order; none of {list(order)} is a column")
    if file:
        rest = [c for c in keep if c != file]
        std = first_per_key(std, [file, "id"], rest)
        return first_per_key(std.where(ok), ["id"], keep).drop(*keep)
    return first_per_key(std, ["id"], keep).where(ok).drop(*keep)


def funnel(df: DataFrame, file: str = "_file", order: Sequence[str] = ("_pos",)) -> DataFrame:
    """Counts after every stage per file, in one pass over one row per (file, id).

    ``df`` is the raw scan with a file column; raw rows are counted before they are collapsed.
    """
    raw = df.groupBy(file).agg(F.count(F.lit(1)).alias("initial_count"))
    first = first_per_key(standardise(df, [file, *order]), [file, "id"], order)
    person, quality = is_person(), has_quality_text()
    stages = first.groupBy(file).agg(
        F.count(F.lit(1)).alias("after_standardization"),
        F.count_if(person).alias("after_bot_filter"),
        F.count_if(person & quality).alias("after_text_filter"),
        F.count_if(person & quality).alias("after_deduplication"),
        F.count_if(person & quality).alias("final_count"),
    )
    zero = [c for c in stages.columns if c != file]
    return raw.join(stages, file, "left").na.fill(0, zero)


def exclude_ids(df: DataFrame, main: DataFrame, key: str = "id") -> DataFrame:
    return df.join(main.select(key), key, "left_anti")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    keep = F.lit(True)
    for c in cols:
        keep = keep & F.col(c).isNotNull()
        if types[c] in ("double", "float"):
            keep = keep & ~F.isnan(c)
    return df.where(keep)


def valid_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """Score 0 marks a scoring error."""
    return df.where(F.col(score) > 0)


def confident(df: DataFrame, threshold: float = 0.6, mean: str | None = "score_mean",
              confidences: Sequence[str] = ("gender_conf", "age_conf")) -> DataFrame:
    """Population filters; with ``mean`` the conditional sample (mean above the floor of 1)."""
    keep = F.lit(True)
    for c in confidences:
        keep = keep & (F.col(c) >= threshold)
    if mean:
        keep = keep & (F.col(mean) > 1)
    return df.where(keep)
