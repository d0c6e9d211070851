"""Registered queries: a Spark callable per name and, where SQL can say it, the SQL to check it with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int = 6, only: Sequence[str] | None = None, /, **special: int) -> DataFrame:
    """Doubles rounded for comparison, -0.0 folded into 0.0; ``special`` sets digits per column."""
    cols = []
    for name, kind in df.dtypes:
        if kind in ("double", "float") and (only is None or name in only):
            cols.append((F.round(F.col(name).cast("double"), special.get(name, digits)) + F.lit(0.0)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)
