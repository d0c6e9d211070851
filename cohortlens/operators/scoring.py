"""Scoring texts in batches with a pluggable scorer, and statistics of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlens.functions import text as T

SCORED_SCHEMA = "score int, reasoning string, source string, processing_time_ms double, input_tokens long, output_tokens long"


def lexicon_score(df: DataFrame, text: str = "body") -> DataFrame:
    """Deterministic scorer in column expressions: humanising hits raise the score, attribution adds one."""
    d = T.with_attribution(T.with_ngram_features(df, text), text)
    net = F.col("ngram_anthro_total") - F.col("ngram_deanthro_total")
    base = F.when(net <= 0, 1).when(net <= 1, 2).when(net <= 3, 3).otherwise(4)
    score = F.least(F.lit(5), base + (F.col("bot_attribution_score") > 0.5).cast("int"))
    keep = [c for c in df.columns]
    return d.select(
        *keep, score.cast("int").alias("score"), F.lit("lexicon").alias("reasoning"), F.lit("lexicon").alias("source"),
        F.lit(0.0).alias("processing_time_ms"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"),
    )


def score_with(df: DataFrame, scorer: Callable[[pd.Series], pd.DataFrame], key: str = "id", text: str = "body",
               retries: int = 3) -> DataFrame:
    """Prefiltered texts score 1 at once, the rest go through ``scorer`` batch by batch.

    ``scorer`` maps a batch of texts to ``score`` and ``reasoning``, perhaps ``input_tokens`` and ``output_tokens``.
    A batch that fails or whose output is not one finite score per text is tried again, then halved down to single
    texts; a text that keeps failing gets score 0 and source ``error``, so that a later run picks it up again.
    """
    pre = T.with_prefilter(df.select(key, text), text, "p").select(
        key, F.when(~F.col("p.skip"), F.col(text)).alias(text), F.when(F.col("p.skip"), F.col("p.reason")).alias("reason")
    )
    kind = dict(df.dtypes)[key]

    def checked(texts: pd.Series) -> pd.DataFrame:
        out = scorer(texts).reset_index(drop=True)
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} scores for {len(texts)} texts")
        score = pd.to_numeric(out["score"])
        if not np.isfinite(score.to_numpy(float)).all():
            raise ValueError("a score is not a number")
        tokens = {c: out[c].astype("int64") if c in out else 0 for c in ("input_tokens", "output_tokens")}
        return pd.DataFrame({"score": score.clip(1, 5).astype("int32"), "reasoning": out["reasoning"].astype(str), "source": "model", **tokens})

    def attempt(texts: pd.Series) -> pd.DataFrame:
        reason = ""
        for _ in range(retries):
            try:
                return checked(texts)
            except Exception as e:  # noqa: BLE001 - a failed text is recorded, not raised
                reason = str(e)
        if len(texts) > 1:
            half = len(texts) // 2
            parts = [attempt(t.reset_index(drop=True)) for t in (texts.iloc[:half], texts.iloc[half:])]
            return pd.concat(parts, ignore_index=True)
        return pd.DataFrame({"score": np.zeros(1, "int32"), "reasoning": [reason], "source": ["error"], "input_tokens": [0], "output_tokens": [0]})

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for batch in it:
            skip = batch["reason"].notna()
            done, todo = batch[skip], batch[~skip]
            yield pd.DataFrame(
                {key: done[key], "score": 1, "reasoning": "prefilter:" + done["reason"].astype(str), "source": "prefilter",
                 "processing_time_ms": 0.0, "input_tokens": 0, "output_tokens": 0}
            )
            if len(todo):
                start = time.time()
                out = attempt(todo[text].reset_index(drop=True))
                out.insert(0, key, todo[key].to_numpy())
                yield out.assign(processing_time_ms=(time.time() - start) * 1000 / len(todo))

    return pre.mapInPandas(batches, f"{key} {kind}, {SCORED_SCHEMA}")


def run_statistics(scored: DataFrame, input_cost: float = 0.10, output_cost: float = 0.40) -> DataFrame:
    """Rows, share, time and token cost (per million tokens) by source."""
    from pyspark.sql import Window

    s = scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("processing_time_ms").alias("total_ms"),
        F.avg("processing_time_ms").alias("mean_ms"),
        (F.sum("input_tokens") * input_cost / 1e6 + F.sum("output_tokens") * output_cost / 1e6).alias("cost"),
    )
    whole = Window.partitionBy(F.lit(0))  # one row per source
    return s.withColumn("share", F.col("n") / F.sum("n").over(whole))
