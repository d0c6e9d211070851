"""Counts beyond 64-bit products, values beyond their types, failing scorers, repeated ids, crowded values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text as T
from cohortlens.operators import classify as K, clean as C, groups as G, models as MD, ranks, rollup as R, scoring as SC
from cohortlens.sources import comments as IO
from cohortlens.streaming import ingest as ST


def test_wilson_of_large_counts(spark):
    n, p = 10_000_000_000, 0.25
    lo, hi = R.wilson(F.lit(int(n * p)), F.lit(n))
    got = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    half = 1.96 * math.sqrt(p * (1 - p) / n)
    assert got.lo == pytest.approx(p - half, abs=1e-8) and got.hi == pytest.approx(p + half, abs=1e-8)


def test_scores_beyond_their_type(spark):
    rows = [("3.7", 3), ("1e12", None), ("Infinity", None), ("NaN", None), ("0.9", None), ("5.99", 5), ("6", None), ("x", None), (None, None)]
    df = spark.createDataFrame(rows, "s string, want int").withColumn("got", IO.lenient_score(F.col("s")))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    replies = [('{"score": 99999999999, "r": "a"}', 5), ('{"score": -1e300}', 1), ('{"score": 2.9}', 2), ('{"score": "4"}', 0), ("no json", 0)]
    df = spark.createDataFrame(replies, "r string, want int").withColumn("got", T.parse_reply(F.col("r"))["score"])
    assert df.where("got <> want").count() == 0


def test_one_bad_text_does_not_fail_its_batch(spark):
    def scorer(texts: pd.Series) -> pd.DataFrame:
        if texts.str.contains("poison").any():
            raise RuntimeError("refused " + "x" * 500)
        score = np.where(texts.str.contains("nan"), np.nan, 4.0)
        return pd.DataFrame({"score": score, "reasoning": "fine", "input_tokens": texts.str.len(), "output_tokens": 2})

    rows = [(i, f"she is really nice to me today {'poison' if i == 7 else 'nan' if i == 11 else i}") for i in range(20)]
    out = SC.score_with(spark.createDataFrame(rows, "id int, body string").coalesce(1), scorer)
    got = {r.id: r for r in out.collect()}
    assert len(got) == 20 and {i for i, r in got.items() if r.source == "error"} == {7, 11}
    assert all(r.score == 4 for i, r in got.items() if i not in (7, 11)) and len(got[7].reasoning) > 300
    stats = {r.source: r for r in SC.run_statistics(out).collect()}
    assert stats["model"].n == 18 and stats["model"].cost > 0


def test_stream_and_batch_clean_agree_on_repeated_ids(spark, tmp_path):
    long = "this is a text of a good length"
    batches = [[("a", "short"), ("b", long)], [("a", long), ("c", long)], [("b", long + " again")]]
    for k, rows in enumerate(batches):
        raw = [(i, "someone", body, str(1000 + k), "s") for i, body in rows]
        df = spark.createDataFrame(raw, "id string, author string, body string, created_utc string, subreddit string")
        df.coalesce(1).write.json(str(tmp_path / "parts" / str(k)))
    for k in range(len(batches)):  # files arrive one after the other
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / "parts" / str(k)).glob("*.json"):
            f.rename(tmp_path / "in" / f"{k}.json")
        ST.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "3650 days").awaitTermination()
    got = {(r.id, r.body) for r in ST.ingested(spark, str(tmp_path / "out")).collect()}
    table = spark.createDataFrame([(i, "someone", body, 1000 + k, "s", k) for k, rows in enumerate(batches) for i, body in rows], "id string, author string, body string, created_utc long, subreddit string, _pos int")
    assert got == {(r.id, r.body) for r in C.clean(table, file=None).collect()} == {("b", long), ("c", long)}
    with pytest.raises(ValueError):
        C.clean(table.drop("_pos"), file=None)


def test_crowded_values_spread_over_slices(spark):
    df = spark.range(20_000).select((F.lit(1_700_000_000.0) + F.col("id") * 1577).alias("v"))
    ends = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    slices = df.groupBy(ranks.value_slice(F.col("v"), F.lit(ends.lo), F.lit(ends.hi)).alias("s")).count()
    top = slices.agg(F.count("s").alias("n"), F.max("count").alias("m")).first()
    assert top.n >= 1000 and top.m <= 0.01 * 20_000
    got = ranks.quantiles(df, "v", {"q": 0.3}).first().q
    assert got == pytest.approx(np.quantile(1_700_000_000.0 + np.arange(20_000) * 1577, 0.3), rel=1e-12)
    odd = spark.createDataFrame([(x,) for x in (-1e300, -5.0, 0.0, 1e-9, 3.0, 1e300)], "v double")
    assert [r.rank for r in ranks.midranks(odd, "v").orderBy("v").collect()] == [1, 2, 3, 4, 5, 6]


def test_pairs_of_too_many_levels_raise(spark):
    df = spark.range(300).select((F.col("id") % 30).alias("g"), F.rand(1).alias("v"))
    with pytest.raises(ValueError):
        G.pairwise(df, "g", "v", max_levels=20)
    assert G.pairwise(df, "g", "v", max_levels=30).count() == 30 * 29 // 2


def test_communities_of_one_circle_are_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(int(u), [f"{'ab'[u % 2]}{k}" for k in rng.choice(8, 5, replace=False)]) for u in range(400)]
    lists = spark.createDataFrame(rows, "author int, communities array<string>")
    v = {r.community: np.array(r.vector) for r in K.community_vectors(lists, size=16, users_per_partition=150).collect()}
    cos = lambda a, b: v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    for x in v:
        near = max((y for y in v if y != x), key=lambda y: cos(x, y))
        assert near[0] == x[0]


def test_detectable_effect_has_the_target_power():
    sizes = np.array([20.0, 150.0, 5000.0])
    effects = MD.detectable_effects(sizes, 0.8, 5, 0.05)
    assert np.allclose(MD.f_test_power(sizes, effects, 5, 0.05), 0.8, atol=1e-6)
    assert abs(effects[1] - 0.0894) < 0.002  # published tables: f2 0.09 for n about 150
    assert np.isnan(MD.f_test_power(np.array([5.0]), np.array([0.1]), 5, 0.05)[0])


def test_classifiers_separate_what_is_separable(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    x = np.stack([y * 3 + rng.normal(0, 1, 600), rng.normal(0, 1, 600), y + rng.normal(0, 1, 600)], axis=1)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(600)], "author int, label double, a double, b double, c double")
    out = K.stacked(df, {"one": ["a", "b"], "two": ["c"]}, "author", "label", k=3, iterations=5)
    assert out.count() == 600 and out.where("label = prediction").count() > 540
    trees = {r.feature: r.importance for r in K.tree_importances(df, ["a", "b", "c"], "label", 5).collect()}
    assert sum(trees.values()) == pytest.approx(1) and max(trees, key=trees.get) == "a"
    weights = K.weight_search(df, ["a", "c"], "author", "label", [1.0, 2.0]).collect()
    assert sum(r.chosen for r in weights) == 1 and all(r.accuracy > 0.9 for r in weights)
    grid = K.grid_search(df, ["a", "c"], "author", "label", [0.0, 10.0]).collect()
    assert next(r.reg_param for r in grid if r.chosen) == 0.0


def test_topics_find_planted_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(z) for z in np.eye(6)[i % 3] * 8 + rng.normal(0, 0.3, 6)]) for i in range(300)]
    out = K.topics(spark.createDataFrame(rows, "id int, v array<double>"), "v", k=3, components=3)
    sets = out.groupBy("topic").agg(F.count("id").alias("n"), F.count_distinct(F.col("id") % 3).alias("kinds")).collect()
    assert [r.n for r in sets] == [100] * 3 and all(r.kinds == 1 for r in sets)


def test_stack_predicts_unlabelled_rows_and_survives_saving(spark, tmp_path):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 500)
    rows = [(i, float(y[i]), float(y[i] * 3 + rng.normal()), float(y[i] + rng.normal())) for i in range(500)]
    df = spark.createDataFrame(rows, "author int, label double, a double, b double")
    signals = {"one": ["a"], "two": ["b"]}
    stack = K.fit_stack(df.where("author < 300"), signals, "author", "label", k=2, iterations=4)
    out = stack.predict(df.where("author >= 300").select("author", "a", "b"), ["no", "yes"], 0.6)
    truth = df.select("author", F.when(F.col("label") == 1, "yes").otherwise("no").alias("truth"))
    got = out.join(truth, "author").agg(F.count("author").alias("n"), F.avg((F.col("predicted") == F.col("truth")).cast("double")).alias("right"), F.min(F.col("prob_no") + F.col("prob_yes")).alias("low")).first()
    assert got.n == 200 and got.right > 0.9 and got.low == pytest.approx(1)
    assert out.where("confidence < 0.6 and predicted is not null").count() == 0
    stack.save(str(tmp_path / "stack"))
    again = K.Stack.load(str(tmp_path / "stack"), signals).predict(df.select("author", "a", "b"), ["no", "yes"])
    assert again.join(out, "author").where(F.abs(again.prob_yes - out.prob_yes) > 1e-12).count() == 0


def test_merges_build_on_each_other(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "author int, subreddit string, count int")
    path = str(tmp_path / "table")
    IO.write(make([(1, "a", 5)]), path)
    IO.merge_save(spark, path, make([(1, "a", 9), (2, "b", 1)]))
    IO.merge_save(spark, path, make([(2, "b", 7), (3, "c", 3)]))
    assert sorted(spark.read.parquet(IO.current(spark, path)).collect()) == [(1, "a", 5), (2, "b", 1), (3, "c", 3)]
