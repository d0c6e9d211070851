"""The quantile map and held-out importance against plain Python."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from cohortlens.functions.scalar import normal_quantile
from cohortlens.operators import classify as K, importances as IMP, scaling as SCALE, skipgram as SG


def test_normal_quantile_has_sixteen_digits(spark):
    shares = [10.0**-k for k in (300, 100, 30, 12, 7, 3)] + [i / 997 for i in range(1, 997)] + [1 - 1e-12, 0.075, 0.925]
    got = spark.createDataFrame([(p,) for p in shares], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-14, abs=1e-15)
    ends = spark.createDataFrame([(0.0,), (1.0,), (-0.1,), (1.1,), (None,)], "p double").select(normal_quantile(F.col("p")).alias("z")).collect()
    assert [r.z for r in ends] == [-math.inf, math.inf, None, None, None]


def brute_map(train, values, landmarks):
    """Both directions of an interpolation over the marks, their mean, the ends kept finite."""
    grid = np.linspace(0, 1, landmarks)
    marks = np.quantile(train, grid)
    up = np.interp(values, marks, grid)
    down = -np.interp(-np.asarray(values), -marks[::-1], -grid[::-1])
    return [NormalDist().inv_cdf(min(max(float(u), 1e-7), 1 - 1e-7)) for u in (up + down) / 2]


@pytest.mark.parametrize("landmarks", [2, 7, 100, 1000])
def test_marks_are_exact_and_apply_to_other_rows(spark, landmarks):
    rng = random.Random(landmarks)
    train = [round(rng.gauss(0, 3), rng.choice([0, 1, 6])) for _ in range(400)] + [5.0] * 150 + [1e9, -1e9, 0.1, 0.1000001]
    other = [*train[:50], -2e9, 2e9, 5.0, 5.0000001, 4.9999999, 0.1, 1e9]
    marks = SCALE.quantile_marks(spark.createDataFrame([(x,) for x in [*train, None, float("nan")]], "x double").repartition(5), ["x"], landmarks)
    assert np.allclose(marks.first().marks, np.quantile(train, np.linspace(0, 1, landmarks)), rtol=1e-12)
    rows = spark.createDataFrame(list(enumerate([*other, None, float("nan")])), "i int, x double")
    got = [r.x for r in SCALE.to_normal(rows, marks, ["x"], landmarks=landmarks).orderBy("i").collect()]
    assert got[-2:] == [None, None]
    assert np.allclose(got[:-2], brute_map(train, other, landmarks), rtol=1e-7, atol=1e-9)


def test_map_of_constants_and_nothing(spark):
    df = spark.createDataFrame([(3.0, None), (3.0, None)], "x double, y double")
    out = SCALE.to_normal(df, SCALE.quantile_marks(df, ["x", "y"], 10), ["x", "y"], "_z", 10).collect()
    assert [(r.x, r.x_z, r.y_z) for r in out] == [(3.0, 0.0, None)] * 2
    with pytest.raises(ValueError):
        SCALE.quantile_marks(df, ["x"], 1)


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 800)
    x = np.stack([y * 3 + rng.normal(0, 1, 800), rng.normal(0, 1, 800), y + rng.normal(0, 1, 800)], axis=1)
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(800)], "author int, label double, a double, b double, c double")
    return df.where("author < 600"), df.where("author >= 600")


def test_permuted_columns_are_permutations(spark, separable):
    _, test = separable
    cols = ["a", "b", "c"]
    rows = IMP.permuted(test.repartition(7), cols, "author", "label", repeats=3).toPandas()
    again = IMP.permuted(test.coalesce(1), cols, "author", "label", repeats=3).toPandas()
    key = ["feature", "rep", *cols]
    assert rows.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    whole = rows[rows.feature.isna()].sort_values(cols)
    assert len(rows) == 200 * (1 + 3 * 3)
    for (feature, rep), part in rows[rows.feature.notna()].groupby(["feature", "rep"]):
        assert sorted(part[feature]) == sorted(whole[feature]) and (part.label == 1).sum() == (whole.label == 1).sum()
        kept = [c for c in cols if c != feature]
        assert part.sort_values(kept)[kept].values.tolist() == whole.sort_values(kept)[kept].values.tolist()
        paired = part.merge(whole, on=kept, suffixes=("", "_own"))
        assert (paired[feature] == paired[f"{feature}_own"]).mean() < 0.1


def test_importance_of_given_models(spark, separable):
    train, test = separable
    cols = ["a", "b", "c"]
    lr = LogisticRegression(labelCol="label", featuresCol="features")
    models = [
        lr.fit(K.assembled(train, cols).select("label", "features")),
        Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), lr]).fit(train),
        K.fit_stack(train, {"one": ["a", "b"], "two": ["c"]}, "author", "label", k=3, iterations=5),
    ]
    for model in models:
        got = {r.feature: r for r in IMP.permutation_importance(model, test, cols, "author", "label").collect()}
        assert set(got) == set(cols) and got["a"].importance > 0.2 > abs(got["b"].importance) * 4 and got["a"].sd >= 0
    rule = SQLTransformer(statement="SELECT *, CAST(a > 1.5 AS DOUBLE) AS prediction FROM __THIS__")
    got = {r.feature: r.importance for r in IMP.permutation_importance(rule, test, cols, "author", "label", 2).collect()}
    assert got["b"] == got["c"] == 0.0 and got["a"] > 0.3


def test_macro_f1_counts_classes_of_either_side(spark):
    rows = spark.createDataFrame([("x", 0.0, 0.0), ("x", 0.0, 1.0), ("x", 1.0, 1.0), ("x", 1.0, 2.0), ("y", 0.0, 0.0)], "g string, label double, prediction double")
    got = {r.g: r.macro_f1 for r in IMP.macro_f1(rows, ["g"], "label").collect()}
    assert got["x"] == pytest.approx((2 / 3 + 2 / 4 + 0) / 3) and got["y"] == 1.0


def test_partitions_of_community_vectors_are_bounded(spark, monkeypatch):
    """Each partition hands over all vectors it met, so their number may not go on growing with the users."""
    seen, make = [], K.Word2Vec
    monkeypatch.setattr(K, "Word2Vec", lambda **options: seen.append(options["numPartitions"]) or make(**options))
    lists = spark.range(240).selectExpr("array(concat('a', id % 3), concat('b', id % 4), 'c') AS communities")
    for users in (1000, 60, 2):
        out = K.community_vectors(lists, size=4, epochs=1, users_per_partition=users)
        assert {r.community for r in out.collect()} == {"a0", "a1", "a2", "b0", "b1", "b2", "b3", "c"}
    assert seen == [1, 4, 8]


def test_a_training_step_is_that_of_the_pairs_one_by_one():
    """Lists longer than a group of centres lose no pair at its edges, and lists do not run into each other."""
    rng = np.random.default_rng(3)
    owner = np.repeat(np.arange(4), [3, 90, 1, 40])
    items = rng.integers(0, 50, len(owner))
    shares = np.cumsum(np.full(50, 0.02))
    inner, outer = rng.normal(0, 0.3, (50, 6)).astype(np.float32), rng.normal(0, 0.3, (50, 6)).astype(np.float32)
    want = [inner.astype(float), outer.astype(float)]
    draws = np.random.default_rng(5)
    for at in range(0, len(items), SG.CENTRES):  # 50 items: one group a step
        a, b = (w.copy() for w in want)
        change, met = [np.zeros((50, 6)), np.zeros((50, 6))], [np.zeros(50), np.zeros(50)]
        reach = draws.integers(1, 6, (1, SG.CENTRES))[0]
        drawn = np.searchsorted(shares, draws.random((1, SG.SAMPLES)), side="right")[0]
        for i in range(at, min(at + SG.CENTRES, len(items))):
            others = [j for j in range(len(items)) if j != i and owner[j] == owner[i] and abs(i - j) <= reach[i - at]]
            terms = [(items[j], 1.0, 1.0) for j in others] + [(k, 0.0, len(others) * SG.NEGATIVE / SG.SAMPLES) for k in drawn]
            for k, right, weight in terms:
                pull = weight * (right - 1 / (1 + np.exp(-a[items[i]] @ b[k])))
                for side, row, by in ((0, items[i], b[k]), (1, k, a[items[i]])):
                    change[side][row] += pull * by
                    met[side][row] += weight
        for side in (0, 1):
            want[side] += change[side] * (0.1 * np.minimum(1, SG.TERMS / np.maximum(met[side], 1)))[:, None]
    SG.train(inner, outer, items, owner, 5, 0.1, shares, np.random.default_rng(5))
    assert np.allclose(inner, want[0], atol=1e-4) and np.allclose(outer, want[1], atol=1e-4)


def test_word_vectors_take_nulls_rare_words_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(SG, "BLOCK", 4)
    lists = spark.createDataFrame([(["a", "b", None, "c"],), (None,), ([],), (["z"],)] + [([f"w{i % 9}", "a", "b"],) for i in range(30)], "communities array<string>")
    got = {r.community: r.vector for r in K.community_vectors(lists, size=5, epochs=2, users_per_partition=10).collect()}
    assert set(got) == {"a", "b", *(f"w{i}" for i in range(9))} and all(len(v) == 5 and np.isfinite(v).all() for v in got.values())
    assert K.community_vectors(lists.limit(0), size=5, epochs=1).count() == 0
