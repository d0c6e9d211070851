"""Boosted trees: more than two classes, class weights under limits, depth and rate."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import classify as K


@pytest.fixture(scope="module")
def four(spark):
    """Four classes at the corners of a square: no single cut of a column tells one from the rest."""
    rng = np.random.default_rng(8)
    y = np.arange(400) % 4
    a, b = (y // 2) * 4 + rng.normal(0, 0.7, 400), (y % 2) * 4 + rng.normal(0, 0.7, 400)
    return spark.createDataFrame([(i, float(y[i]), float(a[i]), float(b[i])) for i in range(400)], "author int, label double, a double, b double")


def test_four_classes_on_held_out_rows(spark, four, tmp_path):
    model = K.boosted(four.where("author < 280"), ["a", "b"], "label", n_classes=4, iterations=6, depth=3)
    out = model.transform(K.assembled(four.where("author >= 280"), ["a", "b"]))
    names = ["ll", "lh", "hl", "hh"]
    rows = K.with_confidence(out, names).collect()
    assert len(rows) == 120 and sum(names[int(r.label)] == r.predicted for r in rows) > 110
    assert all(names[int(r.prediction)] == r.predicted for r in rows)
    assert all(sum(r[f"prob_{x}"] for x in names) == pytest.approx(1) for r in rows)
    assert sum(model.featureImportances) == pytest.approx(1)
    model.save(str(tmp_path / "model"))
    again = K.BoostedClasses.load(str(tmp_path / "model"), 4).transform(K.assembled(four.where("author >= 280"), ["a", "b"]))
    assert again.select("author", "prediction").exceptAll(out.select("author", "prediction")).count() == 0


def test_stack_of_four_classes(four):
    stack = K.fit_stack(four.where("author < 280"), {"both": ["a", "b"]}, "author", "label", n_classes=4, k=2, iterations=4, depth=3)
    out = stack.predict(four.where("author >= 280").select("author", "a", "b"), ["0", "1", "2", "3"])
    right = out.join(four.select("author", "label"), "author").where(F.col("predicted").cast("double") == F.col("label"))
    assert right.count() > 110


def test_weight_search_keeps_the_recall_of_the_guarded_class(spark):
    rng = np.random.default_rng(9)
    y = (rng.random(500) < 0.25).astype(float)
    x = y + rng.normal(0, 0.8, 500)
    df = spark.createDataFrame([(i, float(y[i]), float(x[i])) for i in range(500)], "author int, label double, x double")
    rows = K.weight_search(df, ["x"], "author", "label", [1.0, 1.5, 20.0], k=2, estimator=K.boosted_estimator("label", iterations=4, depth=2)).collect()
    by = {r.weight: r for r in rows}
    assert by[20.0].guarded_recall < by[1.0].guarded_recall - 0.05 and not by[20.0].feasible and not by[20.0].chosen
    chosen = [r for r in rows if r.chosen]
    assert len(chosen) == 1 and chosen[0].macro_f1 == max(r.macro_f1 for r in rows if r.feasible)


def test_grid_chooses_the_depth_that_an_interaction_needs(spark):
    rng = np.random.default_rng(10)
    x = rng.uniform(-1, 1, (400, 2))
    rows = [(i, float(p * q > 0), float(p), float(q)) for i, (p, q) in enumerate(x)]
    df = spark.createDataFrame(rows, "author int, label double, a double, b double")
    out = {(r.depth, r.rate): r for r in K.boosted_grid(df, ["a", "b"], "author", "label", [1, 4], [0.3], iterations=4, k=2).collect()}
    assert out[(4, 0.3)].chosen and out[(4, 0.3)].f1 > out[(1, 0.3)].f1 + 0.1 and not out[(1, 0.3)].chosen


def test_grid_fits_no_model_beyond_the_folds(spark, monkeypatch):
    """One fit per fold and point, on rows that lie in all of the session's partitions."""
    seen, fit = [], K.GBTClassifier.fit
    monkeypatch.setattr(K.GBTClassifier, "fit", lambda self, rows, *more: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows, *more))
    df = spark.range(400).selectExpr("id AS author", "double(id % 7) AS a", "double(id % 7 > 3) AS label").coalesce(1)
    out = K.boosted_grid(df, ["a"], "author", "label", [1, 2], [0.3], iterations=2, k=2).collect()
    assert len(out) == 2 and len(seen) == 4 and set(seen) == {spark.sparkContext.defaultParallelism}
    assert [r.depth for r in out if r.chosen] == [1] and all(r.f1 == 1.0 for r in out)
