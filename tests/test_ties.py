"""Ties that sums of another order or another partitioning must not break."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import lexicons as L
from cohortlens.operators import classify as K, rollup as R
from cohortlens.plans.catalog import QUERIES


def test_vocabulary_ties_go_to_the_smaller_community(spark):
    """Eight communities of equal size, room for three, ordered as numbers."""
    rows = [(u, [2, 9, 10, 11, 30, 100, 101, 200]) for u in range(12)] + [(20, [30]), (21, [7, 30]), (22, []), (23, None)]
    for parts in (1, 3, 7):
        lists = spark.createDataFrame(rows, "author long, communities array<long>").repartition(parts)
        got = {r.author: r.v for r in K.membership_vectors(lists, size=3, min_users=10).select("author", K.vector_to_array("features").alias("v")).collect()}
        assert got[0] == [1.0, 1.0, 1.0] and got[20] == got[21] == [1.0, 0.0, 0.0] and got[22] == got[23] == [0.0] * 3
    few = K.membership_vectors(lists, min_users=1000).select(F.size(K.vector_to_array("features"))).distinct().collect()
    assert few == [(0,)]


def test_equal_mean_emotions_tie_in_any_order(spark):
    """Six times 0.1 and three times 0.2: the first label wins, though the floating sums differ."""
    rows = [(1, "surprise")] * 6 + [(1, "disgust")] * 3
    assert 0.1 + 0.1 + 0.1 + 0.1 + 0.1 + 0.1 != 0.2 + 0.2 + 0.2
    value = {"surprise": 0.1, "disgust": 0.2}
    cols = [f"{p}{e}" for p in ("emotion_", "bot_emotion_") for e in L.EMOTIONS]
    data = [(a, *[value[k] if e == k else 0.0 for _ in range(2) for e in L.EMOTIONS], 0.4) for a, k in rows]
    df = spark.createDataFrame(data, "author long, " + ", ".join(f"{c} double" for c in cols) + ", bot_attribution_score double")
    first = next(e for e in L.EMOTIONS if e in value)
    for parts in (1, 2, 4, 9):
        (r,) = R.user_emotions(df.repartition(parts)).collect()
        assert r.dominant_emotion == r.bot_dominant_emotion == first and r.emotion_surprise == r.emotion_disgust


def test_grouped_ranks_tie_equal_means_of_any_order(spark, tmp_path):
    """Users with the same orders in another order have one rank, so r is that of the ranks with ties."""
    prices = [54611.33, 339126.06, 305746.07, 102772.54]
    mean = lambda ps: ((ps[0] + ps[1]) + ps[2]) + ps[3]
    orders = [p for p in itertools.permutations(prices)]
    assert len({mean(p) for p in orders}) > 1  # the sums differ in the last bit
    orders = sorted(orders, key=mean)
    low, high = orders[0], orders[-1]
    users = [(1, low, "1-URGENT"), (2, high, "5-LOW"), (3, low, "5-LOW"), (4, high, "1-URGENT"), (5, high, "1-URGENT"), (6, [9e5] * 4, "1-URGENT"), (7, [8e5] * 4, "5-LOW")]
    rows = [(100 * u + k, u, p, prio) for u, ps, prio in users for k, p in enumerate(ps)]
    write = lambda data, schema, name: spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string", "orders")
    write([(u[0], 0, "BUILDING", 1.0) for u in users], "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double", "customer")
    write([(0, 0)], "n_nationkey long, n_regionkey long", "nation")
    write([(0, "ASIA")], "r_regionkey long, r_name string", "region")
    (got,) = QUERIES["spearman_by_community"](spark, str(tmp_path)).collect()
    joy = [float(u[2] == "1-URGENT") for u in users]
    x, y = ([(sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2) for a in v] for v in ([1, 1, 1, 1, 1, 3, 2], joy))
    assert got.r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-6)
