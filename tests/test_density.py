"""Density clusters: planted groups and noise, the neighbour graph, the spanning forest and the choice of clusters."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import density as DE


def frame(spark, v, weight=None):
    return spark.createDataFrame([(i, list(map(float, x)), 1 if weight is None else int(weight[i])) for i, x in enumerate(v)], "id long, v array<double>, weight long")


def test_planted_clusters_and_noise(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [12, 0, 0], [0, 12, 0], [9, 9, 9]])
    v = np.concatenate([c + s * rng.normal(size=(n, 3)) for c, s, n in zip(centres, (1.0, 0.3, 1.0, 1.5), (300, 120, 200, 260))] + [rng.uniform(-30, 40, (60, 3))])
    truth = np.repeat([0, 1, 2, 3, -1], [300, 120, 200, 260, 60])
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)] + [(2000, None), (2001, []), (2002, [float("nan"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    got = {r.id: r.topic for r in DE.density_clusters(df, "id", "v", min_size=40).collect()}
    assert len(got) == len(rows) and got[2000] == got[2001] == got[2002] == -1
    topics = np.array([got[i] for i in range(len(v))])
    found = set()
    for k in range(4):
        top, n = Counter(topics[truth == k]).most_common(1)[0]
        assert top >= 0 and n >= 0.85 * (truth == k).sum() and (topics[truth != k] == top).sum() <= 20
        found.add(top)
    assert len(found) == 4 and set(topics) == found | {-1} and (topics[truth == -1] == -1).mean() > 0.7


def test_nothing_to_cluster(spark):
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")
    assert {r.topic for r in DE.density_clusters(few, "id", "v").collect()} == {-1}
    assert DE.density_clusters(few.limit(0), "id", "v").count() == 0
    copies = spark.createDataFrame([(i, [1.0, 1.0] if i % 2 else [5.0, 5.0]) for i in range(200)], "id long, v array<double>")
    assert sorted(Counter(r.topic for r in DE.density_clusters(copies, "id", "v").collect()).values()) in ([100, 100], [200])


def test_neighbour_graph_finds_most_true_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 5))
    got = DE.neighbour_graph(frame(spark, v), 10).toPandas()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    true = {(i, int(j)) for i in range(len(v)) for j in np.argsort(d[i])[:10]}
    assert len(got) == 15_000 and np.allclose(got.d, d[got.a, got.b])
    assert len(true & set(zip(got.a, got.b))) >= 0.9 * len(true)


def test_spanning_forest_is_minimal(spark):
    rng = np.random.default_rng(3)
    n = 120
    edges = {(min(a, b), max(a, b)): float(rng.integers(1, 6)) for a, b in rng.integers(0, n, (400, 2)) if a != b and (a < 100) == (b < 100)}
    points = spark.createDataFrame([(i, 1) for i in range(n)], "id long, weight long")
    got = DE.spanning_forest(points, spark.createDataFrame([(int(a), int(b), w) for (a, b), w in edges.items()], "a long, b long, w double")).collect()
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total, count = 0.0, 0
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            total, count = total + w, count + 1
    assert len(got) == count and sum(r.w for r in got) == pytest.approx(total)
    assert all(edges[r.a, r.b] == r.w for r in got)


def test_core_distances_count_copies(spark):
    v = np.array([[0.0], [1.0], [3.0], [7.0]])
    points = frame(spark, v, [1, 5, 1, 1])
    edges = {(r.a, r.b): r.w for r in DE.reachability_edges(points, DE.neighbour_graph(points, 3), 3).collect()}
    # core distances: 0 -> 1 (itself and five copies), 1 -> 0 (five copies), 3 -> 2, 7 -> 6 (3 at 4, then five copies at 6)
    assert edges[0, 1] == 1.0 and edges[1, 2] == 2.0 and edges[1, 3] == 6.0 and edges[2, 3] == 6.0


def test_nested_parts_and_choice(spark):
    """Two tight pairs of triples that join at 5: the pairs are chosen if they stay long, the triples never (too small)."""
    points = spark.createDataFrame([(i, 1) for i in range(13)], "id long, weight long")
    chain = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.2), (3, 4, 1.0), (4, 5, 1.0), (5, 6, 5.0), (6, 7, 1.0), (7, 8, 1.0), (8, 9, 1.2), (9, 10, 1.0), (10, 11, 1.0), (11, 12, 40.0)]
    cuts = [1.0, 1.5, 4.0, 5.0, 40.0]
    parts = DE.kept(DE.nested_clusters(points, spark.createDataFrame(chain, "a long, b long, w double"), cuts))
    by = {level: Counter(r.part for r in parts.where(F.col("level") == level).collect()) for level in range(5)}
    assert sorted(by[0].values()) == [1, 3, 3, 3, 3] and sorted(by[1].values()) == [1, 6, 6] and sorted(by[3].values()) == [1, 12] and sorted(by[4].values()) == [13]
    assert {(r.level, r.part) for r in DE.chosen_parts(parts, cuts, 5).collect()} == {(2, 0), (2, 6)}
    assert {(r.level, r.part) for r in DE.chosen_parts(parts, cuts, 12, single=True).collect()} == {(4, 0)}
    assert DE.chosen_parts(parts, cuts, 12).count() == 0
    assert math.isclose(sum(by[4].values()), 13)


def test_letter_shares_are_those_of_the_column_functions(spark):
    from cohortlens.functions.letters import counts, letter_shares

    letters = "aezäßéñ"
    texts = ["", "a", "Ää AZ ßß é́ ñ", None, "日本 a 😀 e", "x" * 50, "é" * 7 + "a", "\x00\x7f\u0080߿"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(3)
    low, size = F.lower("body"), F.greatest(F.length("body"), F.lit(1)).cast("double")
    want = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))) / size for x in letters])
    rows = df.select(letter_shares(low, letters).alias("got"), F.when(F.col("body").isNotNull(), want).alias("want")).collect()
    assert all(r.got == r.want for r in rows) and sum(r.got is None for r in rows) == 5

    import pyarrow as pa
    from cohortlens.functions import letters as LE

    part = pa.array(texts)[3:17]
    whole = counts(part, letters)
    LE._BLOCK, kept = 8, LE._BLOCK
    try:
        small = counts(part, letters)
    finally:
        LE._BLOCK = kept
    assert all((a == b).all() for a, b in zip(whole, small)) and whole[1].tolist() == [len(x or "") for x in texts[3:17]]
    with pytest.raises(ValueError):
        counts(part, "日")


def test_kept_rows_have_their_own_size(spark):
    """Each round joins what the last one kept; the estimated size must not be squared every time."""
    at = spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)], "c long, to long")
    for _ in range(6):
        nxt = at.select(F.col("c").alias("to"), F.col("to").alias("further"))
        at = DE.kept(at.join(nxt, "to", "left").select("c", F.col("further").alias("to")))
    assert int(str(at._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000 and at.count() == 20
