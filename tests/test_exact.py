"""Counted null distributions against enumeration, their limits and their method argument."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest

from cohortlens.functions import cdf, exact
from cohortlens.operators import groups as G


def doubled_midranks(values):
    return [2 * sum(v < x for v in values) + values.count(x) + 1 for x in values]


def grouped(values):
    ranks = dict(zip(values, doubled_midranks(values)))
    keys = sorted(set(values))
    return [ranks[k] for k in keys], [values.count(k) for k in keys]


def two_sided(all_sums, at):
    n = len(all_sums)
    return min(1.0, 2 * min(sum(s <= at for s in all_sums), sum(s >= at for s in all_sums)) / n)


@pytest.mark.parametrize("n", range(2, 13))
@pytest.mark.parametrize("spread", [3, 100])
def test_rank_sum_equals_enumeration(n, spread):
    rng = random.Random(n * spread)
    values = [rng.randrange(spread) for _ in range(n)]
    ranks = doubled_midranks(values)
    for n_a in {1, n // 2, n - 1}:
        sums = [sum(c) for c in itertools.combinations(ranks, n_a)]
        for at in rng.sample(sums, min(4, len(sums))):
            assert exact.rank_sum(n_a, *grouped(values), at) == pytest.approx(two_sided(sums, at), rel=1e-12)


@pytest.mark.parametrize("n", range(1, 13))
def test_signed_rank_equals_enumeration(n):
    rng = random.Random(n)
    values = [rng.randrange(1, 8) for _ in range(n)]
    ranks = doubled_midranks(values)
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    for at in rng.sample(sums, min(4, len(sums))):
        assert exact.signed_rank(*grouped(values), at) == pytest.approx(two_sided(sums, at), rel=1e-12)


@pytest.mark.parametrize("n_a, n_b", [(1, 1), (2, 3), (4, 4), (5, 7), (6, 6), (3, 9)])
def test_kolmogorov_equals_enumeration(n_a, n_b):
    reached = []
    for steps in itertools.combinations(range(n_a + n_b), n_a):
        i = j = most = 0
        for s in range(n_a + n_b):
            i, j = (i + 1, j) if s in steps else (i, j + 1)
            most = max(most, abs(i * n_b - j * n_a))
        reached.append(most)
    for d in sorted(set(reached)):
        assert exact.kolmogorov(n_a, n_b, d) == pytest.approx(sum(r >= d for r in reached) / len(reached), rel=1e-12)


def test_small_tails_keep_their_digits():
    assert exact.kolmogorov(40, 40, 1600) == pytest.approx(2 / math.comb(80, 40), rel=1e-9)
    assert exact.rank_sum(40, [2 * i for i in range(1, 81)], [1] * 80, 40 * 41) == pytest.approx(2 / math.comb(80, 40), rel=1e-9)
    assert exact.signed_rank([2 * i for i in range(1, 61)], [1] * 60, 0) == pytest.approx(2 / 2.0**60, rel=1e-9)


def test_counts_meet_their_limits():
    for d in (0.02,):
        n = 10_000
        assert exact.kolmogorov(n, n, round(d * n * n)) == pytest.approx(cdf.kolmogorov_sf(d * math.sqrt(n / 2)), rel=0.02)
    n = 100
    ranks = [2 * i for i in range(1, 2 * n + 1)]
    u = 5_700
    z = (abs(u - n * n / 2) - 0.5) / math.sqrt(n * n * (2 * n + 1) / 12)
    assert exact.rank_sum(n, ranks, [1] * (2 * n), 2 * u + n * (n + 1)) == pytest.approx(2 * cdf.norm_sf(z), rel=0.02)
    z = (56_000 - 500 * 501 / 4) / math.sqrt(500 * 501 * 1001 / 24)
    assert exact.signed_rank([2 * i for i in range(1, 501)], [1] * 500, 2 * 56_000) == pytest.approx(2 * cdf.norm_sf(abs(z)), rel=0.05)


def test_method_is_an_argument_and_large_groups_have_no_exact_p(spark):
    rows = [(k, "ab"[i % 2], float((i * 7) % 11), float(i % 5)) for k, n in (("small", 14), ("large", 40)) for i in range(n)] + [("one", "a", 1.0, 1.0), ("none", "a", None, None)]
    df = spark.createDataFrame(rows, "k string, g string, v double, w double")
    got = {r["k"]: r for r in G.rank_tests(df, "g", "a", "b", "v", ["k"], method="exact", largest=20, largest_ks=10).collect()}
    a, b = ([r[2] for r in rows if r[0] == "small" and r[1] == g] for g in "ab")
    ranks = doubled_midranks(a + b)
    sums = [sum(c) for c in itertools.combinations(ranks, len(a))]
    assert got["small"]["u_p"] == pytest.approx(two_sided(sums, sum(ranks[: len(a)])))
    assert got["small"]["ks_p"] is not None and got["large"]["u_p"] is None and got["large"]["ks_p"] is None and got["one"]["u_p"] is None
    paired = {r["k"]: r["p"] for r in G.signed_rank(df, "v", "w", ["k"], method="exact", largest=20).collect()}
    assert 0 < paired["small"] <= 1 and paired["large"] is None
    assert all(r["u_p"] is not None for r in G.rank_tests(df.where("k = 'large'"), "g", "a", "b", "v").collect())
    with pytest.raises(ValueError):
        G.rank_tests(df, "g", "a", "b", "v", method="auto")
    with pytest.raises(ValueError):
        G.signed_rank(df, "v", "w", method="auto")
