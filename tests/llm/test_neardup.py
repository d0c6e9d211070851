from __future__ import annotations

import re
from itertools import combinations

from cohortlens.llm import nearduplicates as N

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((str(d), len(s), str(d if not s else least.get(root(i))), d == (d if not s else least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def planted(prose, rng):
    rows = []
    for g in range(12):
        base = prose(rng.choice([8, 40, 150, 400])).split()
        for k in range(rng.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 25, len(w) // 12])):
                w[rng.randrange(len(w))] = f"new{rng.random():.6f}"
            rows.append((1000 * rng.randrange(9) + len(rows), " ".join(w).title() if k == 3 else " ".join(w)))
    return rows


def test_against_all_pairs(frame, prose, rng, odd):
    rows = planted(prose, rng) + odd
    for size in (2, 5):
        got = N.near_duplicates(frame(rows), size=size).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, size)


def test_large_buckets_are_compared_in_tasks(frame, prose, rng):
    rows = planted(prose, rng)
    want = sorted((int(a), int(c)) for a, _, c, _ in brute(rows, 2))
    for options in ({"small": 1}, {"small": 1, "block": 2}, {"small": 1, "hot": 2, "block": 3}):
        assert sorted((r.doc_id, r.component_id) for r in N.near_duplicates(frame(rows), size=2, **options).collect()) == want


def test_group_near_the_threshold(frame, prose, rng):
    base = prose(120).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 16)):
            w[rng.randrange(len(w))] = f"new{rng.random():.6f}"
        rows.append((i, " ".join(w)))
    got = N.near_duplicates(frame(rows), size=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, 2)


def test_one_of_each_keeps_columns_and_wordless_rows(frame, prose, odd):
    text = prose(50)
    docs = frame([(5, text), (3, text + " tail"), (9, prose(60)), *odd])
    out = N.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 3 in ids and 5 not in ids and 9 in ids and {900, 901, 902} <= set(ids)
    assert ids.count(904) == 0 and ids.count(903) == 1  # 904 repeats the text of 903
    assert N.one_of_each(docs.limit(0)).count() == 0


def test_texts_under_one_id_are_judged_each(frame, prose):
    a, b, c, d = (prose(60) for _ in range(4))
    docs = frame([(7, a), (7, b + " much longer"), (7, a), (2, c), (8, c), (8, d), (9, ""), (9, prose(40)), (3, d + " end"), (4, b), (4, b + " x")])
    got = sorted((r.doc_id, r.text) for r in N.one_of_each(docs).collect())
    texts = {t: i for i, t in got}
    # 7 has two texts: a stays, the long one is a copy of 4's; 8 has a copy of 2's and of 3's; 9 has an empty one and its own
    assert texts[a] == 7 and texts[c] == 2 and texts[d + " end"] == 3 and texts[b] == 4 and len([1 for i, _ in got if i == 9]) == 2
    assert len(got) == 6
    only = frame([(1, a), (1, b), (1, c), (1, a + " tail")])
    assert sorted(r.text for r in N.one_of_each(only).collect()) == sorted([a, b, c])


def test_components_of_a_long_chain(spark):
    from cohortlens.llm.components import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (100, 101)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 105: 100, 101: 100}
