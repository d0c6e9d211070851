from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from cohortlens.llm import decontaminate as D, words as W


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_planted_passages_and_clean_documents(spark, frame, prose, rng, odd):
    items = [(i, prose(rng.randrange(14, 60))) for i in range(30)] + [(98, None), (99, "too short")]
    rows, want = [], set()
    for i in range(120):
        text = prose(rng.randrange(5, 300)).split()
        if i % 2:
            k = rng.randrange(30)
            passage = items[k][1].split()
            edits = 0
            while rng.random() < 0.7 and edits < int(0.1 * len(passage)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["other"], [passage[at], "more"]])
                edits += 1
            if i % 3 == 0:
                passage = [w.upper() + "!!" for w in passage]
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
            want.add((i, k))
        rows.append((i, " ".join(text)))
    docs, benchmark = frame(rows + odd), spark.createDataFrame(items, "item_id long, text string")
    got = D.matches(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    texts, asked = dict(rows), dict(items)
    for r in got:
        words = [w.strip("!").lower() for w in texts[r.doc_id].split()]
        assert distance(asked[r.item_id].split(), words[r.first_word : r.first_word + r.n_words]) == r.distance <= 0.2 * r.item_words
    clean = D.clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows + odd if d not in {x for x, _ in want})
    # the same through several slices of the benchmark
    assert {(r.doc_id, r.item_id) for r in D.matches(docs, benchmark, slice_words=300).collect()} == want


def test_nothing_to_search(spark, frame, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.matches(frame(odd), none).count() == 0
    assert D.clean_documents(frame(odd), none).count() == len(odd)
    assert D.matches(frame(odd).limit(0), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")).count() == 0


def test_embedding_keeps_close_sequences_close(prose):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, (200, 40), dtype=np.uint64)
    b = a.copy()
    b[:, 10] = 5
    far = rng.integers(0, 2**63, (200, 40), dtype=np.uint64)
    same = lambda x, y: (D.embed(x, 1) == D.embed(y, 1))[:, : 40 * D.REACH].mean()  # noqa: E731  behind that, walks have left the window
    assert same(a, a) == 1 and same(a, b) > 0.7 and same(a, far) < 0.2
    hit = (D.sampled_keys(a) == D.sampled_keys(b)).any(axis=1).mean()
    assert hit == 1.0 and not (D.sampled_keys(a) == D.sampled_keys(far)).any()


@pytest.mark.parametrize("n, trials", [(8, 40), (20, 40), (50, 40), (100, 20), (150, 20), (200, 20)])
@pytest.mark.parametrize("where", ["head", "tail", "even", "random", "mixed"])
def test_recall_at_the_full_budget(n, trials, where):
    rng = np.random.default_rng(n)
    words = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    edits, items, blocks = int(0.2 * n), [], []
    for _ in range(trials):
        item = words(n)
        changed = list(item)
        random = sorted(rng.choice(n, edits, replace=False).tolist())
        places = {"head": range(edits), "tail": range(n - edits, n), "even": [int((i + 0.5) * n / edits) for i in range(edits)]}.get(where, random)
        for k, at in reversed(list(enumerate(places))):
            kind = k % 3 if where == "mixed" else 0
            changed[at : at + 1] = [[f"z{at}"], [], [changed[at], f"z{at}"]][kind]
        items.append(W.of_texts(pa.array([" ".join(item)]), plain=True).hashes())
        blocks.append(W.of_texts(pa.array([" ".join(words(30) + changed + words(30))]), plain=True))
    benchmark = D.Benchmark(list(range(trials)), items, 0.2)
    assert sum(any(m[1] == k for m in benchmark.matches(b)) for k, b in enumerate(blocks)) >= 0.95 * trials
