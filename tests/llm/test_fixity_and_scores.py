from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
from cohortlens.llm import fixity, pseudolikelihood as L, words as W
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, digest string, file int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(3)


def test_audit_finds_every_damaged_record(spark, prose, rng):
    rows = [(i, f"http://h/{i}", prose(rng.randrange(1, 200))) for i in range(1500)] + [(7, "http://h/7", "again"), (7, "http://h/7", "again"), (None, None, None), (9001, "u", "")]
    a = fixity.store(pages(spark, rows))
    assert a.count() == len(rows) and a.groupBy("file").count().agg(F.max("count")).first()[0] <= fixity.FILE_RECORDS
    # offsets tile each file
    ends = {}
    for r in a.orderBy("file", "offset").collect():
        assert r.offset == ends.get(r.file, 0)
        ends[r.file] = r.offset + len(r.record.encode())
    assert fixity.audit(a, a).count() == 0
    b = a.where("record_id is null or record_id <> 33").withColumn("record", F.when(F.col("record_id").isin(5, 1499), F.concat(F.col("record").substr(F.lit(1), F.length("record") - 1), F.lit("x"))).otherwise(F.col("record")))
    got = {(r.record_id, r.kind): r for r in fixity.audit(a, b).collect()}
    assert set(got) == {(33, "missing"), (5, "changed"), (1499, "changed")}
    text = {r.record_id: r.record for r in a.where("record_id in (5, 33)").collect()}
    assert got[(5, "changed")].digest == hashlib.sha256(text[5].encode()).hexdigest() and got[(33, "missing")].found_digest is None
    assert {(r.record_id, r.kind) for r in fixity.audit(b, a).collect()} == {(33, "added"), (5, "changed"), (1499, "changed")}


def test_empty_stores(spark):
    one, none = fixity.store(pages(spark, [(1, "u", "x")])), fixity.store(pages(spark, [(1, "u", "x")]).limit(0))
    assert fixity.audit(none, none).count() == 0
    assert [r.kind for r in fixity.audit(one, none).collect()] == ["missing"] and [r.kind for r in fixity.audit(none, one).collect()] == ["added"]


def test_scores_prefer_the_order_of_the_corpus(frame, odd):
    rng = random.Random(3)
    follows = {w: f"w{(i * 7 + 3) % 60}" for i, w in enumerate(f"w{i}" for i in range(60))}

    def walk(n):
        w, out = f"w{rng.randrange(60)}", []
        for _ in range(n):
            out.append(w)
            w = follows[w] if rng.random() < 0.9 else f"w{rng.randrange(60)}"
        return " ".join(out)

    rows = [(i, walk(400)) for i in range(300)]
    model = L.fit(frame(rows + odd), batch_words=512)
    held = [walk(400) for _ in range(8)]
    shuffled = [" ".join(rng.sample(t.split(), 400)) for t in held]
    tests = [(1000 + i, t) for i, t in enumerate(held)] + [(2000 + i, t) for i, t in enumerate(shuffled)] + odd
    got = {r.doc_id: r for r in L.score(frame(tests), model).collect()}
    assert min(got[1000 + i].mean_log_likelihood for i in range(8)) > max(got[2000 + i].mean_log_likelihood for i in range(8)) + 0.5
    assert all(abs(got[k].mean_log_likelihood * got[k].n_words - got[k].log_likelihood) < 1e-6 for k in (1000, 2000, 906))
    for k in (900, 901, 902):
        assert (got[k].n_words, got[k].log_likelihood, got[k].mean_log_likelihood) == (0, 0.0, None)
    assert L.pseudo_likelihood(frame([(1, None), (2, "")])).agg(F.sum("log_likelihood")).first()[0] == 0.0
    assert L.pseudo_likelihood(frame([])).count() == 0


def test_probabilities_sum_to_one_and_gradient_steps_help():
    net = L.Network(200)
    rng = np.random.default_rng(0)
    net.load(net.flat() + np.concatenate([rng.normal(0, 0.3, w.size) for w in net.weights]) * (net.flat() > -1e8))
    context = rng.integers(0, 201, (5, 4))
    every = np.stack([net.log_probability(context, np.full(5, t)) for t in range(200)])
    assert np.allclose(np.exp(every).sum(axis=0), 1, atol=1e-4)
    context, target = rng.integers(0, 201, (64, 4)), rng.integers(0, 200, 64)
    before = net.log_probability(context, target).mean()
    memory = [np.full(s, 1e-8, np.float32) for s in net.shapes]
    for _ in range(20):
        net.train(context, target, memory, 0.1)
    assert net.log_probability(context, target).mean() > before + 1


def zipf(rng, n):
    return [f"v{int(1.003 ** (rng.random() * 2600))}" for _ in range(n)]


def test_partitions_have_no_influence(frame, rng, odd):
    docs = frame([(i, " ".join(zipf(rng, 300))) for i in range(120)] + [(500, "rareone raretwo " * 3)] + odd)
    models = [L.fit(docs.repartition(k), shard_words=3000) for k in (2, 9)]
    assert np.array_equal(models[0].weights, models[1].weights)
    assert not np.array_equal(models[0].weights, L.Network(models[0].vocabulary.symbols).flat())
    got = [{(r.doc_id, r.n_words): r.log_likelihood for r in L.score(docs.repartition(k), m).collect()} for k, m in zip((2, 9), models, strict=True)]
    # the same but for the rounding of single precision over blocks of other sizes
    assert got[0].keys() == got[1].keys() and all(abs(x - got[1][k]) <= 1e-4 * max(1, abs(x)) for k, x in got[0].items())


def test_scores_against_plain_loops_and_unseen_words(frame, rng):
    rows = [(i, " ".join(zipf(rng, 400))) for i in range(100)] + [(200 + i, f"rare{i} " * 2) for i in range(40)]
    model = L.fit(frame(rows))
    texts = [rows[0][1][:200], "one", *[f"rare{i}" for i in range(40)], *[f"never{i}" for i in range(40)]]
    got = {r.doc_id: r.log_likelihood for r in L.score(frame(list(enumerate(texts))), model).collect()}
    known, net = model.vocabulary, L.Network(model.vocabulary.symbols)
    net.load(model.weights)
    tables, class_out, class_bias, word_out, word_bias = (w.astype(float) for w in net.weights)

    counts = {}
    for _, t in rows:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    number = lambda w: int(W.of_texts(pa.array([w])).hashes()[0])
    hashes = {w: number(w) for w in counts}
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    top = sorted(counts, key=lambda w: (-counts[w], signed(hashes[w])))[: L.VOCABULARY]
    ids = {w: k for k, w in enumerate(top)}
    others = [w for w in counts if w not in ids]

    def identity(w):
        return ids.get(w, len(top) + number(w) % L.BUCKETS)

    def log_softmax(x, k):
        return x[k] - x.max() - np.log(np.exp(x - x.max()).sum())

    def plain(text):
        words, total = text.split(), 0.0
        for i, w in enumerate(words):
            h = np.zeros(L.HIDDEN)
            for p, k in enumerate((-2, -1, 1, 2)):
                h += tables[p][identity(words[i + k]) if 0 <= i + k < len(words) else known.symbols]
            h, target = np.tanh(h), identity(w)
            group, place = divmod(target, L.CLASS_SIZE)
            part = slice(group * L.CLASS_SIZE, (group + 1) * L.CLASS_SIZE)
            total += log_softmax(class_out @ h + class_bias, group) + log_softmax(word_out[part] @ h + word_bias[part], place)
            if w not in ids:
                same = [x for x in others if hashes[x] % L.BUCKETS == number(w) % L.BUCKETS]
                total += np.log((counts.get(w, 0) + 0.5) / (sum(counts[x] for x in same) + 0.5 * (len(same) + 1)))
        return total

    assert all(abs(got[k] - plain(t)) < 1e-3 * max(1, len(t.split())) for k, t in enumerate(texts))
    seen, unseen = [got[2 + i] for i in range(40)], [got[42 + i] for i in range(40)]
    assert np.mean(unseen) < np.mean(seen) - 0.5


def test_rare_words_share_their_bucket():
    words, listed = np.arange(5, dtype=np.uint64) * np.uint64(7) + np.uint64(10_000), np.array([512, 1024, 513], np.uint64)
    tail, tail_words = np.zeros(L.BUCKETS), np.zeros(L.BUCKETS)
    tail[0], tail_words[0] = 6, 4
    known = L.Vocabulary(words, listed, np.array([9, 3, 2]), tail, tail_words)
    hashes = np.array([512, 1024, 1536, 513, 1, 2], np.uint64)
    share = np.exp(known.log_shares(hashes, known.ids(hashes)))
    assert np.allclose(share[0] + share[1] + 5 * share[2], 1) and np.allclose(share[3] + share[4], 1) and np.isclose(share[5], 1)
    assert share[0] > share[1] > share[2] and share[3] > share[4]
