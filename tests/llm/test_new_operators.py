"""Importance resampling, URL aliases and spelling variants against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cohortlens.llm import importance, spelling, urls


def features(text, n):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return words, [b" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute_importance(docs, target, n, percent, min_words):
    counts = [Counter(zlib.crc32(g) % 10_000 for _, text in rows for g in features(text, n)[1]) for rows in (docs, target)]
    s, t = counts
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for doc, text in docs:
        words, grams = features(text, n)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in (zlib.crc32(g) % 10_000 for g in grams)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    can = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    place = {id(r): i + 1 for i, r in enumerate(can[: len(can) * percent // 100])}
    return sorted((str(r[0]), *r[1:4], place.get(id(r), 0)) for r in out)


@pytest.mark.parametrize("n", [1, 3])
def test_importance_equals_brute_force(spark, frame, odd, prose, rng, n, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 7)
    docs = [*odd, *((i, prose(rng.randrange(5, 60))) for i in range(80)), (3, prose(40)), (901, "Ärger, Été! ABC")] + [(7, "same words " * 15)] * 3
    target = [(i, prose(30)) for i in range(5)] + [(9, None), (10, "")]
    got = importance.ranked(importance.scored(frame(docs), frame(target), n=n), percent=30, min_words=10)
    rows = got.select("row.doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((str(r[0]), *r[1:4], r[4] or 0) for r in rows) == brute_importance(docs, target, n, 30, 10)


def test_importance_draws_whole_documents_and_survives_empty_tables(spark, frame, prose):
    docs, target = frame([(i, prose(40)) for i in range(50)]), frame([(1, prose(50))])
    drawn = importance.resampled(docs, target, percent=20)
    assert drawn.columns == docs.columns and drawn.count() == 10
    assert importance.resampled(docs.limit(0), target).count() == 0
    assert importance.resampled(docs, target.limit(0), percent=20).count() == 10


def test_importance_prefers_the_target(spark, frame, rng):
    a, b = [f"aa{i}" for i in range(50)], [f"bb{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choice(a if i % 10 else b) for _ in range(60))) for i in range(500)]
    drawn = importance.resampled(frame(docs), frame([(0, " ".join(rng.choice(b) for _ in range(5000)))])).collect()
    assert len(drawn) == 50 and sum(r["doc_id"] % 10 == 0 for r in drawn) >= 45


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def canonical(target):
    return f'<html><head><LINK href="{target}" data-x=1 rel=\'canonical\'></head>'


PAGES = [
    (1, "https://a.example.com/en/1", None, "block"), (2, "https://www.example.com/en/1", "", "allow"), (3, "HTTP://WWW.Shop.COM/x?y", None, "allow"),
    (4, "http://notcom", None, "allow"), (5, None, None, "allow"), (6, "no scheme/en/", canonical("http://b.net/es/1"), "allow"),
    # aliases: two steps away from a blocked URL that is no page itself
    (10, "https://m.org/one", canonical("https://m.org/two"), "block"), (11, "http://m.org/two#top", '<meta http-equiv="refresh" content="0; url=/three?a=1&amp;utm_source=q">', "block"),
    (12, "https://m.org/three?a=1", '<meta property="og:url" content="http://b.net/es/gone">', "block"), (13, "https://m.org/three?a=2", None, "allow"),
    # an explicit allow in the set wins over the block
    (20, "https://k.org/x/y/z", canonical("../p/./q"), "allow"), (21, "https://k.org/x/p/q", canonical("http://b.net/es/2"), "allow"), (22, "http://k.org:80/x/p/q", canonical("//good.com/q"), "allow"),
    (23, "http://b.net/es/2", None, "block"),
    # links that are no links
    (30, "https://z.org/a", '<link rel="stylesheet" href="http://b.net/es/3"><a rel="canonical" href="http://b.net/es/3">', "allow"), (31, "https://z.org/b", canonical("mailto:x@b.net"), "allow"),
    (32, "https://z.org/c", canonical("#here"), "allow"), (33, "https://z.org/d", canonical("https://z.org/d"), "allow"), (34, "http://l.org/" + "a." * 30_000, None, "allow"),
    (35, "http://" + "a." * 30_000 + "net/es/", None, "block"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r[:3], "h", "mine", 1) for r in rows], "page_id long, url string, html string, host string, key string, _rules int").repartition(3)


def test_url_rules_and_aliases(spark):
    got = urls.judge(pages(spark, PAGES + PAGES[:3]), urls.rule_table(spark, RULES))
    assert got.columns == ["page_id", "url", "html", "key", "_rules", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert len(rows) == len(PAGES) + 3
    assert {r["page_id"]: r["verdict"] for r in rows} == {p[0]: p[3] for p in PAGES}
    by = {r["page_id"]: r for r in rows}
    assert (by[3]["host"], by[3]["path"], by[3]["rule"]) == ("www.shop.com", "/x", "com/")
    assert (by[5]["host"], by[5]["path"], by[5]["rule"]) == ("", "", None) and by[2]["rule"] == "www.example.com/en/"


def test_url_sql_finds_the_same_aliases(spark):
    import duckdb

    from cohortlens.llm.queries import URL_RULES, URL_SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [p[:3] for p in PAGES])
    got = urls.judge(pages(spark, PAGES), urls.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(URL_SQL).fetchall(), key=str)


def test_redirects_from_a_log_and_a_hub(spark):
    rows = [(i, f"http://s{i}.org/{i}", None) for i in range(300)]
    log = [(f"http://s{i}.org/{i}", "https://hub.org/") for i in range(0, 300, 2)] + [("https://hub.org/", "http://b.net/es/"), (None, "http://b.net/es/"), ("x", None)]
    got = urls.judge(pages(spark, rows), urls.rule_table(spark, RULES), spark.createDataFrame(log, "source string, target string"))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {i: "allow" if i % 2 else "block" for i in range(300)}
    assert urls.judge(pages(spark, []), urls.rule_table(spark, RULES)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages(spark, rows), urls.rule_table(spark, RULES).limit(0)).collect()} == {"allow"}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_spelling(docs, every, least=6, least_n=5, times=5):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if every and h % every == 0 else low] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= least_n}
    others = defaultdict(list)
    for a in n:
        for b in n:
            if a < b and near(a, b):
                others[a].append(b)
                others[b].append(a)
    form = {}
    for a in n:
        best = min(others[a], key=lambda b: (-n[b], b), default=None)
        form[a] = best if best and n[best] >= times * n[a] else None
    out = []
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, n[a], len(others[a]), form[a] or "", n[form[a]] if form[a] else 0, root))
    return sorted(out)


@pytest.mark.parametrize("every", [None, 7])
def test_spelling_equals_brute_force(spark, frame, odd, rng, every, monkeypatch):
    monkeypatch.setattr(spelling, "CHUNK", 50)
    letters = "abé÷"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 11))) for _ in range(60)]
    for _ in range(250):  # edits everywhere, edits of edits
        w = rng.choice(words)
        at = rng.randrange(len(w) + 1)
        words.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]]))
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "x" * 300 + "ab", "x" * 300 + "ac", "x" * 300 + "acd", "ABCdefÉ", "abcdefÉ", "abcdefé"]
    weight = [rng.choice([1, 2, 8, 60, 400]) for _ in words]
    docs = [*odd, *((i, " ".join(rng.choices(words, weight, k=rng.randrange(200, 1200)))) for i in range(120))]
    got = spelling.spelling_variants(frame(docs), typo_every=every).collect()
    want = brute_spelling(docs, every)
    assert sorted((r["word"], r["n"], r["n_near"], r["form"] or "", r["form_n"] or 0, r["root"]) for r in got) == want
    assert sum(w[2] for w in want) > 100 and any(w[5] not in (w[0], w[3]) for w in want)


def test_spelling_sends_no_table_through_the_driver(spark, frame, rng, monkeypatch):
    """Spark takes exploded words for as small as the words; only few states may be broadcast, by their own sum."""
    monkeypatch.setattr(spelling, "SENT", 0, raising=False)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, write = [], spelling.written
    monkeypatch.setattr(spelling, "written", lambda df, what: plans.append((what, plan(df))) or write(df, what))
    stems = ["".join(rng.choice("abc") for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(stems) for _ in range(60))) for i in range(20)]
    out = spelling.spelling_variants(frame(docs), typo_every=None)
    plans.append(("result", plan(out)))
    assert {what for what, _ in plans} >= {"trie", "frontier", "forms", "roots", "result"}
    assert [what for what, text in plans if "Broadcast" in text] == []
    assert sorted(map(str, map(tuple, out.select("word", "n").collect()))) == sorted(str((w, n)) for w, n in Counter(" ".join(t for _, t in docs).split()).items() if n >= 5)


def test_spelling_of_nothing(spark, frame, odd):
    assert spelling.spelling_variants(frame(odd).limit(0)).count() == 0
