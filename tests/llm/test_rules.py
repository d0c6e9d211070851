from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from cohortlens.llm import language, licences, mixing, repetition, words

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeats, len(cover)


def test_counts_against_brute_force(frame, prose, odd):
    rows = [(1, prose(30)), (2, (prose(12) + "\n") * 4), (3, "a b c d e f g h i " * 3), (4, prose(25) + "\n" + prose(3) + "\n\n"), (5, "ä ö " * 40), *odd]
    for r in repetition.rules(frame(rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in repetition.rules(frame(rows)).collect()}
    assert kept[1] and not kept[2] and not kept[3]
    assert repetition.rules(frame([])).count() == 0


def test_longest_repeats_against_all_pairs():
    rng = random.Random(5)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(0, 40))] for _ in range(60)] + [["a"] * 50, []]
    block = words.of_texts(pa.array([" ".join(t) for t in texts]))
    got = repetition.longest_repeats(block.hashes(), block.first)
    for i, t in enumerate(texts):
        want = [max([0, *(next((k for k in range(len(t)) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), 0) for b in range(len(t)) if b != a)]) for a in range(len(t))]
        assert list(got[block.first[i] : block.first[i + 1]]) == want


def test_words_equal_the_pattern(prose):
    texts = [" a\x0bb\tc\n", None, "", "\x1fx\x85y z w", "é\r\nü  ", "n" * 600 + " tail", prose(50)]
    block = words.of_texts(pa.array(texts))
    raw = block.data.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(block.starts[a:b], block.ends[a:b])] for a, b in zip(block.first, block.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    h, flat = block.hashes(), [w for t in got for w in t]
    assert len(set(h.tolist())) == len(set(flat))


LANGS = {
    "aa": "kalo meti sora bani kato meri sola timo".split(), "bb": "schrunk plotz wurz brand knarx stolp".split(),
    "cc": "ñandu que había señor niño mañana".split(),
}


def test_languages_on_held_out_rows(frame, odd):
    rng = random.Random(1)
    make = lambda k: "".join(rng.choice(LANGS[k]) + rng.choice([" ", ", ", ".\n", "!! "]) for _ in range(rng.randrange(4, 200)))
    rows = [(i, make(k), k) for i in range(400) for k in [sorted(LANGS)[i % 3]]]
    out = language.identify(frame(rows + [(*r, None) for r in odd])).collect()
    want = {i: k for i, _, k in rows}
    held = [r for r in out if r.held_out and r.doc_id in want]
    assert len(held) > 50 and all(r.lang_pred == want[r.doc_id] for r in held)
    odd_ones = {r.doc_id: r for r in out if r.doc_id in (900, 901, 902, 908)}
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd_ones.values()) and len(odd_ones) == 4
    assert all(0 <= r.score <= 1 for r in out) and len(out) == len(rows) + len(odd)
    assert {r.lang_pred for r in language.identify(frame([(1, "abc"), (2, "x")])).collect()} == {"und"}
    docs = frame(rows + [(*r, None) for r in odd])
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id < 400").count() == 400 and kept.where("doc_id in (900, 901, 902, 908)").count() == 0


def test_letter_junk_is_no_language(frame):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    make = lambda k, n: " ".join(rng.choice(LANGS[k]) for _ in range(n))
    rows = [(i, make(k, rng.randrange(2, 100)), k) for i in range(400) for k in [sorted(LANGS)[i % 3]]]
    junk = [(1000 + i, " ".join("".join(rng.choice("qxwvjzkyfpg") for _ in range(rng.randrange(3, 9))) for _ in range(80)), None) for i in range(30)]
    docs = frame(rows + junk)
    measured = language.least_score(docs, language.learn(docs.where("doc_id % 4 < 3")))
    for least in (measured, language.LEAST):
        kept = {r.doc_id for r in language.keep_identified(docs, least).collect()}
        assert set(range(400)) <= kept and not kept & {j[0] for j in junk}
    assert letters == "".join(sorted(language._ORDER[1])) and language.keep_identified(frame(junk)).count() == 0


def test_licence_sql_on_wrapped_texts(spark, frame):
    """Signs that line ends cut in two: the SQL, which has no signs, finds what the operator finds."""
    import duckdb

    from cohortlens.llm.queries import LICENCE_SQL

    texts = ["Released under the\nMIT License.", "All rights\nreserved.", "This work is in the public\ndomain.", "Copyright (c)\n2020 A. Name", "Provided under\nCC BY 4.0.", "plain text", "", None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = licences.scan(frame(list(enumerate(texts)))).select("doc_id", "n_known", "licences", "category").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(LICENCE_SQL).fetchall())


def test_grams_against_counting():
    texts = ["Ab, cd", "", "a\nb", "12 ñÑ!", "漢 x"]
    owner, gram, n = language.counted_grams(pa.array(texts))
    got = [Counter() for _ in texts]
    for o, g, k in zip(owner.tolist(), gram.tolist(), n.tolist()):
        s = ""
        while g:
            s, g = chr(g & 0x1FFFFF).replace("\x01", "_") + s, g >> 21
        got[o][s] += k
    for t, c in zip(texts, got):
        want = Counter()
        for run in re.findall(r"[^\W\d_]+", t.lower()):
            p = f"_{run}_"
            want.update(run)
            want.update(p[i : i + 2] for i in range(len(p) - 1))
            want.update(p[i : i + 3] for i in range(len(p) - 2))
        assert c == want
    assert np.all(np.diff(owner) >= 0)


def test_licence_rules(frame, odd):
    mit = (
        "Copyright (c) 2020 Someone.\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and "
        "associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\n"
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\n"
        "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\n"
        "copies or substantial portions of the Software.\n"
    )
    rows = [
        (1, mit), (2, "Words first.\nReleased under the MIT License.\nmore"), (3, "All rights reserved\nno stop here"), (4, "All rights reserved."),
        (5, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."), (6, "nothing about it"), (7, "Copyright (c) 2021 X"),
        (8, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
        (9, "This work is licensed under the GNU General Public License, version 3."), *odd,
    ]
    got = {r.doc_id: (r.licences, r.category) for r in licences.scan(frame(rows)).collect()}
    assert got[1] == ("MIT", "permissive") and got[2] == ("MIT", "permissive") and got[3] == got[4] == ("Proprietary", "restricted")
    assert got[5] == ("CC-BY-NC-4.0,Apache-2.0", "restricted") and got[6] == got[7] == ("", "none") and got[8] == ("", "unclear")
    assert got[9] == ("GPL-3.0", "copyleft") and got[900] == got[906] == ("", "none")
    assert licences.scan(frame(rows)).count() == len(rows)
    assert all(re.search(licences.SIGNS, s.replace("under ", "licensed under ") if s.startswith("under") else s) for s in licences.SENTENCES)


def test_mix_meets_targets(frame, prose, rng, odd):
    rows = [(i, prose(rng.randrange(1, 60)), None, rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(1500)]
    rows += [(2000 + i, prose(20), None, "tiny") for i in range(3)] + [(*r, None, "odd") for r in odd[:8]]
    out = mixing.mixed_sizes(frame(rows)).collect()
    assert len(out) == len(rows) and all(r.taken <= 3 * r.size for r in out)
    size = {r.doc_id: (r.source_size, r.target) for r in out}
    total = sum(r.size for r in out)
    targets = dict(set(size.values()))
    assert abs(sum(targets.values()) - total) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in targets.items())
    taken = {}
    for r in out:
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    assert all(abs(taken[s] - t) <= 130 for s, t in targets.items()) and sum(taken.values()) <= total
    again = mixing.mixed_sizes(frame(rows)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in out)
    mixed = mixing.mixed_documents(frame(rows))
    assert mixed.columns == frame(rows).columns and mixed.where("source = 'tiny'").count() == 9
    assert mixing.mixed_sizes(frame([])).count() == 0
    clash = frame(rows).selectExpr("*", "size as _s", "size as _d", "size as _copies", "size as _copy", "size as _slice")
    again = mixing.mixed_documents(clash)
    assert again.columns == clash.columns and again.count() == mixed.count()


def test_signs_over_line_ends_and_hyphens(frame, prose):
    """Wrapped, widely spaced or hyphenated sentences are found like those on one line."""
    texts = {
        "Released under the\nGPLv3.": "GPL-3.0", "Provided under\nCC BY 4.0.": "CC-BY-4.0", "This work is in the public\ndomain.": "Public-Domain",
        "This work is in the public-domain.": "Public-Domain", "All rights\nreserved.": "Proprietary", "All  rights   reserved.": "Proprietary",
        "No part of this\npublication may be reproduced, distributed or transmitted in any form without permission.": "Proprietary",
        "Provided under the terms of" + " " * 60 + "\n the CC BY-SA 4.0.": "CC-BY-SA-4.0",
    }
    rows = [(i, f"{prose(12)}. {t} {prose(5)}.") for i, t in enumerate(texts)]
    out = {r.doc_id: (r.n_known, r.licences) for r in licences.scan(frame(rows)).collect()}
    assert out == {i: (1, name) for i, name in enumerate(texts.values())}
    assert all(re.search(licences.SIGNS, s.replace("under ", "provided under ") if s.startswith("under") else s) for s in licences.SENTENCES)
