"""Text features on hand-made rows, and against plain Python written from the rules."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import lexicons as L, scalar as S, text as T
from cohortlens.operators import clean as C, demographics as D, rollup as R, scoring as SC


def column(spark, texts, expr):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    return [r[0] for r in rows.orderBy("i").select(expr).collect()]


def test_prefilter(spark):
    texts = ["", "short", "two words here?", "one twothreefour", "the app has a bug", "she is nice to me", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    got = [r.prefilter.reason for r in T.with_prefilter(rows).orderBy("i").collect()]
    assert got == ["empty", "too_short", "needs_scoring", "too_few_words", "technical_only", "needs_scoring", "empty"]


def test_attribution(spark):
    texts = ["She gets jealous", "I am really sad today", "She gets jealous and I am sad", "nice weather", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string")
    got = T.with_attribution(rows).orderBy("i").select("attribution_type", "bot_attribution_score").collect()
    assert [r[0] for r in got] == ["bot", "self", "mixed", "none", "none"]
    assert [round(r[1], 6) for r in got] == [0.4, 0.0, 0.5, 0.0, 0.0]


def test_ngrams(spark):
    rows = spark.createDataFrame([(0, "she decided to surprise me"), (1, "cleared the cache"), (2, ""), (3, None)], "i int, body string")
    got = {r.i: r for r in T.with_ngram_features(rows).collect()}
    assert got[0].ngram_agency > 0 and got[0].ngram_net_signal == 1
    assert got[1].ngram_technical > 0 and got[1].ngram_net_signal == -1
    for i in (2, 3):
        assert all(v == 0 for k, v in got[i].asDict().items() if k.startswith("ngram_"))


def test_age(spark):
    texts = ["I'm 16 years old", "23M", "(F19)", "turned 12, age 40", "as a 99", None]
    low = S.declaration_text(F.col("body"))
    assert column(spark, texts, S.declared_age(low)) == [16, 23, 19, 40, None, None]
    assert column(spark, ["back when I was 15"], S.declared_age(low)) == [15]
    assert column(spark, ["back when I was 15"], S.declared_age(low, strict=True)) == [None]


def test_gender(spark):
    low = S.declaration_text(F.col("body"))
    texts = ["23M", "she/her", "they/them", "I'm 20", "hello"]
    assert column(spark, texts, S.declared_gender(low)) == ["male", "female", "nonbinary", "male", None]
    assert column(spark, ["I'm 20", "that girl over there"], S.declared_gender(low, strict=True)) == [None, None]


def test_buckets(spark):
    ages = [12, 13, 18, 19, 25, 26, 40, 41, 60, 61, 80, 81]
    rows = spark.createDataFrame([(a,) for a in ages], "a int")
    got = [r[0] for r in rows.select(S.age_bucket(F.col("a"))).collect()]
    assert got == ["unknown"] + [b for b, _, _ in L.AGE_BUCKETS for _ in range(2)] + ["unknown"]


def test_flair_wins_and_first_non_null(spark):
    rows = spark.createDataFrame(
        [("a", "hi", None, 1, "x"), ("a", "I'm 30 years old", "22F", 2, "y"), ("a", "I'm 40 years old", None, 3, "z")],
        "author string, body string, author_flair_text string, created_utc long, id string",
    )
    r = D.user_declarations(rows).head()
    assert (r.age_self_declared, r.age_bucket_self_declared, r.gender_self_declared) == (22, "19-25", "female")


# ---- slang and entities against the sequential rules ----------------------------------------


def slang_by_passes(text: str) -> str:
    for key in sorted(L.SLANG, key=len, reverse=True):
        form = L.SLANG[key]
        text = re.sub(
            r"\b" + re.escape(key) + r"\b",
            lambda m: form[0].upper() + form[1:] if m.group(0)[0].isupper() else form,
            text,
            flags=re.IGNORECASE,
        )
    return text


def entities_by_passes(text: str) -> str:
    for v in sorted(L.ENTITY_VARIANTS, key=len, reverse=True):
        text = re.sub(r"\b" + re.escape(v) + r"\b", L.ENTITY_TOKEN, text, flags=re.IGNORECASE)
    return text


WORDS = ["my", "the", "ai", "AI", "Rep", "bot", "chat", "character", "companion", "friend", "bf", "u", "ur", "w/", "w/o", "Omg", "idk", "im",
         "aiê", "botç", "chai", "anima", "girlfriend", "c.ai", "hello", "2", "ya", "w"]
SEPS = [" ", " ", " ", ". ", "-", "/", "", "_", ", "]


def random_texts(n: int) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choice(WORDS) + rng.choice(SEPS) for _ in range(rng.randint(1, 10))) for _ in range(n)]


def test_slang_matches_sequential_passes(spark):
    batch = random_texts(2000)
    got = column(spark, batch, T.expand_slang(F.col("body")))
    assert [(t, g, slang_by_passes(t)) for t, g in zip(batch, got) if g != slang_by_passes(t)][:3] == []


def test_entities_match_sequential_passes(spark):
    batch = random_texts(2000)
    got = column(spark, batch, T.replace_entities(F.col("body")))
    assert [(t, g, entities_by_passes(t)) for t, g in zip(batch, got) if g != entities_by_passes(t)][:3] == []


def test_normalise(spark):
    assert column(spark, ["omggg my rep is soooo sweet \U0001F62D", "Hellooo   u"], T.normalise(F.col("body"))) == [
        "omgg my Replika is soo sweet", "Helloo you"
    ]


def test_entity_positions(spark):
    rows = spark.createDataFrame([("My rep and the bot, Rep!",)], "body string")
    got = {(o.start, o.end, o.variant) for o in T.with_entity_positions(rows).head().positions}
    low = "my rep and the bot, rep!"
    want = {(m.start(), m.end(), v) for v in L.ENTITY_VARIANTS for m in re.finditer(r"\b" + re.escape(v) + r"\b", low)}
    assert got == want


def test_markers_merge_keeps_counts(spark):
    text = "omg so cute!! i love my bf haha lol man dude wife so happy really sweet <3 awww fuck tbh the guy i feel nice very nice"
    for patterns in (L.FEMALE_MARKERS, L.MALE_MARKERS):
        want = sum(len(re.findall(p, text)) for p in patterns)
        assert column(spark, [text], T.hits(F.col("body"), T.merged(patterns), False)) == [want]


def test_display_and_annotation(spark):
    t = "see https://preview.redd.it/x.png and http://a.b/c\n\n\n\nbye"
    assert column(spark, [t], T.display_text(F.col("body"))) == ["see [image] and [link]\n\nbye"]
    assert column(spark, ["[a][b][c][d] " + "x" * 40, "x" * 30, "x" * 29], T.annotation_eligible()) == [False, True, False]


def test_masked_sentences(spark):
    got = column(spark, ["My bot is nice. The weather too! I like Replika?"], T.masked_sentences(F.col("body")))[0]
    assert got == ["<mask> is nice.", "I like <mask>?"]


def test_reply_parsing(spark):
    replies = ['{"score": 9, "r": "x"}', '{"score": 0}', '{"score": 3.7, "reasoning": "y"}', '{"score": "4"}', "junk", None]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, body string").orderBy("i")
    assert [r[0] for r in rows.select(T.parse_reply(F.col("body"))["score"]).collect()] == [5, 1, 3, 0, 0, 0]


def test_dominant(spark):
    rows = spark.createDataFrame([(0.2, 0.2, 0.1, 0.0, 0.0, 0.0, 0.0), (0.0,) * 7], ", ".join(f"emotion_{e} double" for e in L.EMOTIONS))
    assert [r[0] for r in rows.select(T.dominant("emotion_", "")).collect()] == ["joy", ""]


# ---- cleaning -------------------------------------------------------------------------------


def test_clean(spark, tmp_path):
    import json

    from cohortlens.sources import comments as IO

    def row(i, author="ann", body="a perfectly fine comment here", **kw):
        return json.dumps({"id": i, "author": author, "body": body, "created_utc": 1, "subreddit": "s", **kw})

    one = [row("1"), "{broken", "", row(""), row("2", "AutoModerator"), row("3", "[deleted]"), row("4", body="x" * 19), row("5", body="y" * 20),
           row("6", body="z" * 10000), row("7", body="z" * 10001), row("8", body="https://example.com/" + "q" * 50), row("1", body="second copy of the id"),
           json.dumps({"id": "9", "author": None, "body": "a perfectly fine comment"})]
    two = [row("1", body="copy in another file, later"), row("10")]
    (tmp_path / "a_comments.jsonl").write_text("\n".join(one))
    (tmp_path / "b_comments.jsonl").write_text("\n".join(two))
    raw = IO.read_jsonl(spark, str(tmp_path / "*_comments.jsonl"))
    got = {r.id: r.body for r in C.clean(raw).collect()}
    assert set(got) == {"1", "5", "6", "10"} and got["1"] == "a perfectly fine comment here"
    funnel = {r._file: r for r in C.funnel(raw).collect()}
    assert funnel["a_comments.jsonl"].initial_count == 11 and funnel["a_comments.jsonl"].final_count == 3
    bad = {r._file: r.malformed for r in IO.corrupt_counts(spark, str(tmp_path / "*_comments.jsonl")).collect()}
    assert bad == {"a_comments.jsonl": 1, "b_comments.jsonl": 0}


def test_merge_and_resume(spark, tmp_path):
    from cohortlens.sources import comments as IO

    old = spark.createDataFrame([("a", "s", 1)], "author string, subreddit string, count int")
    new = spark.createDataFrame([("a", "s", 9), ("b", "s", 2)], "author string, subreddit string, count int")
    path = str(tmp_path / "t")
    IO.write(old, path)
    target = IO.merge_save(spark, path, new)
    assert {(r.author, r["count"]) for r in spark.read.parquet(target).collect()} == {("a", 1), ("b", 2)}
    todo = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    done = spark.createDataFrame([("1", "model"), ("2", "error")], "id string, source string")
    assert {r.id for r in IO.pending(todo, done).collect()} == {"2", "3"}


def test_annotations_and_tables(spark, tmp_path):
    from cohortlens.sources import comments as IO

    (tmp_path / "s.csv").write_text('Item #,Comment Text,Subreddit,Your Score (1-5),reasoning,Your Confidence\n1,"two\nlines, ""quoted""",s,3.0,why,High\n2,x,s,9,,Low\n3,y,s,abc,,\n')
    got = {r["item"]: r for r in IO.read_annotations(spark, str(tmp_path / "s.csv"), "r1").collect()}
    assert got[1].score == 3 and got[1].text == 'two\nlines, "quoted"' and got[2].score is None and got[3].score is None
    (tmp_path / "t.json").write_text('{"body": "a"}\n{"body": null}\n')
    assert IO.read_text_table(spark, str(tmp_path / "t.json")).count() == 1


def test_rollup(spark):
    rows = spark.createDataFrame([("a", 3, "s"), ("b", 0, "s"), ("c", 1, "s"), ("c", 5, "t")], "author string, score int, subreddit string")
    got = {r.author: r for r in R.user_scores(rows).collect()}
    assert got["a"].score_std == 0 and "b" not in got and got["c"].score_mean == 3 and got["c"].communities == ["s", "t"]


def test_behaviour(spark):
    hours = [4, 5, 9, 14, 15]
    rows = spark.createDataFrame([("a", 1704499200 + 3600 * h, "s", "hello") for h in hours], "author string, t long, subreddit string, body string")
    r = R.behaviour(rows.withColumn("ts", F.timestamp_seconds("t"))).head()  # 2024-01-06 is a Saturday
    assert (r.late_night_ratio, r.school_hours_ratio, r.weekend_ratio, r.activity_span_days) == (0.2, 0.4, 1.0, 0)


def test_scorer_failures_are_recorded(spark):
    rows = spark.createDataFrame([("1", "she is nice to me today"), ("2", "short")], "id string, body string")

    def broken(texts):
        raise RuntimeError("down")

    got = {r.id: (r.score, r.source) for r in SC.score_with(rows, broken).collect()}
    assert got == {"1": (0, "error"), "2": (1, "prefilter")}


@pytest.mark.parametrize("parts", [1, 7])
def test_samples_do_not_depend_on_partitions(spark, parts):
    from cohortlens.operators import sampling as SM

    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 3).alias("g")).repartition(parts)
    ids = sorted(r.id for r in SM.stratified_sample(rows, "id", "g", 5).collect())
    assert len(ids) == 15 and ids == sorted(r.id for r in SM.stratified_sample(rows.repartition(3), "id", "g", 5).collect())
    folds = SM.folds(rows, "id", "g", 4)
    sizes = [r["count"] for r in folds.groupBy("g", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == 2000
    shuffled = SM.shuffled_column(rows.select("id", F.col("id").alias("v")), "id", "v")
    assert sorted(r.v for r in shuffled.collect()) == list(range(2000))


def test_branches_share_common_starts():
    """The pattern of n-grams has one branch per next letter and fits the terms alone, longest or shortest."""
    terms = sorted({t for group in (L.HUMANISING_NGRAMS, L.TOOL_NGRAMS) for pair in group.values() for side in pair for t in side})
    for side in (2, 3):  # at most one of a length starts at a word
        some = [t for t in terms if len(t.split()) == side]
        flat, shared = (re.compile(rf"(?<= )(?=({p}) )") for p in ("|".join(map(re.escape, some)), T._branches(some)))
        for text in (f" {x} " for t in terms for x in (t, t + "s", t[:-1], t[1:], f"{t} {t}")):
            assert shared.findall(text) == flat.findall(text)
    assert re.findall(rf"(?=({T._branches(['a', 'ab', 'b', 'abc d'])}) )", "abc d ") == ["abc d"] and T._branches(["me", "my"]) == "m(?:e|y)"
