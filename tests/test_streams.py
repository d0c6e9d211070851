"""Streams give what a batch over the same rows gives, whatever comes when and however often a run breaks off."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import clean as C
from cohortlens.sources import comments as IO
from cohortlens.streaming import ingest as ST

LONG = "a text that is long enough to stay "


def copies(seed):
    """Files of raw comments in which ids repeat inside a file and between files."""
    rng = random.Random(seed)
    files = {f"part{k}.json": [] for k in range(4)}
    for _ in range(120):
        row = {"id": f"c{rng.randrange(30)}", "author": rng.choice(["ann", "bob", "AutoModerator"]), "created_utc": 1_700_000_000 + rng.randrange(3),
               "body": rng.choice(["short", LONG + rng.choice("xyz"), LONG + "w" * rng.randrange(20)]), "subreddit": "s"}
        files[rng.choice(list(files))].append(row)
    return files


@pytest.mark.parametrize("order, per_trigger", [([0, 1, 2, 3], 4), ([0, 1, 2, 3], 1), ([3, 1, 0, 2], 1), ([2, 3, 1, 0], 2)])
def test_first_copies_in_one_and_in_several_batches(spark, tmp_path, order, per_trigger):
    files = copies(5)
    (tmp_path / "in").mkdir()
    for time, k in enumerate(order):  # the stream takes files by their age
        name = tmp_path / "in" / f"part{k}.json"
        name.write_text("\n".join(map(json.dumps, files[name.name])))
        os.utime(name, (1_600_000_000 + time,) * 2)
    query = ST.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "30 days", per_trigger)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4 // per_trigger
    raw = IO.read_jsonl(spark, str(tmp_path / "in"))
    batch = C.dedupe(C.standardise(raw, ["_file"]), ST.COPY_ORDER).where(C.is_person() & C.has_quality_text())
    columns = sorted(C.COMMENT_COLUMNS)
    want = sorted(map(str, batch.select(*columns).collect()))
    assert 5 < len(want) < 30
    assert sorted(map(str, ST.ingested(spark, str(tmp_path / "out")).select(*columns).collect())) == want


def test_state_covers_the_delay_only(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):  # twenty new ids a day
        rows = [{"id": f"d{k}-{i}", "author": "ann", "created_utc": 1_700_000_000 + 86_400 * k, "body": LONG, "subreddit": "s"} for i in range(20)]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(tmp_path / "in" / f"{k}.json", (1_600_000_000 + k,) * 2)
    query = ST.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "1 hour", 1)
    query.awaitTermination()
    held = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    assert max(held) < 3 * held[0]
    assert ST.ingested(spark, str(tmp_path / "out")).count() == 80


@pytest.fixture
def days(spark, tmp_path):
    """Nine small files of scores over three days, some of them late."""
    rng = random.Random(3)
    rows = [(f"2024-01-0{rng.randrange(1, 4)} {rng.randrange(24):02d}:00:00", rng.choice("ab"), rng.randrange(6)) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, subreddit string, score int").select(F.to_timestamp("t").alias("ts"), "subreddit", "score")
    df.repartition(9).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    return stream, sorted(map(tuple, ST.period_scores(df).collect())), str(tmp_path / "out"), str(tmp_path / "state")


def test_periods_after_a_restart_in_the_middle(spark, days, monkeypatch):
    stream, want, target, state = days
    calls, sums = [], ST.period_sums

    def breaks(*args):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return sums(*args)

    monkeypatch.setattr(ST, "period_sums", breaks)
    with pytest.raises(Exception, match="lost"):
        ST.upsert_periods(stream, target, state).awaitTermination()
    monkeypatch.undo()
    some = sum(r.n for r in ST.periods(spark, target).collect())
    assert 0 < some < sum(r[2] for r in want)
    # what a broken writer leaves: files of the third batch without the mark of a complete one
    spark.createDataFrame([("2024-01-01", "a", 999, 1.0, 9)], "period string, subreddit string, n long, sum double, max int").write.parquet(f"{target}/batch/{2:012d}")
    os.remove(f"{target}/batch/{2:012d}/_SUCCESS")
    assert sum(r.n for r in ST.periods(spark, target).collect()) == some
    ST.merge_periods(spark, target)
    ST.upsert_periods(stream, target, state).awaitTermination()
    assert sorted(map(tuple, ST.periods(spark, target).collect())) == want


def test_merged_periods_stay_the_same(spark, days):
    stream, want, target, state = days
    with pytest.raises(FileNotFoundError):
        ST.periods(spark, target)
    ST.upsert_periods(stream, target, state).awaitTermination()
    for _ in range(2):
        ST.merge_periods(spark, target)
        assert sorted(map(tuple, ST.periods(spark, target).collect())) == want
    assert len(os.listdir(f"{target}/merged")) == 1 and not os.listdir(f"{target}/batch")
