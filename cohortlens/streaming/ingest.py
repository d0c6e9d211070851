"""Incremental ingest and per-period scores with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cohortlens.operators.clean import COMMENT_COLUMNS, dedupe, has_quality_text, is_person, standardise
from cohortlens.sources.comments import RAW_SCHEMA, complete_folders, remove_folder

#: The order in which copies of an id count: the first of these is the copy that stays.
COPY_ORDER = ("created_utc", "_file", "author", "body")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def comment_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Well-formed comments from JSON line files as they arrive, with the name of their file."""
    raw = (
        spark.readStream.schema(RAW_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("_file"))
    )
    return raw.where(F.col("_corrupt").isNull() & F.col("id").isNotNull())


class FirstCopy(StatefulProcessor):
    """Per id, the order of the earliest copy so far; a copy before it goes out, all others stop here.

    The order is held in a value state until a timer fires ``delay_ms`` after the copy's own time, so the state covers the
    delay and does not grow with the stream.
    """

    def __init__(self, order: Sequence[str], schema: T.StructType, delay_ms: int):
        self.order, self.delay_ms = tuple(order), delay_ms
        self.schema = T.StructType([schema[c] for c in order])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)

    def _rank(self, row) -> tuple:
        return tuple((v is not None, v) for v in row)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: self._rank(r[c] for c in self.order))
        rank = self._rank(first[c] for c in self.order)
        if self.best.exists():
            if self._rank(self.best.get()) <= rank:
                return
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.best.update(tuple(first[c] for c in self.order))
        self.handle.registerTimer(int(first["event_time"].timestamp() * 1000) + self.delay_ms)
        yield first

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_copies(comments: DataFrame, delay: str = "7 days", order: Sequence[str] = COPY_ORDER) -> DataFrame:
    """Standardised copies, each the earliest of its id so far, with ``kept``: whether it passes the filters.

    Files may come in any order, in one batch or in several: when an earlier copy comes after a later one, both are in the
    result, and ``ingested`` takes the earlier.  A copy that the filters drop is there too, as it lets no later one in.
    """
    std = standardise(comments, [c for c in order if c.startswith("_")]).withColumn("event_time", F.timestamp_seconds("created_utc"))
    ms = int(std.sparkSession.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {delay}) AS BIGINT)").first()[0])
    firsts = std.withWatermark("event_time", delay).groupBy("id").transformWithState(FirstCopy(order, std.schema, ms), std.schema, "append", "eventTime")
    return firsts.withColumn("kept", is_person() & has_quality_text())


def ingest(spark: SparkSession, path: str, target: str, checkpoint: str, delay: str = "7 days", files_per_trigger: int = 1000) -> StreamingQuery:
    """Append first copies to Parquet; available files only, restartable from the checkpoint.  Read them with ``ingested``."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (
        first_copies(comment_stream(spark, path, files_per_trigger), delay)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def ingested(spark: SparkSession, target: str, order: Sequence[str] = COPY_ORDER) -> DataFrame:
    """The comments of an ingest: the first copy of each id over all batches, if it passed the filters."""
    return dedupe(spark.read.parquet(target), order).where("kept").select(*COMMENT_COLUMNS)


def period_scores(df: DataFrame, ts: str = "ts", score: str = "score", community: str = "subreddit", width: str = "1 day") -> DataFrame:
    """Mean score per period and community of a table."""
    return _means(period_sums(df, ts, score, community, width), community)


def period_sums(df: DataFrame, ts: str, score: str, community: str, width: str) -> DataFrame:
    """(period, community, n, sum, max) of the valid scores."""
    sums = df.where(F.col(score) > 0).groupBy(F.window(ts, width).alias("_w"), community)
    sums = sums.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(score).cast("double")).alias("sum"), F.max(score).alias("max"))
    return sums.select(F.col("_w.start").alias("period"), community, "n", "sum", "max")


def _means(sums: DataFrame, community: str) -> DataFrame:
    return sums.select("period", community, "n", (F.col("sum") / F.col("n")).alias("mean"), "max")


def upsert_periods(stream: DataFrame, target: str, checkpoint: str, ts: str = "ts", score: str = "score", community: str = "subreddit", width: str = "1 day") -> StreamingQuery:
    """Keep per-period sums of a stream in ``target``; read them with ``periods``.

    Every micro-batch writes its own sums under its number, replacing what an earlier try of that number left, so a retry or
    a restart changes nothing.  No watermark: late scores count, and open periods are there as far as they have come.  A
    target belongs to one checkpoint.
    """

    def save(batch: DataFrame, number: int) -> None:
        period_sums(batch, ts, score, community, width).write.mode("overwrite").parquet(f"{target}/batch/{number:012d}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, target: str) -> tuple[list[str], list[str]]:
    """(merged sums, batches after them): complete folders that make up the table; what a merge replaced is left out."""
    merged = complete_folders(spark, f"{target}/merged")[-1:]
    upto = merged[0].rsplit("/", 1)[1] if merged else ""
    return merged, [b for b in complete_folders(spark, f"{target}/batch") if b.rsplit("/", 1)[1] > upto]


def _added(spark: SparkSession, folders: Sequence[str], community: str) -> DataFrame:
    sums = spark.read.parquet(*folders).groupBy("period", community)
    return sums.agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("max").alias("max"))


def periods(spark: SparkSession, target: str, community: str = "subreddit") -> DataFrame:
    """Mean score per period and community over all batches that were saved whole."""
    merged, batches = _parts(spark, target)
    if not merged + batches:
        raise FileNotFoundError(f"no complete batch under {target}")
    return _means(_added(spark, merged + batches, community), community)


def merge_periods(spark: SparkSession, target: str, community: str = "subreddit") -> None:
    """Add the batches so far up into one folder and remove them; the sums stay the same, the files become few.

    The merged folder has the number of the last batch in it and counts once it is complete, so that a reader or a second
    call after a failure finds either the batches or their sum.
    """
    merged, batches = _parts(spark, target)
    if batches:
        _added(spark, merged + batches, community).write.mode("overwrite").parquet(f"{target}/merged/{batches[-1].rsplit('/', 1)[1]}")
    newest = complete_folders(spark, f"{target}/merged")[-1:]
    if newest:
        upto = newest[0].rsplit("/", 1)[1]
        for old in complete_folders(spark, f"{target}/merged")[:-1] + [b for b in complete_folders(spark, f"{target}/batch") if b.rsplit("/", 1)[1] <= upto]:
            remove_folder(spark, old)
