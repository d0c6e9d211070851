"""Target-distribution importance resampling over hashed word n-grams.

The texts of a batch are joined with a separator no word holds, one regex pass finds all words, ``searchsorted`` of their
places among the document offsets gives each word's document and so masks the n-grams that would run from one document
into the next; what is left is counted with ``bincount``.  Corpus and target each give a table of bucket counts, the two
give a gain per bucket, a document's weight is the mean gain of its features, and the highest weights plus Gumbel noise
are a sample without replacement in proportion to the weights.

Defined results: a null or empty text has no features, weight 0, and is not drawn; a text of any length is read whole, in
runs of ``CHUNK`` words; a document without id draws its noise from the empty id; equal scores are ranked by id (null last),
then by number of features and weight, so that repeated rows take neighbouring ranks; empty tables give gains of 0 and no
rows; other columns pass ``resampled`` untouched, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortlens.llm.shared import text_slices, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\n"
CHUNK = 1 << 18


def hashed_features(texts: list[bytes], n: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, document, bucket) arrays of all runs of k = 1 to ``n`` words that stay inside their document."""
    joined = SEPARATOR.join(texts).lower()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(sizes + len(SEPARATOR)) - sizes - len(SEPARATOR)
    found = WORD.finditer(joined)
    tail, tail_docs = [], np.zeros(0, np.int64)
    while matches := list(islice(found, CHUNK)):
        starts = np.fromiter((m.start() for m in matches), np.int64, len(matches))
        words = tail + [m.group() for m in matches]
        docs = np.concatenate([tail_docs, np.searchsorted(offsets, starts, side="right") - 1])
        grams = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        spaced = [b" " + w for w in words] if n > 1 else []
        for k in range(1, n + 1):
            if k > 1:  # a crc32 goes on where that of the shorter run ended
                grams = np.fromiter(map(zlib.crc32, spaced[k - 1 :], grams[:-1].tolist()), np.uint32, max(0, len(words) - k + 1))
            new = max(0, len(tail) - k + 1)
            first, last = docs[: len(words) - k + 1][new:], docs[k - 1 :][new:]
            inside = first == last
            yield k, first[inside], (grams[new:][inside] % buckets).astype(np.int64)
        tail, tail_docs = (words[-(n - 1) :], docs[-(n - 1) :]) if n > 1 else ([], docs[:0])


def bucket_counts(docs: DataFrame, n: int, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, count) over all texts; a task adds its batches up before anything moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, texts in text_slices(batches, text):
            for _, _, bucket in hashed_features(texts, n, buckets):
                total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int64()), "count": pa.array(total[seen], pa.int64())})

    counted = docs.select(F.col(text).alias(text)).mapInArrow(count, "bucket long, count long")
    return counted.groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(docs: DataFrame, target: DataFrame, n: int, buckets: int, text: str = "text") -> DataFrame:
    """(bucket, gain) for every bucket: 1000 times the log ratio of the smoothed shares in target and corpus, floored."""
    source = bucket_counts(docs, n, buckets, text).withColumnRenamed("count", "s")
    wanted = bucket_counts(target, n, buckets, text).withColumnRenamed("count", "t")
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(source, "bucket", "left").join(wanted, "bucket", "left")
    both = both.fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))
    return both.join(F.broadcast(totals)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def gumbel(key: Column, seed: int) -> Column:
    """1000 times a standard Gumbel draw, floored, decided by seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weighted(rows: DataFrame, gain: np.ndarray, n: int, text: str) -> DataFrame:
    """``rows`` (one struct column ``row``) with n_words, n_features and weight of the text inside."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, text, "row"):
            words, features, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for k, doc, bucket in hashed_features(texts, n, buckets):
                count = np.bincount(doc, minlength=len(texts))
                words += count if k == 1 else 0
                features += count
                total += np.bincount(doc, weights=gain[bucket], minlength=len(texts)).astype(np.int64)
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (words, features, weight))], ["row", "n_words", "n_features", "weight"])

    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("n_words long, n_features long, weight long").fields])
    return rows.mapInArrow(weigh, schema)


def scored(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, seed: int = 2024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``row`` (its columns), n_words, n_features, weight, score.

    The texts are read twice, once for the counts and once for the weights; between them only the gain of each bucket, a
    number of rows that ``buckets`` fixes, passes the driver.
    """
    gain = np.zeros(buckets)
    for r in gains(docs, target, n, buckets, text).collect():
        gain[r["bucket"]] = r["gain"]
    rows = weighted(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), gain, n, text)
    return rows.withColumn("score", F.col("weight") + gumbel(F.col(f"row.`{key}`"), seed))


def ranked(scores: DataFrame, percent: int = 10, min_words: int = 20, key: str = "doc_id") -> DataFrame:
    """``scores`` with rank: 1, 2, 3, ... for the drawn ``percent`` of the documents of ``min_words`` words, else null.

    A histogram of the whole-number scores (as many rows as the logarithms leave room for, some ten thousands) says how
    many documents lie above each score, so that only documents down to the last drawn score are sorted, score by score.
    """
    scores = written(scores, "scores")
    can = F.col("n_words") >= min_words
    histogram = scores.where(can).groupBy("score").agg(F.count(F.lit(1)).alias("here"))
    above = F.coalesce(F.sum("here").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = F.sum("here").over(Window.partitionBy(F.lit(0)))
    levels = histogram.select("score", above.alias("above"), F.floor(places * percent / 100).cast("long").alias("drawn")).where("above < drawn")
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col(f"row.`{key}`").asc_nulls_last(), "n_features", "weight"))
    place = F.col("above") + within
    top = scores.where(can).join(levels, "score").withColumn("rank", F.when(place <= F.col("drawn"), place)).drop("above", "drawn")
    rest = scores.where(~can).withColumn("rank", F.lit(None).cast("long"))
    low = scores.where(can).join(levels, "score", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return top.select(*scores.columns, "rank").unionByName(rest).unionByName(low)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, key: str = "doc_id", **options) -> DataFrame:
    """The drawn documents, with their own columns."""
    return ranked(scored(docs, target, key=key, **options), percent, min_words, key).where("rank IS NOT NULL").select("row.*")
