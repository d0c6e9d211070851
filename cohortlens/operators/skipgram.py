"""Skip-gram vectors by negative sampling, trained in tasks on blocks of lists and averaged after each epoch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortlens.session import ensure_checkpoint_dir

#: Neighbouring items that share their context and their negative samples, and how many of these; groups of a step.
CENTRES, SAMPLES, GROUPS = 32, 22, 20
#: Negative samples a pair counts for.
NEGATIVE = 5
RATE = 0.025
#: A row that more terms than this meet in a step takes their mean so many times.
TERMS = 32
#: Items of a block of the model.
BLOCK = 4096
#: A row that a step meets more often is summed up first, others are added to one by one.
FEW = 8


def stepped(weights: np.ndarray, ids: np.ndarray, change: np.ndarray, terms: np.ndarray, rate: float) -> None:
    """Add to the rows ``ids`` what all terms of a step change in them."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    size = np.diff(np.append(first, len(ids)))
    scale = rate * np.minimum(1, TERMS / np.maximum(np.add.reduceat(terms[order], first), 1))
    change = change[order]
    change *= np.repeat(scale, size)[:, None].astype(np.float32)
    if size.max() > FEW:
        weights[ids[first]] += np.add.reduceat(change, first, axis=0)
        return
    for k in range(size.max()):  # the k-th of each row
        at = first[size > k] + k
        weights[ids[at]] += change[at]


def train(inner: np.ndarray, outer: np.ndarray, items: np.ndarray, owner: np.ndarray, window: int, rate: float, shares: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over ``items`` (numbers, in order of their lists, ``owner`` the list of each): every item predicts those at
    most 1 to ``window`` places (drawn for each item) before and behind it in its list."""
    n = len(items)
    around = np.arange(-window, CENTRES + window)
    away = np.abs(around[None, :] - np.arange(CENTRES)[:, None])
    right = np.concatenate([np.ones(len(around), np.float32), np.zeros(SAMPLES, np.float32)])
    step = CENTRES * min(GROUPS, max(len(shares) // (2 * CENTRES), 1))  # of few items, fewer at once
    for at in range(0, n, step):
        start = np.arange(at, min(at + step, n), CENTRES)
        centre, context = start[:, None] + np.arange(CENTRES), start[:, None] + around
        here, there = centre < n, (context >= 0) & (context < n)
        centre, context = np.minimum(centre, n - 1), np.clip(context, 0, n - 1)
        reach = rng.integers(1, window + 1, centre.shape)
        pairs = (away[None] <= reach[:, :, None]) & (away[None] > 0) & here[:, :, None] & there[:, None, :] & (owner[centre][:, :, None] == owner[context][:, None, :])
        drawn = np.searchsorted(shares, rng.random((len(start), SAMPLES)), side="right")
        a, b = items[centre], np.concatenate([items[context], np.minimum(drawn, len(shares) - 1)], axis=1)
        spread = pairs.sum(axis=2, dtype=np.float32) * np.float32(NEGATIVE / SAMPLES)
        weight = np.concatenate([pairs.astype(np.float32), np.broadcast_to(spread[:, :, None], (*a.shape, SAMPLES))], axis=2)
        x, y = inner[a], outer[b]
        pull = weight * (right - 1 / (1 + np.exp(-np.clip(x @ y.transpose(0, 2, 1), -30, 30))))
        to_x, to_y = pull @ y, pull.transpose(0, 2, 1) @ x
        stepped(inner, a.ravel(), to_x.reshape(-1, x.shape[2]), weight.sum(axis=2).ravel(), rate)
        stepped(outer, b.ravel(), to_y.reshape(-1, x.shape[2]), weight.sum(axis=1).ravel(), rate)


class Word2VecModel:
    def __init__(self, vectors: DataFrame):
        self.vectors = vectors

    def getVectors(self) -> DataFrame:  # noqa: N802 - the name of MLlib's models
        """word, vector (an array of doubles)."""
        return self.vectors


class Word2Vec:
    """Estimator with the parameters of MLlib's, which takes a hierarchical softmax; here as in the reference ``NEGATIVE``
    samples a pair, drawn by frequency to the power 0.75.

    A step goes over up to ``CENTRES * GROUPS`` items as products of matrices.  Every task trains on its lists from the model of the
    epoch before; an item's vectors are then averaged over the tasks that met it, a block of items at a time.  As MLlib's,
    the model (twice ``vectorSize`` floats an item) passes the driver once an epoch; lists never do.
    """

    def __init__(self, vectorSize: int, windowSize: int, minCount: int, maxIter: int, seed: int, numPartitions: int, inputCol: str, outputCol: str | None = None):  # noqa: N803
        self.size, self.window, self.least, self.epochs, self.seed = vectorSize, windowSize, minCount, maxIter, seed
        self.partitions, self.column = numPartitions, inputCol

    def fit(self, lists: DataFrame) -> Word2VecModel:
        spark, size, window, epochs, seed, column = lists.sparkSession, self.size, self.window, self.epochs, self.seed, self.column
        counts = lists.select(F.explode(column).alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        known = counts.where(F.col("n") >= self.least).orderBy(F.desc("n"), "word").toArrow()
        words, n = known.column("word").combine_chunks(), known.column("n").to_numpy()
        if not len(words):
            return Word2VecModel(spark.createDataFrame([], "word string, vector array<double>"))
        shares = np.cumsum(n**0.75) / np.sum(n**0.75)
        sent = spark.sparkContext.broadcast((words, shares))

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = sent.value[0]
            for batch in batches:
                column = batch.column(0)
                owner, number = pc.list_parent_indices(column), pc.index_in(column.flatten(), value_set=words)
                owner, number = owner.filter(number.is_valid()).to_numpy(), number.drop_null().to_numpy()
                first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(column)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(first), pa.array(number, pa.int32()))], ["items"])

        ensure_checkpoint_dir(spark)
        items = lists.select(F.col(column).cast("array<string>")).mapInArrow(numbered, "items array<int>").where("size(items) > 1")
        items = items.repartition(self.partitions).checkpoint()
        inner = np.random.default_rng(seed).random((len(words), size), np.float32) / size - np.float32(0.5 / size)
        outer = np.zeros_like(inner)
        for epoch in range(epochs):
            model = spark.sparkContext.broadcast((inner, outer))
            blocks = self._epoch(items, model, sent, epoch).checkpoint()
            model.unpersist()
            if epoch + 1 < epochs:
                for row in blocks.toLocalIterator():
                    at, met = row["block"] * BLOCK, np.frombuffer(row["met"], np.float32) > 0
                    for weights, part in ((inner, row["inner"]), (outer, row["outer"])):
                        weights[at : at + len(met)][met] = np.frombuffer(part, np.float32).reshape(len(met), size)[met]
        start = spark.sparkContext.broadcast(inner)

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, met, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    seen, at = np.frombuffer(met, np.float32) > 0, block * BLOCK
                    rows = np.where(seen[:, None], np.frombuffer(part, np.float32).reshape(len(seen), size), start.value[at : at + len(seen)])
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(seen) + 1, dtype=np.int32) * size), pa.array(rows.ravel().astype(np.float64)))
                    yield pa.RecordBatch.from_arrays([sent.value[0].slice(at, len(seen)), vectors], ["word", "vector"])

        return Word2VecModel(blocks.select("block", "met", "inner").mapInArrow(unpacked, "word string, vector array<double>"))

    def _epoch(self, items: DataFrame, model, sent, epoch: int) -> DataFrame:
        """block, met, inner, outer: the mean vectors of each block, and how many tasks met each of its items."""
        size, window, seed, rate = self.size, self.window, self.seed, RATE * (1 - epoch / self.epochs)
        schema = "block int, met binary, inner binary, outer binary"

        def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inner, outer = (weights.copy() for weights in model.value)
            rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
            met = np.zeros(len(inner), np.float32)
            for batch in batches:
                column = batch.column(0)
                flat, owner = column.flatten().to_numpy(), pc.list_parent_indices(column).to_numpy()
                if len(flat):
                    met[flat] = 1
                    train(inner, outer, flat, owner, window, rate, sent.value[1], rng)
            for at in range(0, len(met), BLOCK):
                parts = [v[at : at + BLOCK].tobytes() for v in (met, inner, outer)]
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], ["block", "met", "inner", "outer"])

        def mean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, total = None, None
            for batch in rows:
                for row in batch.to_pylist():
                    met, inner, outer = (np.frombuffer(row[k], np.float32) for k in ("met", "inner", "outer"))
                    if block is None:
                        block, total = row["block"], [np.zeros_like(met), np.zeros((len(met), size), np.float32), np.zeros((len(met), size), np.float32)]
                    total[0] += met
                    for k, part in ((1, inner), (2, outer)):
                        total[k] += part.reshape(len(met), size) * met[:, None]
            met = np.maximum(total[0], 1)[:, None]
            parts = [total[0].tobytes(), (total[1] / met).tobytes(), (total[2] / met).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], ["block", "met", "inner", "outer"])

        return items.mapInArrow(trained, schema).groupBy("block").applyInArrow(mean, schema)
