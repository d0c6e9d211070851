"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network predicts a word from two words on either side: each neighbour position has a table of vectors, their sum goes
through tanh into a two-level softmax (class of the word, word in the class).  A document's score is the sum of the
log-probabilities of all its words, each masked in turn.

Word counts and training cover all documents, and every word is a target once.  Documents fall into rounds and shards by a
hash; the number of shards follows the number of words.  A shard is trained in numpy from the weights of the round's start,
its documents in the order of their hash, and the weights of all shards, weighted by their targets, are averaged in groups
of ``GROUP``; only the averages, whose size the network fixes, reach the driver.  Neither partitions nor the
order of rows have an influence.

The network predicts the ``VOCABULARY`` most frequent words and, for all others, one of ``BUCKETS`` hash buckets.  A word of
a bucket has the bucket's probability times its smoothed share of the bucket's words.  Words that make up ``LISTED``
of all words or more (so at most 1 / ``LISTED`` of them) are listed with their own counts; the rarer words
of a bucket and one unseen word share their part alike.

Defined results: null and empty texts have no word, score 0.0 and a null mean; on a table without words every score is
0.0; repeated rows get the same score; rows equal in id and text are trained in one shard; a long text is read in blocks of
words of its own; other columns have no influence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import words as W
from cohortlens.llm.shared import written

VOCABULARY, BUCKETS, HIDDEN, SIDE = 2048, 512, 32, 2
CLASS_SIZE = 52
GROUP, CHUNK = 32, 4096
#: Least share of all words that gives a word a count of its own, and what is added to every count.
LISTED, SMOOTHING = 2.0**-22, 0.5
_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]


class Network:
    """Weights: ``tables`` (position, word, hidden), class and word outputs with biases."""

    def __init__(self, symbols: int):
        self.symbols, self.classes = symbols, -(-symbols // CLASS_SIZE)
        self.shapes = [(len(_OFFSETS), symbols + 1, HIDDEN), (self.classes, HIDDEN), (self.classes,), (self.classes * CLASS_SIZE, HIDDEN), (self.classes * CLASS_SIZE,)]
        rng = np.random.default_rng(13)
        self.weights = [(rng.standard_normal(s) * 0.05).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in self.shapes]
        self.weights[4][symbols:] = -1e9  # places of the last class without a word

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, s in enumerate(self.shapes):
            n = int(np.prod(s))
            self.weights[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.weights[0][0][context[:, 0]]
        for p in range(1, len(_OFFSETS)):
            total += self.weights[0][p][context[:, p]]
        return np.tanh(total, out=total)

    def _within(self, h: np.ndarray, group: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Scores of the words of each row's class; rows are sorted by class, whose rows begin at ``heads``."""
        out = self.weights[4].reshape(self.classes, CLASS_SIZE)[group]
        words = self.weights[3].reshape(self.classes, CLASS_SIZE, HIDDEN)
        for low, high in zip(heads, np.append(heads[1:], len(group)), strict=True):
            out[low:high] += h[low:high] @ words[group[low]].T
        return out

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, class_out, class_bias, _, _ = self.weights
        order = np.argsort(target // CLASS_SIZE, kind="stable")
        target, group = target[order], target[order] // CLASS_SIZE
        h = self.hidden(context[order])
        logs = _log_softmax_at(h @ class_out.T + class_bias, group)
        logs += _log_softmax_at(self._within(h, group, W.group_starts(group)), target - group * CLASS_SIZE)
        out = np.empty_like(logs)
        out[order] = logs
        return out

    def train(self, context: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rate: float) -> None:
        """One Adagrad step on the mean log-probability of a batch."""
        tables, class_out, class_bias, word_out, word_bias = self.weights
        order = np.argsort(target // CLASS_SIZE, kind="stable")
        context, target, group = context[order], target[order], target[order] // CLASS_SIZE
        n, every, heads = np.float32(len(target)), np.arange(len(target)), W.group_starts(group)
        h = self.hidden(context)
        d = _softmax(h @ class_out.T + class_bias)
        d[every, group] -= 1
        d /= n
        dh = d @ class_out
        steps = [(class_out, memory[1], d.T @ h), (class_bias, memory[2], d.sum(axis=0))]
        d = _softmax(self._within(h, group, heads))
        d[every, target - group * CLASS_SIZE] -= 1
        d /= n
        words, by_word = word_out.reshape(self.classes, CLASS_SIZE, HIDDEN), np.zeros((self.classes, CLASS_SIZE, HIDDEN), np.float32)
        by_bias = np.zeros((self.classes, CLASS_SIZE), np.float32)
        for low, high in zip(heads, np.append(heads[1:], len(target)), strict=True):
            k, part = group[low], d[low:high]
            dh[low:high] += part @ words[k]
            by_word[k], by_bias[k] = part.T @ h[low:high], part.sum(axis=0)
        # a class without a target has a gradient of 0 and stays as it is
        steps += [(word_out, memory[3], by_word.reshape(word_out.shape)), (word_bias, memory[4], by_bias.ravel())]
        for weight, seen, gradient in steps:
            _adagrad(weight, seen, slice(None), gradient, rate)
        dh *= 1 - h * h
        for p in range(len(_OFFSETS)):
            order = np.argsort(context[:, p], kind="stable")
            ids = context[order, p]
            heads = W.group_starts(ids)
            _adagrad(tables[p], memory[0][p], ids[heads], np.add.reduceat(dh[order], heads, axis=0), rate)


def _adagrad(weight: np.ndarray, memory: np.ndarray, place, gradient: np.ndarray, rate: float) -> None:
    total = memory[place] + gradient * gradient
    memory[place] = total
    np.sqrt(total, out=total)
    total += 1e-6
    weight[place] -= rate * gradient / total


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``exp(x - largest of the row)``, in place, and the largest."""
    top = x.max(axis=1)
    x -= top[:, None]
    return np.exp(x, out=x), top


def _softmax(x: np.ndarray) -> np.ndarray:
    x, _ = _exp(x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = x[np.arange(len(x)), at]
    x, top = _exp(x)
    return own - top - np.log(x @ np.ones(x.shape[1], x.dtype))


def word_counts(texts: DataFrame) -> DataFrame:
    """word (hash), n over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in W.blocks(batches, "text", lower=True, limit=4 * W.BLOCK_BYTES):
            value, n = np.unique(block.hashes(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Numbers of the words, and the share of a rarer word in its bucket."""

    def __init__(self, words: np.ndarray, listed: np.ndarray, counts: np.ndarray, tail: np.ndarray, tail_words: np.ndarray):
        """``words``: hashes, most frequent first; ``listed`` with ``counts``: rarer words; ``tail``: total and number, by bucket, of the rest."""
        self.order = np.argsort(words)
        self.known = words[self.order]
        self.symbols = len(words) + BUCKETS
        by_hash = np.argsort(listed)
        self.listed = listed[by_hash]
        bucket = (listed % np.uint64(BUCKETS)).astype(np.int64)
        whole = tail + np.bincount(bucket, counts, BUCKETS) + SMOOTHING * (tail_words + np.bincount(bucket, minlength=BUCKETS) + 1)
        self.listed_share = (np.log(counts + SMOOTHING) - np.log(whole)[bucket])[by_hash]
        self.tail_share = np.log(tail / (tail_words + 1) + SMOOTHING) - np.log(whole)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        rare = len(self.known) + (hashes % np.uint64(BUCKETS)).astype(np.int64)
        if not len(self.known):
            return rare
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.order[at], rare)

    def log_shares(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log of each word's share of its bucket; 0 for words with a number of their own."""
        out = np.zeros(len(ids))
        rare = np.flatnonzero(ids >= len(self.known))
        h, bucket = hashes[rare], ids[rare] - len(self.known)
        out[rare] = self.tail_share[bucket]
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
            found = self.listed[at] == h
            out[rare[found]] = self.listed_share[at[found]]
        return out

    def contexts(self, block: W.Words, ids: np.ndarray) -> np.ndarray:
        """(words, positions): the neighbours of every word of a block whose words are ``ids``."""
        text = block.text_of_word()
        at, low, high = np.arange(len(ids)), block.first[:-1][text], block.first[1:][text]
        context = np.empty((len(at), len(_OFFSETS)), np.min_scalar_type(self.symbols))
        for p, k in enumerate(_OFFSETS):
            x = at + k
            context[:, p] = np.where((x >= low) & (x < high), ids[np.clip(x, 0, max(len(ids) - 1, 0))], self.symbols)
        return context


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The vocabulary of a table (word, n), and the number of all words."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(1, math.ceil(total * LISTED))
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).toArrow()
    words = top["word"].to_numpy().astype(np.int64).view(np.uint64)
    rows = counts.where(F.col("n") >= least).toArrow()  # at most 1 / LISTED rows
    listed, n = rows["word"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy()
    own = ~np.isin(listed, words)
    tail, tail_words = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rest = counts.where(F.col("n") < least).groupBy(F.col("word").bitwiseAND(BUCKETS - 1).alias("bucket"))
    for r in rest.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():  # one row per bucket
        tail[r["bucket"]], tail_words[r["bucket"]] = r["n"], r["words"]
    few = top["n"].to_numpy() < least  # frequent enough for a number, too rare for the list
    bucket = (words[few] % np.uint64(BUCKETS)).astype(np.int64)
    tail -= np.bincount(bucket, top["n"].to_numpy()[few], BUCKETS)
    tail_words -= np.bincount(bucket, minlength=BUCKETS)
    return Vocabulary(words, listed[own], n[own], tail, tail_words), total


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray


class Trainer:
    """One shard's network, trained in batches of ``batch_words`` whatever the blocks its words come in."""

    def __init__(self, symbols: int, weights: np.ndarray, batch_words: int, rate: float):
        self.net, self.batch_words, self.rate = Network(symbols), batch_words, rate
        self.net.load(weights)
        self.memory = [np.full(s, 1e-8, np.float32) for s in self.net.shapes]
        self.context, self.target, self.seen = [], [], 0

    def add(self, context: np.ndarray, target: np.ndarray) -> None:
        self.seen += len(target)
        context, target = np.concatenate([*self.context, context]), np.concatenate([*self.target, target])
        whole = len(target) - len(target) % self.batch_words
        for low in range(0, whole, self.batch_words):
            self.net.train(context[low : low + self.batch_words], target[low : low + self.batch_words], self.memory, self.rate)
        self.context, self.target = [context[whole:]], [target[whole:]]

    def chunks(self, shard: int) -> Iterator[pa.RecordBatch]:
        if self.target and len(self.target[0]):
            self.net.train(self.context[0], self.target[0], self.memory, self.rate)
        if self.seen:
            flat = self.net.flat()
            parts = [flat[k : k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
            columns = [np.arange(len(parts)), np.full(len(parts), shard, np.int64), np.full(len(parts), float(self.seen))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.binary())], names=["chunk", "shard", "weight", "values"])


def _trained(texts: DataFrame, known: Vocabulary, weights: np.ndarray, shards: int, batch_words: int, rate: float) -> np.ndarray:
    """Weights after one round: every shard of ``texts`` trains from ``weights``, the results are averaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trainer = -1, None
        for batch, block in W.blocks(batches, "text", lower=True):
            ids = known.ids(block.hashes())
            context, ids = known.contexts(block, ids), ids.astype(np.min_scalar_type(known.symbols))
            of_text = np.asarray(batch.column(0))
            heads = W.group_starts(of_text)
            for low, high in zip(heads, np.append(heads[1:], len(of_text)), strict=True):
                if of_text[low] != shard:
                    if trainer:
                        yield from trainer.chunks(shard)
                    shard, trainer = int(of_text[low]), Trainer(known.symbols, weights, batch_words, rate)
                words = slice(block.first[low], block.first[high])
                trainer.add(context[words], ids[words])
        if trainer:
            yield from trainer.chunks(shard)

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        weight = rows["weight"].to_numpy()
        total = np.zeros(len(rows["values"].iloc[0]) // 4)
        for w, v in zip(weight, rows["values"], strict=True):
            total += w * np.frombuffer(v, np.float32)
        total /= weight.sum()
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "shard": rows["shard"].iloc[:1] // GROUP, "weight": [weight.sum()], "values": [total.astype(np.float32).tobytes()]})

    schema = "chunk long, shard long, weight double, values binary"
    dealt = texts.repartition("_shard").sortWithinPartitions("_shard", "_key", "text", "doc_id").select("_shard", "text")
    parts = written(dealt.mapInArrow(run, schema), "weights")
    while shards > 1:
        shards = -(-shards // GROUP)
        parts = parts.groupBy("chunk", F.floor(F.col("shard") / GROUP).alias("_group")).applyInPandas(mean, schema)
    rows = sorted(parts.select("chunk", "values").collect())  # one set of weights
    return np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]) if rows else weights


def fit(docs: DataFrame, rounds: int = 3, batch_words: int = 4096, rate: float = 0.1, shard_words: int = 2_000_000) -> Model:
    """Vocabulary and weights learned from all documents; a shard has about ``shard_words`` words."""
    known, total = vocabulary(written(word_counts(docs), "counts"))
    weights = Network(known.symbols).flat()
    shards = max(1, -(-total // (rounds * shard_words)))
    key = F.xxhash64(F.lit(5), F.col("doc_id").cast("string"), "text")
    texts = docs.select("doc_id", "text", key.alias("_key"), F.pmod(key, F.lit(rounds)).alias("_round"))
    texts = texts.withColumn("_shard", F.pmod(F.xxhash64(F.lit(6), "_key"), F.lit(shards)))
    for k in range(rounds if total else 0):
        weights = _trained(texts.where(F.col("_round") == k), known, weights, shards, batch_words, rate)
    return Model(known, weights)


def score(docs: DataFrame, model: Model, at_once: int = 1 << 15) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum over the words) and its mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.vocabulary
        net = Network(known.symbols)
        net.load(model.weights)
        for batch, block in W.blocks(batches, "text", lower=True):
            hashes = block.hashes()
            target = known.ids(hashes)
            context, logs = known.contexts(block, target), known.log_shares(hashes, target)
            for low in range(0, len(target), at_once):
                logs[low : low + at_once] += net.log_probability(context[low : low + at_once], target[low : low + at_once])
            total = np.concatenate([[0.0], np.cumsum(logs)])
            total = total[block.first[1:]] - total[block.first[:-1]]
            n = block.counts
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(total), mean], names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, log_likelihood double, mean_log_likelihood double")


def pseudo_likelihood(docs: DataFrame, **options) -> DataFrame:
    """Every document scored by the network learned from all of them."""
    return score(docs, fit(docs, **options))
