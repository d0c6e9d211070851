"""Benchmark passages in documents, by an embedding of edit distance into Hamming distance.

Items and texts are sequences of lower-case words without punctuation.  A text is looked at through windows as long as an
item.  The embedding (CGK) walks over a window three times as many steps as it has words: a step copies the word under the
pointer, and a random bit of (step, word) moves the pointer on; two sequences at small edit distance give outputs that
agree in most places.  Repeated bit sampling then looks up windows: each of the ``tables``, as many as the wanted recall takes, holds the
items by ``SAMPLES`` random places of their output.  What collides is verified by exact word edit distance.

A window is embedded only if it can hold an item: within e = ``share`` x n edits an occurrence keeps n - 2 - 3 e of the
item's word triples, so a window with fewer triples of items of its size is out (no occurrence is lost by this).  Windows
start up to 3 e words before a known triple, as far as edits at the head of a passage can move the first one.

The benchmark is cut into slices of at most ``slice_words`` words, the documents are read once per slice; one slice is what
a task holds.

Defined results: null and empty texts hold no passage; items with fewer than ``min_words`` words are not searched; equal
items are found alike, each with its id; rows are judged one by one; an empty benchmark finds nothing; other
columns have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import words as W

EMBEDDINGS, SAMPLES = 8, 3
#: Share of edits, the recall that decides the number of tables, and the least and most tables an embedding gets.
SHARE, RECALL, LEAST_TABLES, MOST_TABLES = 0.2, 0.99, 4, 64
STRETCH = 3
#: Places are sampled where most walks are still inside the window; a walk moves every other step.
REACH = 2
_BLOOM_BITS = 22
#: Text looked at together, and words of windows embedded together: what an executor's workers have room for.
BLOCK_BYTES, WINDOW_WORDS = 2 << 20, 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)


def embed(sequences: np.ndarray, seed: int) -> np.ndarray:
    """CGK output of each row of word hashes: ``STRETCH`` times as long, 0 behind the end."""
    rows, n = sequences.shape
    padded = np.concatenate([sequences, np.zeros((rows, 1), np.uint64)], axis=1)
    out = np.zeros((rows, STRETCH * n), np.uint64)
    at, row = np.zeros(rows, np.int64), np.arange(rows)
    for step in range(STRETCH * n):
        word = padded[row, at]
        out[:, step] = word
        bit = W.mix(word ^ np.uint64(((step + 1) * int(_STEP) + seed * 0x51ED27) & 0xFFFFFFFFFFFFFFFF)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), n)
    return out


@lru_cache(maxsize=None)
def tables(n: int, share: float = SHARE) -> int:
    """Tables for items of n words, a multiple of ``EMBEDDINGS``: as many as the wanted recall takes at the full ``share`` of edits.

    Measured on random items with edits evenly spread and at random places, with and without insertions and deletions: an
    embedding with a share p of places that agree finds its item in one of t tables with probability 1 - (1 - p^SAMPLES)^t.
    The worst kind of edits decides.
    """
    rng = np.random.default_rng(n)
    e, trials = int(share * n), max(8, min(48, 6000 // n))
    if e == 0:
        return EMBEDDINGS * LEAST_TABLES
    items = rng.integers(1, 2**63, (trials, n + e), dtype=np.uint64)
    kinds = []
    for even in (True, False):
        for shifting in (False, True):
            rows = []
            for item in items:
                places = ((np.arange(e) + 0.5) * n / e).astype(int) if even else np.sort(rng.choice(n, e, replace=False))
                words, done = item[:n].tolist(), 0
                for k, at in enumerate(places):
                    kind = (0, 1, 2)[k % 3] if shifting else 0
                    at = at + done
                    words[at : at + 1] = [[7 + k], [], [words[at], 7 + k]][kind]
                    done += (0, -1, 1)[kind]
                rows.append((words + item[n:].tolist())[:n])
            kinds.append(np.array(rows, np.uint64))
    odds = np.zeros((len(kinds), trials, EMBEDDINGS))
    for j in range(EMBEDDINGS):
        own = embed(items[:, :n], j)[:, : REACH * n]
        for k, rows in enumerate(kinds):
            odds[k, :, j] = (embed(rows, j)[:, : REACH * n] == own).mean(axis=1) ** SAMPLES
    own = LEAST_TABLES
    while own < MOST_TABLES and (1 - np.prod((1 - odds) ** own, axis=2)).mean(axis=1).min() < RECALL:
        own = own + max(1, own // 4)
    return EMBEDDINGS * own


def sampled_keys(sequences: np.ndarray, number: int | None = None) -> np.ndarray:
    """(rows, ``number`` of tables) keys: table number and the words at its sampled places."""
    rows, n = sequences.shape
    rng = np.random.default_rng(n)
    number = number or tables(n)
    own = number // EMBEDDINGS
    out = np.empty((rows, number), np.uint64)
    for e in range(EMBEDDINGS):
        output = embed(sequences, e)
        for t in range(own):
            key = np.full(rows, W.mix(np.array([n * 2**32 + e * own + t], np.uint64))[0])
            # one place where no walk has ended: ends agree with each other, whatever the words
            for place in [rng.integers(0, n), *rng.integers(0, REACH * n, SAMPLES - 1)]:
                key = W.mix(key ^ output[:, place])
            out[:, e * own + t] = key
    return out


def edit_distances(items: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least word edit distance of each item to any substring of its region, and where that substring ends."""
    width = np.arange(regions.shape[1] + 1)
    row = np.zeros((len(items), regions.shape[1] + 1), np.int64)
    for i in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (regions != items[:, i : i + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - width, axis=1) + width
    end = np.argmin(row, axis=1)
    return row[np.arange(len(items)), end], end


def _triples(words: np.ndarray) -> np.ndarray:
    return W.mix((words[:-2] * _STEP + words[1:-1]) * _STEP + words[2:])


@dataclass
class Benchmark:
    """One slice of the benchmark: word hashes by item, the word triples in it, and the tables."""

    item: list
    sequence: list[np.ndarray]
    share: float

    def __post_init__(self) -> None:
        # distinct (triple, size of an item that holds it), ordered by triple
        held = sorted({(t, len(s)) for s in self.sequence for t in _triples(s).tolist()})
        self.triples, self.sizes = np.array([t for t, _ in held], np.uint64), np.array([n for _, n in held], np.int64)
        self.bloom = np.zeros(1 << _BLOOM_BITS, bool)
        self.bloom[self.triples >> np.uint64(64 - _BLOOM_BITS)] = True
        self.by_size: dict[int, np.ndarray] = {}
        for n in sorted({len(s) for s in self.sequence}):
            self.by_size[n] = np.array([i for i, s in enumerate(self.sequence) if len(s) == n])
        self.tables: dict[int, int] = {}
        keys, owners = [], []
        for which in self.by_size.values():
            n = len(self.sequence[which[0]])
            self.tables[n] = tables(n)
            keys.append(sampled_keys(np.stack([self.sequence[i] for i in which]), self.tables[n]).ravel())
            owners.append(np.repeat(which, self.tables[n]))
        keys, owners = (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def edits(self, n: int) -> int:
        return int(self.share * n)

    def _candidates(self, n: int, hits: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Starts of windows of n words that may hold an item of n words; ``hits``: where triples of such items are."""
        reach = np.minimum(hits + n + self.edits(n) - 2, end[hits] - 2)
        enough = np.searchsorted(hits, reach) - np.arange(len(hits)) >= max(1, n - 2 - 3 * self.edits(n))
        starts = hits[enough]
        # each edit at the head takes up to three triples, so the passage starts at most 3 e words before the first known one
        low = np.maximum(starts - 3 * self.edits(n), begin[starts])
        size = len(begin) + 1
        return np.flatnonzero(np.cumsum(np.bincount(low, minlength=size) - np.bincount(starts + 1, minlength=size)) > 0)

    def matches(self, block: W.Words) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, distance): the closest occurrence of each item in each text."""
        h, n_words = block.hashes(), len(block.starts)
        if n_words < 3 or not self.item:
            return []
        triple = _triples(h)
        text = block.text_of_word()
        hit = self.bloom[triple >> np.uint64(64 - _BLOOM_BITS)] & (text[:-2] == text[2:])
        at = np.flatnonzero(hit)
        low, high = np.searchsorted(self.triples, triple[at], "left"), np.searchsorted(self.triples, triple[at], "right")
        count = high - low
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        place, size = np.repeat(at, count), self.sizes[entry]
        order = np.argsort(size, kind="stable")
        place, size = place[order], size[order]
        begin, end = block.first[:-1][text], block.first[1:][text]
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n in self.by_size:
            starts = self._candidates(n, place[np.searchsorted(size, n) : np.searchsorted(size, n, "right")], begin, end)
            at_once = max(1, WINDOW_WORDS // n)
            for low in range(0, len(starts), at_once):
                for key, value in self._verified(h, text, begin, end, n, starts[low : low + at_once]):
                    if key not in found or value < found[key]:
                        found[key] = value
        return [(t, i, first, size, d) for (t, i), (d, first, size) in found.items()]

    def _verified(self, h: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int, starts: np.ndarray) -> Iterator[tuple[tuple[int, int], tuple[int, int, int]]]:
        places = starts[:, None] + np.arange(n)[None, :]
        windows = np.where(places < end[starts][:, None], h[np.minimum(places, len(h) - 1)], np.uint64(0))
        keys = sampled_keys(windows, self.tables[n]).ravel()
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        some = np.flatnonzero(high > low)
        count = (high - low)[some]
        if not len(some):
            return
        window = np.repeat(some // self.tables[n], count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item = self.owners[np.repeat(low[some], count) + offset]
        pairs = np.unique(window * len(self.item) + item)
        window, item = pairs // len(self.item), pairs % len(self.item)
        d = self.edits(n)
        side = d + 4
        at_once = max(1, WINDOW_WORDS // (n + 2 * side))
        for a in range(0, len(window), at_once):
            w, it = window[a : a + at_once], item[a : a + at_once]
            p = starts[w][:, None] - side + np.arange(n + 2 * side)[None, :]
            inside = (p >= begin[starts[w]][:, None]) & (p < end[starts[w]][:, None])
            regions = np.where(inside, h[np.clip(p, 0, len(h) - 1)], np.uint64(0))
            items = np.stack([self.sequence[i] for i in it])
            distance, stop = edit_distances(items, regions)
            # the same on reversed sequences gives the start
            back, length = edit_distances(items[:, ::-1], regions[:, ::-1])
            for k in np.flatnonzero(distance <= d):
                s = int(starts[w[k]])
                last = s - side + int(stop[k])
                first = s - side + regions.shape[1] - int(length[k])
                first = max(int(begin[s]), min(first, last - 1))
                yield (int(text[s]), int(it[k])), (int(distance[k]), first - int(begin[s]), last - first)


def _slices(benchmark: DataFrame, min_words: int, share: float, slice_words: int) -> Iterator[Benchmark]:
    """The benchmark in slices whose words fit a task."""
    rows = benchmark.select("item_id", F.lower("text").alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    number = -(-size // slice_words)
    for k in range(number):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k).orderBy("item_id", "text").collect()  # at most about slice_words words
        block = W.of_texts(pa.array([r["text"] for r in part], pa.string()), plain=True)
        h = block.hashes()
        found = [(r["item_id"], h[a:b]) for r, a, b in zip(part, block.first[:-1], block.first[1:], strict=True) if b - a >= min_words]
        yield Benchmark([i for i, _ in found], [s for _, s in found], share)


def matches(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, min_words: int = 8, slice_words: int = 2_000_000) -> DataFrame:
    """doc_id, item_id, first_word, n_words, distance, item_words: where a document holds a benchmark item."""
    rows = docs.select("doc_id", F.lower("text").alias("text"))
    doc_type, item_type = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {doc_type}, item_id {item_type}, first_word long, n_words long, distance long, item_words long"

    def finder(index: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, block in W.blocks(batches, "text", plain=True, limit=BLOCK_BYTES):
                found = sorted(index.matches(block))
                ids = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                columns = [pa.array([index.item[x[1]] for x in found]), *[pa.array([x[k] for x in found], pa.int64()) for k in (2, 3, 4)]]
                columns.append(pa.array([len(index.sequence[x[1]]) for x in found], pa.int64()))
                if found:
                    yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "first_word", "n_words", "distance", "item_words"])

        return run

    out = None
    for index in _slices(benchmark, min_words, share, slice_words):
        part = rows.mapInArrow(finder(index), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, min_words: int = 8, slice_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    names = docs.columns
    out = docs.toDF(*[f"_{i}_{c}" for i, c in enumerate(names)])
    body = out.columns[names.index("text")]

    def flagger(index: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, block in W.blocks(batches, "_lower", plain=True, limit=BLOCK_BYTES):
                found = np.zeros(batch.num_rows, bool)
                found[[x[0] for x in index.matches(block)]] = True
                yield batch.select(batch.schema.names[:-1]).filter(pa.array(~found))

        return run

    for index in _slices(benchmark, min_words, share, slice_words):
        out = out.withColumn("_lower", F.lower(body)).mapInArrow(flagger(index), out.schema)
    return out.toDF(*names)
