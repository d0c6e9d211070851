"""Repetition rules from suffix arrays.

Each text is a sequence of words.  The suffixes of all texts in a block are sorted by prefix doubling (only groups that
are still equal are sorted again), the longest common prefix of neighbours comes from the ranks of each doubling, and the
maximal repeated substrings are the longest ones that start at each word.  Their union gives the covered words.

Defined results: a null or empty text has no words and fails the base rule; repeated rows are judged alike; text order
within a batch has no influence; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import words as W
from cohortlens.llm.shared import with_fields

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, n_repeats long, covered_chars long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def longest_repeats(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that starts there and occurs elsewhere in its text."""
    n = len(keys)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    start_key = W.mix(keys ^ W.mix(text.astype(np.uint64) + np.uint64(1)))
    suffixes = np.argsort(start_key, kind="stable")
    sorted_keys = start_key[suffixes]
    heads = W.group_starts(sorted_keys)
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[suffixes] = np.repeat(heads, sizes) + 1
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    levels, step = [rank.copy()], 1
    while len(slots):
        live = suffixes[slots]
        beyond = live + step
        second = np.where(beyond < end[live], rank[np.minimum(beyond, n - 1)], 0)
        pair = (rank[live] << 32) | second
        order = np.argsort(pair, kind="stable")
        live, pair = live[order], pair[order]
        suffixes[slots] = live
        heads = W.group_starts(pair)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[live] = np.repeat(slots[heads], sizes) + 1
        slots = slots[np.repeat(sizes > 1, sizes)]
        step *= 2
        if len(slots):
            levels.append(rank.copy())
    a, b = suffixes[:-1], suffixes[1:]
    same = levels[0][a] == levels[0][b]
    a, b = a[same], b[same]
    prefix = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + prefix, b + prefix
        inside = (x < end[a]) & (y < end[b])
        ranks = levels[level]
        equal = inside & (ranks[np.minimum(x, n - 1)] == ranks[np.minimum(y, n - 1)])
        prefix[equal] += 1 << level
    np.maximum.at(longest, a, prefix)
    np.maximum.at(longest, b, prefix)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Words inside some repeated substring of at least ``least`` words."""
    at = np.flatnonzero(longest >= least)
    change = np.bincount(at, minlength=len(longest) + 1) - np.bincount(at + longest[at], minlength=len(longest) + 1)
    return np.cumsum(change[: len(longest)]) > 0


def repeated_lines(block: W.Words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    data = block.data
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.union1d(block.bounds[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(len(block), np.int64)
    text = np.searchsorted(block.bounds, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), block.bounds[1:][text])
    ends = np.where((ends > starts) & (data[np.maximum(ends - 1, 0)] == 0x0A), ends - 1, ends)
    with_word = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    starts, ends, text = starts[with_word], ends[with_word], text[with_word]
    key = W.mix(W.span_hashes(data, starts, ends) ^ W.mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    repeat = np.ones(len(key), bool)
    repeat[order[W.group_starts(key[order])]] = False
    return np.bincount(text[repeat], minlength=len(block)).astype(np.int64)


def measure_block(block: W.Words, window: int, least: int) -> list[np.ndarray]:
    longest = longest_repeats(block.hashes(), block.first)
    letters = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    word_chars = letters[block.ends] - letters[block.starts]
    maximal = (longest >= least) & (np.concatenate([[0], longest[:-1]]) <= longest)
    return [
        block.counts.astype(np.int64),
        W.sums_between(word_chars, block.first),
        W.sums_between(_SYMBOL[block.data], block.bounds),
        repeated_lines(block),
        W.sums_between(covered(longest, window), block.first),
        W.max_between(longest, block.first),
        W.sums_between(maximal, block.first),
        W.sums_between(np.where(covered(longest, least), word_chars, 0), block.first),
    ]


def measures(docs: DataFrame, text: str = "text", window: int = 8, least: int = 6) -> DataFrame:
    """``docs`` with word, symbol, line and repetition counts of each whole text.

    ``window`` is the length whose repeats make ``n_repeat_words``, ``least`` the shortest repeat that covers characters.
    """
    names = [x.split()[0] for x in MEASURES.split(", ")]
    if clash := set(names) & set(docs.columns):
        docs = docs.drop(*clash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in W.blocks(batches, text):
            extra = [pa.array(x, pa.int64()) for x in measure_block(block, window, least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, with_fields(docs, MEASURES))


def rules(docs: DataFrame, text: str = "text", min_words: int = 20, max_repeat_percent: int = 30, max_covered: float = 0.4, max_longest_share: float = 0.25, min_longest: int = 50) -> DataFrame:
    """Verdict on each document.

    ``base_failed``: fewer than ``min_words`` words or more than ``max_repeat_percent`` of them in repeated windows.
    ``kept``: not that, at most ``max_covered`` of the word characters covered by maximal repeats, and no repeat that
    has ``min_longest`` words and is over ``max_longest_share`` of the text.
    """
    out = measures(docs, text)
    share = F.col("covered_chars") / F.when(F.col("word_chars") > 0, F.col("word_chars"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    long_repeat = (F.col("longest_repeat") >= min_longest) & (F.col("longest_repeat") > max_longest_share * F.col("n_words"))
    fine = (F.coalesce(share, F.lit(0.0)) <= max_covered) & ~long_repeat
    return out.withColumns({"covered_share": F.coalesce(share, F.lit(0.0)), "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & fine)
