"""Words of many texts at once, as numpy arrays over the Arrow buffers of a batch.

A word is a maximal run of bytes other than space and 0x09-0x0D.  None of these bytes occurs inside a longer UTF-8
sequence, so bytes give the same words as code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

BLOCK_BYTES = 4 << 20
LONG_WORD = 512

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters and digits only: every other ASCII character separates.
_PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    """Texts of a block: ``data`` bytes, text i at ``bounds[i]:bounds[i+1]``, its words ``first[i]:first[i+1]``."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int64), self.counts)

    def lower(self) -> np.ndarray:
        """``data`` with A-Z in lower case."""
        return _LOWER[self.data]

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, seed)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step over the spans that are that long."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF))
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = 0
    while len(live):
        left = size[live] - at
        chunk = eight[starts[live] + at] & _MASK[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ chunk)
        live = live[left > 8]
        at += 8
    key = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG_WORD):
        raw = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest()
        out[i] = np.uint64(int.from_bytes(raw, "little"))
    return out


def of_texts(column: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Words of an Arrow string column; a null text is empty.  ``plain`` words have no ASCII punctuation."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    low, high = (int(bounds[0]), int(bounds[-1])) if len(column) else (0, 0)
    data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
    bounds = bounds - low if len(column) else np.zeros(1, np.int64)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~(_PUNCTUATION if plain else _SPACE)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", lower: bool = False, plain: bool = False, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches with about ``limit`` bytes of text each (a longer text is a slice of its own)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < len(texts):
            before = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
            part = batch.slice(at, end - at)
            yield part, of_texts(texts.slice(at, end - at), lower, plain)
            at = end
        del batch, texts
        pa.default_memory_pool().release_unused()  # a worker lives on between tasks and stages


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Positions at which a sorted array takes a new value."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one of each distinct key, and the number of each key among them (an unstable sort is much faster)."""
    order = np.argsort(keys)
    heads = group_starts(keys[order])
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
    return order[heads], number


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i+1]]`` for each i; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def sums_between_pairs(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of set flags in each span."""
    total = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[ends] - total[starts]).astype(np.int64)


def max_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest of ``values[bounds[i]:bounds[i+1]]`` for each i; empty ranges give 0."""
    out = np.zeros(len(bounds) - 1, values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.maximum.reduceat(values, bounds[:-1][full])
    return out
