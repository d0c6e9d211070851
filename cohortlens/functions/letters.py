"""Letter counts of whole texts over Arrow buffers, one pass for all letters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

_BLOCK = 4 << 20  # bytes of text that are counted at once
_NONE = 255


def _tables(letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of a letter by byte (ASCII) and by code point (two bytes)."""
    if len(set(letters)) != len(letters) or len(letters) > _NONE or any(ord(x) > 0x7FF for x in letters):
        raise ValueError("letters must be different ones of at most two bytes")
    points = np.full(0x800, _NONE, np.uint8)
    points[[ord(x) for x in letters]] = np.arange(len(letters))
    return np.concatenate([points[:128], np.full(128, _NONE, np.uint8)]), points


def counts(texts: pa.Array, letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Per text the count of each letter and the number of code points; a null text counts as empty."""
    one, two = _tables(letters)
    k, n = len(letters), len(texts)
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    found, size = np.zeros((n, k), np.int64), np.zeros(n, np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _BLOCK, "right")) - 1)
        b = data[ends[at] : ends[to]]
        text = np.repeat(np.arange(to - at, dtype=np.int32), np.diff(ends[at : to + 1]))
        number = one[b]
        lead = np.flatnonzero((b >= 0xC2) & (b < 0xE0))
        number[lead] = two[((b[lead] & 31).astype(np.int32) << 6) | (b[lead + 1] & 63)]
        hit = np.flatnonzero(number != _NONE)
        found[at:to] = np.bincount(text[hit].astype(np.int64) * k + number[hit], minlength=(to - at) * k).reshape(-1, k)
        size[at:to] = np.bincount(text[(b & 0xC0) != 0x80], minlength=to - at)
        at = to
    return found, size


def letter_shares(text: Column, letters: str) -> Column:
    """Share of each letter in the characters of a text, as an array in the order of ``letters``; null stays null."""

    @F.arrow_udf("array<double>")
    def shares(texts: pa.Array) -> pa.Array:
        found, size = counts(texts, letters)
        values = (found / np.maximum(size, 1)[:, None]).ravel()
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(letters)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=texts.is_null() if texts.null_count else None)

    return shares(text)
