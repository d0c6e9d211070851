"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams (one to three letters, words padded by blanks) of a language, most
frequent first.  A document's own n-grams are ranked the same way; its distance to a language is the sum over its n-grams
of how far their rank is out of place, an n-gram the profile lacks counts as the profile's length.

Profiles are learned from documents with a language, at most ``per_language`` of each (chosen by a hash of the id, so
the same ones on every run); the n-gram counts of these are summed by Spark and only ``top`` n-grams per language
reach the driver.

Defined results: a null text or one without a letter is ``und`` with score 0, as is everything when no document has a
language; ties go to the language that sorts first; equal n-gram counts rank by the n-gram itself; repeated rows
get the same answer; whole texts count, however long.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm import words as W
from cohortlens.llm.shared import with_fields

UNKNOWN = "und"
TOP = 400
_BITS = 21  # a code point
_BLANK = 1


def _letter_table() -> np.ndarray:
    """Lower-cased code point of every letter below U+3000, 0 for everything else."""
    table = np.zeros(0x3000, np.uint32)
    for c in range(0x3000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS = _letter_table()


def letters(codes: np.ndarray) -> np.ndarray:
    """Letters as lower-case code points, 0 for the rest; above U+3000 by the character database."""
    out = _LETTERS[np.minimum(codes, 0x2FFF)]
    high = np.flatnonzero(codes >= 0x3000)
    if len(high):
        values, back = np.unique(codes[high], return_inverse=True)
        as_letter = [ord(x.lower()) if len((x := chr(int(c))).lower()) == 1 else int(c) for c in values]
        keep = [unicodedata.category(chr(int(c)))[0] == "L" for c in values]
        out[high] = np.where(keep, as_letter, 0)[back]
    return out


def letter_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, letter) of a block: every run of letters with one blank before and after it."""
    strings = texts.fill_null("").to_pylist()
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters(codes)
    keep = letter > 0
    edge = np.zeros(len(codes) + 1, bool)
    edge[np.concatenate([[0], np.cumsum(sizes)])] = True
    starts = np.flatnonzero(keep & (~np.concatenate([[False], keep[:-1]]) | edge[:-1]))
    run = np.cumsum(np.bincount(starts, minlength=len(codes)))[keep] - 1  # number of the run of each letter
    out = np.full(int(keep.sum()) + 2 * len(starts), _BLANK, np.uint32)
    out[np.arange(len(run)) + 2 * run + 1] = letter[keep]
    length = np.bincount(run, minlength=len(starts)) + 2
    return np.repeat(np.searchsorted(np.cumsum(sizes), starts, side="right"), length), out


def counted_grams(texts: pa.Array, owner_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text number, n-gram) with counts, ordered by text, then n-gram; ``owner_of`` renumbers the texts.

    The letters of the block get small numbers, so text and n-gram are one 64-bit sort key; a block with too many
    letters for that is halved.
    """
    text, seq = letter_runs(texts)
    owner = text if owner_of is None else owner_of[text]
    known, small = np.unique(seq, return_inverse=True) if len(seq) and seq.max() >= 0x3000 else _small(seq)
    bits = max(int(len(known)).bit_length(), 1)
    owners = max(int(owner.max()) if len(owner) else 0, 1).bit_length()
    if 3 * bits + 2 + owners > 63 and len(texts) > 1:
        half = len(texts) // 2
        left = counted_grams(texts.slice(0, half), np.arange(half) if owner_of is None else owner_of[:half])
        right = counted_grams(texts.slice(half), np.arange(half, len(texts)) if owner_of is None else owner_of[half:])
        return tuple(np.concatenate(x) for x in zip(left, right, strict=True))
    small = small.astype(np.int64)
    blank = seq == _BLANK
    base = owner.astype(np.int64) << (3 * bits + 2)
    joins = blank[:-1] & blank[1:]  # the end of one run and the start of the next
    one = base[~blank] | small[~blank]
    pair = (small[:-1] << bits) | small[1:]
    two = ((base[:-1] | (1 << 3 * bits)) + pair)[~joins]
    inner = ~blank[1:-1]
    three = ((base[:-2] | (2 << 3 * bits)) + ((pair[:-1] << bits) | small[2:]))[inner]
    keys = np.concatenate([one, two, three])
    keys.sort()
    at = W.group_starts(keys)
    n = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    mask = (1 << bits) - 1
    size = (keys >> (3 * bits)) & 3
    wide = known.astype(np.int64)
    low, middle, high = wide[keys & mask], wide[np.where(size > 0, (keys >> bits) & mask, 0)], wide[np.where(size > 1, (keys >> 2 * bits) & mask, 0)]
    gram = low | np.where(size > 0, middle << _BITS, 0) | np.where(size > 1, high << 2 * _BITS, 0)
    return keys >> (3 * bits + 2), gram, n


def _small(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letters below U+3000 in order, and the number of each letter among them."""
    known = np.flatnonzero(np.bincount(seq, minlength=2))
    place = np.zeros(0x3000, np.int64)
    place[known] = np.arange(len(known))
    return (known if len(known) else np.array([_BLANK])), place[seq]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 5000, top: int = TOP, block_bytes: int = W.BLOCK_BYTES) -> dict[str, list[int]]:
    """Profiles of the languages in ``labelled``: their ``top`` n-grams by rank.  ``per_language`` bounds the sample."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.lit(11), F.col(key)).alias("_h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, float(min(1.0, per_language / n)))])
    point = F.shiftrightunsigned("_h", 11).cast("double") / float(1 << 53)
    sample = rows.where(point < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in W.blocks(batches, "text", limit=block_bytes):
            names = np.asarray(batch.column(0).to_pylist(), dtype=object)
            kinds, kind = np.unique(names, return_inverse=True)
            k, g, n = counted_grams(batch.column(1), kind)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[k], pa.string()), pa.array(g), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top).orderBy("lang", "rank").collect()
    return {name: [r["gram"] for r in best if r["lang"] == name] for name in sizes}


def _ranks(profiles: dict[str, list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, sorted n-grams of all profiles, and rank of each in each language (-1: absent)."""
    names = sorted(profiles)
    every = np.unique(np.array([g for x in names for g in profiles[x]], dtype=np.int64))
    rank = np.full((len(names), len(every)), -1, np.int64)
    for k, x in enumerate(names):
        rank[k, np.searchsorted(every, np.array(profiles[x], dtype=np.int64))] = np.arange(len(profiles[x]))
    return names, every, rank


def distances(texts: pa.Array, every: np.ndarray, rank: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Out-of-place distance of each text to each language, and the number of its ranked n-grams."""
    owner, gram, n = counted_grams(texts)
    order = np.argsort((owner << 32) | (0xFFFFFFFF - np.minimum(n, 0xFFFFFFFF)), kind="stable")
    owner, gram = owner[order], gram[order]
    heads = W.group_starts(owner)
    place = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
    keep = place < top
    owner, gram, place = owner[keep], gram[keep], place[keep]
    at = np.minimum(np.searchsorted(every, gram), max(len(every) - 1, 0))
    known = every[at] == gram if len(every) else np.zeros(len(gram), bool)
    ranked = np.bincount(owner, minlength=len(texts))
    out = np.zeros((len(rank), len(texts)), np.int64)
    for k in range(len(rank)):
        r = np.where(known, rank[k][at], -1)
        far = np.where(r >= 0, np.minimum(np.abs(r - place), top), top)
        out[k] = np.bincount(owner, weights=far, minlength=len(texts)).astype(np.int64)
    return out, ranked


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", top: int = TOP, block_bytes: int = W.BLOCK_BYTES) -> DataFrame:
    """``docs`` with lang_pred and score: 1 minus the distance's share of the largest possible distance."""
    docs = docs.drop("lang_pred", "score")
    names, every, rank = _ranks(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*names, UNKNOWN], dtype=object)
        for batch, _ in W.blocks(batches, text, limit=block_bytes):
            column = batch.column(batch.schema.get_field_index(text))
            far, ranked = distances(column, every, rank, top) if names else (np.zeros((1, len(column)), np.int64), np.zeros(len(column), np.int64))
            best = np.where(ranked > 0, np.argmin(far, axis=0), len(names))
            score = np.where(ranked > 0, 1.0 - far.min(axis=0) / np.maximum(ranked * top, 1), 0.0)
            extra = [pa.array(labels[best], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, with_fields(docs, "lang_pred string, score double"))


def identify(docs: DataFrame, per_language: int = 5000) -> DataFrame:
    """Every document with its predicted language, learned from the documents that are not held out."""
    out = held_out(F.col("doc_id"))
    profiles = learn(docs.where(~out), per_language=per_language)
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")


#: Letters in another order: a text spelled with it has the words' lengths of a language and none of its n-grams.
_ORDER = ("abcdefghijklmnopqrstuvwxyz", "qzwxkjvbpfyguhcmtloisdnera")


def least_score(docs: DataFrame, profiles: dict[str, list[int]], sample: int = 20_000) -> float:
    """A score between those of texts and those of letter junk: halfway from the lowest score of labelled documents down to
    the median score of the same texts with their letters exchanged; the lowest score itself where junk scores no lower.

    Measured on about ``sample`` documents that a hash of the id chooses among those with a language and a letter.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    n = known.count()
    point = F.shiftrightunsigned(F.xxhash64(F.lit(23), "doc_id"), 11).cast("double") / float(1 << 53)
    chosen = known.where(point < sample / max(n, 1)).select("text")
    junk = chosen.select(F.translate(F.lower("text"), *_ORDER).alias("text"))
    found = lambda df: predict(df, profiles).where(F.col("lang_pred") != UNKNOWN)
    low, middle = found(chosen).agg(F.min("score")).first()[0], found(junk).agg(F.percentile_approx("score", 0.5)).first()[0]
    if low is None or middle is None:
        return 0.0
    return (low + middle) / 2 if middle < low else low


#: Below the lowest score of texts in a language of the profiles (0.42 in 10,000 documents), above that of random letters (0.29).
LEAST = 0.33
#: Text that the stage ranks at once: it carries whole documents, so its workers have less room than those of a query.
STAGE_BLOCK = 1 << 20


def keep_identified(docs: DataFrame, least: float = LEAST, per_language: int = 5000) -> DataFrame:
    """Documents whose language is known with at least the score ``least`` (``least_score`` measures one); columns as in ``docs``."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))), per_language=per_language, block_bytes=STAGE_BLOCK)
    names = docs.columns
    hidden = docs.withColumnsRenamed({c: f"_{i}_{c}" for i, c in enumerate(names)})
    body = hidden.columns[names.index("text")]
    found = predict(hidden, profiles, body, block_bytes=STAGE_BLOCK).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col(f"_{i}_{c}").alias(c) for i, c in enumerate(names)])
