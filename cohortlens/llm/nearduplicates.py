"""Near duplicates by MinHash bands, odd sketches and full sets.

Every text gets the set of its word shingles.  Texts with the same set are one class.  A class has ``bands`` x ``rows``
MinHash samples: the bands make candidate buckets, and all samples are folded into a parity bitmap (odd sketch).  The
population count of two bitmaps' XOR estimates the share of samples that differ, precisely where the share is small, and
is tested before the full sets are compared.

At the threshold 0.8 a pair misses all 32 bands of 5 rows with probability 3e-6, and the sketch test (4.5 standard
deviations below the threshold) with 3e-6.  Confirmed links are exact.

No bucket is expanded into all its pairs.  First each class is compared with the smallest class it shares most buckets
with, then the classes of each bucket with the bucket's smallest one.  What is left are buckets that hold several
components.  Those with up to ``SMALL`` members (so few pairs a member) are joined; larger ones are compared inside tasks,
a member against the whole bucket at a time, and only links that join two components come out.  A bucket with over
``hot`` members first falls apart by the other bands of its members, and groups over ``BLOCK`` members are compared block
by block, so no task holds more than two blocks.

Defined results: null texts and texts without words have an empty set, link with nothing and are kept; a single word is
one shingle; rows that repeat a text are one class, whatever their ids; the component of a row without id is the
smallest id of the others; clashing columns of the table stay out of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm import words as W
from cohortlens.llm.components import components
from cohortlens.llm.shared import with_fields, written

BANDS, ROWS, SKETCH_BITS = 32, 5, 512
SMALL, BLOCK = 16, 2048
_SEED = 0x5DEECE66D


def shingle_sets(block: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a block, text by text, and the bounds of each text's."""
    h, counts = block.hashes(), block.counts
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(shingles)])
    text = np.repeat(np.arange(len(block)), shingles)
    start = block.first[:-1][text] + np.arange(bounds[-1]) - bounds[:-1][text]
    length = np.minimum(counts[text], size)
    value = W.mix(length.astype(np.uint64))
    for k in range(size):
        use = length > k
        value[use] = W.mix(value[use] * np.uint64(0x9E3779B97F4A7C15) + h[start[use] + k])
    order = np.argsort(W.mix(value ^ W.mix(text.astype(np.uint64))), kind="stable")
    first = np.ones(len(value), bool)
    first[1:] = (value[order][1:] != value[order][:-1]) | (text[order][1:] != text[order][:-1])
    keep = np.zeros(len(value), bool)
    keep[order[first]] = True
    return value[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(block)))])


def minhashes(values: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """(k, texts) smallest hash of each text under k multiplicative hash functions; all ones for an empty set."""
    rng = np.random.default_rng(_SEED)
    factor = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offset = rng.integers(0, 2**63, k, dtype=np.uint64)
    out = np.full((k, len(bounds) - 1), np.uint64(0xFFFFFFFFFFFFFFFF))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        for i in range(k):
            out[i, full] = np.minimum.reduceat((values ^ offset[i]) * factor[i], bounds[:-1][full])
    return out


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """(texts, bits / 64) parity bitmaps of the (number, sample) pairs."""
    k, n = samples.shape
    number = W.mix(np.arange(k, dtype=np.uint64) + np.uint64(77))[:, None]
    bit = (W.mix(samples ^ number) % np.uint64(bits)).astype(np.int64)
    flat = np.bincount((bit + np.arange(n) * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(flat.astype(np.uint8).reshape(n, bits), axis=1, bitorder="little").view("<i8")


def band_keys(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) hash of the samples of each band."""
    out = np.empty((samples.shape[1], bands), np.int64)
    for b in range(bands):
        key = W.mix(np.full(samples.shape[1], b + 1, np.uint64))
        for r in range(rows):
            key = W.mix(key ^ samples[b * rows + r])
        out[:, b] = key.view(np.int64)
    return out


def signatures(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """doc_id, n_shingles, class (null for an empty set), bands and sketch of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in W.blocks(batches, "text", lower=True):
            values, bounds = shingle_sets(block, size)
            samples = minhashes(values, bounds, BANDS * ROWS)
            n = np.diff(bounds)
            kind = set_class(values, bounds)
            bands, sketch = band_keys(samples, BANDS, ROWS), odd_sketches(samples, SKETCH_BITS)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            columns = [batch.column(0), pa.array(n.astype(np.int64)), pa.array(kind, mask=n == 0), lists(bands), lists(sketch)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class", "bands", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, class long, bands array<long>, sketch array<long>")


def set_class(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each text's set, whatever its order."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(values ^ np.uint64(0xABCDEF)), dtype=np.uint64)])
    return W.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def full_sets(texts: DataFrame, size: int) -> DataFrame:
    """class and shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in W.blocks(batches, "text", lower=True):
            values, bounds = shingle_sets(block, size)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_class(values, bounds)), lists], names=["class", "shingles"])

    return texts.select("text").mapInArrow(run, "class long, shingles array<long>")


def most_differing_bits(percent: int, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS, deviations: float = 4.5) -> int:
    """Largest XOR population count of a pair that may still reach the threshold."""
    j = percent / 100
    low = max(0.0, j - deviations * math.sqrt(j * (1 - j) / samples + 0.013**2))
    return math.ceil(bits / 2 * (1 - math.exp(-2 * (2 * samples * (1 - low)) / bits)))


def similar_sketches(a: Column, b: Column, percent: int) -> Column:
    count = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return count <= most_differing_bits(percent)


def _pairs_with(pairs: DataFrame, side: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return pairs.join(side.select(F.col("class").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns]), name)


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold: sizes, sketches, then full sets."""
    near = _pairs_with(_pairs_with(pairs.distinct(), classes, "a", ["n_shingles", "sketch"]), classes, "b", ["n_shingles", "sketch"])
    small, large = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
    near = near.where((100 * small >= percent * large) & similar_sketches(F.col("sketch_a"), F.col("sketch_b"), percent)).select("a", "b")
    full = _pairs_with(_pairs_with(near, sets, "b", ["shingles"]), sets, "a", ["shingles"])
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return full.where(100 * both >= percent * (F.size("shingles_a") + F.size("shingles_b") - both)).select("a", "b")


def _labelled(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their component."""
    out = buckets.join(roots.select(F.col("id").alias("class"), "root"), "class", "left")
    out = out.select("band", "key", "class", F.coalesce("root", "class").alias("root"))
    mixed = out.groupBy("band", "key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.min("class").alias("hub"), F.count(F.lit(1)).alias("members"))
    return out.join(mixed.where("_low < _high").drop("_low", "_high"), ["band", "key"])


def _divided(members: DataFrame, classes: DataFrame, hot: int, block: int) -> DataFrame:
    """Members of large buckets in groups of at most two blocks: (band, key, band2, key2, low, high), own block ``side``."""
    plain = members.where(F.col("members") <= hot).select("band", "key", F.lit(-1).alias("band2"), F.lit(0).cast("long").alias("key2"), "class", "root", "members")
    split = members.where(F.col("members") > hot).select("band", "key", "class", "root").join(classes.select("class", "bands"), "class")
    split = split.select("band", "key", F.posexplode("bands").alias("band2", "key2"), "class", "root").where("band2 <> band")
    keys = ["band", "key", "band2", "key2"]
    sizes = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high")
    rows = plain.unionByName(split.join(sizes.drop("_low", "_high"), keys))
    blocks = F.ceil(F.col("members") / block).cast("int")
    rows = rows.withColumn("side", F.pmod(F.xxhash64(F.lit(3), "class"), blocks).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select(*keys, F.least("side", "_other").alias("low"), F.greatest("side", "_other").alias("high"), "side", "class", "root")


def cross_links(names: np.ndarray, roots: np.ndarray, sides: np.ndarray, values: np.ndarray, bounds: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components of one group: each member outside the largest component against all of the group."""
    kinds, part = np.unique(roots, return_inverse=True)
    largest = int(np.argmax(np.bincount(part)))
    _, ids = np.unique(values, return_inverse=True)
    size = np.diff(bounds)
    marked = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    two_sides = sides.min() != sides.max()
    out = []
    for i in np.flatnonzero(part != largest):
        may = (part != part[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if two_sides:
            may &= sides != sides[i]
        others = np.flatnonzero(may)
        if not len(others):
            continue
        own = ids[bounds[i] : bounds[i + 1]]
        marked[own] = True
        n = size[others]
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(bounds[others], n)
        both = np.add.reduceat(marked[ids[place]], ends - n, dtype=np.int64)
        marked[own] = False
        for j in others[100 * both >= percent * (n + size[i] - both)]:
            if part[j] != part[i]:
                out.append((int(names[i]), int(names[j])))
                part[part == part[j]] = part[i]
    return out


def links_in_tasks(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between components within each group of ``_divided``."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        lists = group.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        names, roots, sides = (group.column(c).to_numpy() for c in ("class", "root", "side"))
        found = cross_links(names, roots, sides, lists.flatten().to_numpy(), bounds, percent)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return groups.join(sets, "class").groupBy("band", "key", "band2", "key2", "low", "high").applyInArrow(run, "a long, b long")


def duplicate_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, hot: int = 20000, small: int = SMALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, n_shingles and class; class with component, the smallest doc_id of all linked classes, and its root)."""
    signed = written(signatures(docs, text, key, size), "signatures")
    classes = signed.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    classes = written(classes, "classes")
    every = classes.select("class", F.posexplode("bands").alias("band", "key"))
    shared = every.groupBy("band", "key").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = written(every.join(shared, ["band", "key"]).select("band", "key", "class", "hub"), "buckets")
    busy = buckets.select("class").distinct()
    # one text of each class that shares a bucket: a row with the class's smallest id, or any if no row has an id
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    chosen = classes.join(busy, "class", "left_semi").select("doc_id", "class")
    named = texts.where("doc_id is not null").join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    found = full_sets(named, size).unionByName(full_sets(texts.where("doc_id is null"), size))
    sets = written(found.join(busy, "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")

    first = buckets.where("class <> hub").groupBy("class", "hub").agg(F.count(F.lit(1)).alias("n"))
    first = first.groupBy("class").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("a"))
    links = written(confirmed(first.select("a", F.col("class").alias("b")), classes, sets, percent), "links")
    roots = written(components(links), "roots")
    for _ in range(2):  # the rest against the smallest member of each bucket
        members = _labelled(buckets.drop("hub"), roots)
        hub_root = members.where("class = hub").select("band", "key", F.col("root").alias("_root"))
        pairs = members.join(hub_root, ["band", "key"]).where("root <> _root").select(F.col("hub").alias("a"), F.col("class").alias("b"))
        more = written(confirmed(pairs, classes, sets, percent), "links")
        links = links.unionByName(more)
        roots = written(components(links), "roots")
    members = written(_labelled(buckets.drop("hub"), roots), "members")
    few = members.where(F.col("members") <= small)
    left, right = few.alias("x"), few.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "key")]
    across = left.join(right, same + [F.col("x.class") < F.col("y.class"), F.col("x.root") != F.col("y.root")])
    more = confirmed(across.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")), classes, sets, percent)
    more = more.unionByName(links_in_tasks(_divided(members.where(F.col("members") > small), classes, hot, block), sets, percent))
    roots = written(components(written(links.unionByName(more), "links")), "roots")
    joined = classes.select("class", "doc_id").join(roots.select(F.col("id").alias("class"), "root"), "class", "left")
    joined = joined.withColumn("root", F.coalesce("root", "class"))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return signed.select("doc_id", "n_shingles", "class"), joined.join(least, "root").select("class", "component_id", "root")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Every row with the size of its set, its component and whether it is the one of its component that stays."""
    rows, component = duplicate_classes(docs, **options)
    out = rows.join(component, "class", "left")
    component_id = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component_id.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def classed(docs: DataFrame, text: str, size: int) -> DataFrame:
    """``docs`` with ``_class``, the class of each row's set (null for an empty one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in W.blocks(batches, text, lower=True):
            values, bounds = shingle_sets(block, size)
            kind = pa.array(set_class(values, bounds), mask=np.diff(bounds) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, kind], names=[*batch.schema.names, "_class"])

    return docs.mapInArrow(run, with_fields(docs, "_class long"))


def one_of_each(docs: DataFrame, size: int = 5, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and every row without words.

    Rows that repeat an id with one set of shingles are one document, its shortest text stays.  Under an id with several sets
    each row is judged by its own set, so that a text of its own is not lost to another under the same id; of those in one
    component the shortest stays.  Rows without id cannot be named and all stay.
    """
    rows, component = duplicate_classes(docs, size=size, **options)
    kept = component.select("component_id").union(rows.where("class is null").select("doc_id")).toDF("_kept").distinct()
    sets = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("class").alias("n"), F.count(F.lit(1)).alias("rows"))
    several = written(sets.where("a <> b OR (n > 0 AND n < rows)").select(F.col("doc_id").alias("_several")), "several")
    names = docs.columns
    hidden = docs.toDF(*[f"_{i}_{c}" for i, c in enumerate(names)])
    key, body = hidden.columns[names.index("doc_id")], hidden.columns[names.index("text")]

    def shortest(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.length(body), body)
        return df.withColumn("_number", F.row_number().over(order)).where("_number = 1").select(*hidden.columns)

    named = hidden.where(F.col(key).isNotNull()).join(kept, F.col(key) == F.col("_kept"), "left_semi")
    one = shortest(named.join(several, F.col(key) == F.col("_several"), "left_anti"), key)
    own = classed(named.join(several, F.col(key) == F.col("_several"), "left_semi"), body, size)
    own = own.join(component.withColumnRenamed("class", "_class"), "_class", "left").where((F.col("component_id") == F.col(key)) | F.col("_class").isNull())
    return one.unionByName(shortest(own, key, "root")).unionByName(hidden.where(F.col(key).isNull())).toDF(*names)
