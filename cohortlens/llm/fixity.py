"""Merkle fixity audit of WARC replicas.

A store is a table of records: file, offset in the file, bytes.  Hashes of records are the leaves of a tree per file; a
node covers a range of offsets (``SPAN`` bytes at the bottom, ``FANOUT`` children above) and hashes its children in
order; the files' roots are the leaves of a tree over ranges of file numbers.  Two replicas are compared at the root; a
level is only compared below nodes that differ, down to the damaged records.

No node gathers more than ``FANOUT`` children, or the records that start in ``SPAN`` bytes.

Defined results: a null page id or URL is written as "-", null content as an empty body; repeated rows are records of
their own; an empty store has no root, so against an empty store every record is missing or added; two empty stores
agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.shared import written

SPAN, FANOUT, FILE_RECORDS = 1 << 16, 16, 1000


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """One response record as text."""
    body = F.coalesce(html, F.lit(""))
    name = F.coalesce(page_id.cast("string"), F.lit("-"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("-")), F.lit("\r\nWARC-Record-ID: <urn:page:"), name,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def store(pages: DataFrame) -> DataFrame:
    """Write pages as records of files with at most ``FILE_RECORDS`` records: file, offset, record_id, record.

    A task numbers its own files, so records are written once and never shuffled; file numbers are dense if tasks are
    alike.
    """
    rows = pages.select(F.col("page_id").alias("record_id"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    tasks = rows.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, carry = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            number = seen + np.arange(batch.num_rows)
            sizes = np.asarray(pa.compute.binary_length(batch.column(1)), np.int64)
            before = np.cumsum(sizes) - sizes
            # bytes of this batch before the file of each record began
            begun = np.maximum.accumulate(np.where(number % FILE_RECORDS == 0, before, -carry))
            offset = before - begun
            seen, carry = seen + batch.num_rows, int(offset[-1] + sizes[-1])
            file = pa.array(number // FILE_RECORDS * tasks + own)
            yield pa.RecordBatch.from_arrays([file, pa.array(offset), *batch.columns], names=["file", "offset", "record_id", "record"])

    kind = rows.schema["record_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"file long, offset long, record_id {kind}, record string"), "store")


def leaves(records: DataFrame) -> DataFrame:
    """Hash of each record: file, offset, length, record_id, digest."""
    return records.select("file", "offset", F.octet_length("record").cast("long").alias("length"), "record_id", F.sha2("record", 256).alias("digest"))


def _combined(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct(*order, "digest")))
    line = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", *[x[c].cast("string") for c in order], x["digest"])), "\n")
    return rows.groupBy(*keys).agg(F.sha2(line, 256).alias("digest"))


def tree(hashed: DataFrame, height: int, file_height: int) -> list[DataFrame]:
    """Levels from the ranges of records up to the root; a level has file, node and digest.

    The first ``height`` levels halve the offsets of a file by ``FANOUT``, the others the file numbers; in these the file
    is null.
    """
    ranges = hashed.withColumn("node", F.floor(F.col("offset") / SPAN).cast("long"))
    levels = [written(_combined(ranges, ["file", "node"], ["offset", "length"]), "nodes")]
    for _ in range(height):
        up = levels[-1].select("file", "node", F.floor(F.col("node") / FANOUT).cast("long").alias("up"), "digest")
        levels.append(written(_combined(up, ["file", "up"], ["node"]).withColumnRenamed("up", "node"), "nodes"))
    files = levels[-1].select(F.lit(None).cast("long").alias("file"), F.col("file").alias("node"), "digest")
    for _ in range(file_height):
        up = files.select("node", F.floor(F.col("node") / FANOUT).cast("long").alias("up"), "digest")
        files = _combined(up, ["up"], ["node"]).select(F.lit(None).cast("long").alias("file"), F.col("up").alias("node"), "digest")
        files = written(files, "nodes")
        levels.append(files)
    return levels


def _levels_to_one(largest: int) -> int:
    n = 0
    while largest:
        largest, n = largest // FANOUT, n + 1
    return n


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes (file, node) that are in one tree only or differ."""
    x = a.select("file", "node", F.col("digest").alias("_a"))
    y = b.select(F.col("file").alias("_f"), F.col("node").alias("_n"), F.col("digest").alias("_b"))
    both = x.join(y, F.col("file").eqNullSafe(F.col("_f")) & (F.col("node") == F.col("_n")), "full")
    both = both.where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(F.coalesce("file", "_f").alias("file"), F.coalesce("node", "_n").alias("node"))


def _below(level: DataFrame, parents: DataFrame, of_files: bool, last_of_file: bool) -> DataFrame:
    """Nodes of a level whose parent is among ``parents``."""
    p = parents.select(F.col("file").alias("_pf"), F.col("node").alias("_pn"))
    if of_files:
        return level.join(p, F.floor(F.col("node") / FANOUT) == F.col("_pn"), "left_semi")
    if last_of_file:  # a file's root below the lowest level of the tree over files
        return level.join(p, F.floor(F.col("file") / FANOUT) == F.col("_pn"), "left_semi")
    return level.join(p, (F.col("file") == F.col("_pf")) & (F.floor(F.col("node") / FANOUT) == F.col("_pn")), "left_semi")


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """Damaged records: file, offset, record_id, kind (changed, missing, added), length, digest, found_digest."""
    a, b = written(leaves(original), "leaves"), written(leaves(replica), "leaves")
    ends = a.select("file", "offset").unionByName(b.select("file", "offset")).agg(F.max("file"), F.max("offset")).first()
    height, file_height = _levels_to_one((ends[1] or 0) // SPAN), max(1, _levels_to_one(ends[0] or 0))
    left, right = tree(a, height, file_height), tree(b, height, file_height)
    bad = written(_differing(left[-1], right[-1]), "differing")
    for k in range(len(left) - 2, -1, -1):
        if bad.isEmpty():
            break
        x, y = (_below(side[k], bad, k > height, k == height) for side in (left, right))
        bad = written(_differing(x, y), "differing")
    node = F.floor(F.col("offset") / SPAN).cast("long")
    near = [side.withColumn("node", node).join(bad, ["file", "node"], "left_semi").drop("node") for side in (a, b)]
    order = Window.partitionBy("file", "offset").orderBy("digest", "length")  # two records at one offset only in a damaged store
    x, y = (side.withColumn("_k", F.row_number().over(order)) for side in near)
    y = y.select("file", "offset", "_k", F.col("length").alias("_length"), F.col("record_id").alias("_id"), F.col("digest").alias("found_digest"))
    both = x.join(y, ["file", "offset", "_k"], "full").where(~F.col("digest").eqNullSafe(F.col("found_digest")))
    kind = F.when(F.col("digest").isNull(), "added").when(F.col("found_digest").isNull(), "missing").otherwise("changed")
    record_id = F.when(F.col("digest").isNull(), F.col("_id")).otherwise(F.col("record_id"))
    return both.select("file", "offset", record_id.alias("record_id"), kind.alias("kind"), F.coalesce("length", "_length").alias("length"), "digest", "found_digest")
