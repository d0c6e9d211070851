"""Token files: whole texts as token ids, entropy coded in blocks that decode on their own.

Writing has three jobs.  (1) Documents are range partitioned by id, sorted and tokenised; a row keeps its place (part,
offset in the part).  (2) Id counts over all documents give the one frequency table that all blocks share.  (3) Ids are
cut into blocks and coded (``rans``).  A file set has the folders ``frequencies``, ``parts`` (ids before each part) and
``blocks`` (coded ids, the documents in them, checkpoints, checksums), all Parquet written by Spark's committer, so a
lost executor repeats tasks and leaves no half file.

Reading decodes blocks in any order and on any executor; checksums of documents that span blocks are combined.

A text is tokenised word by word (no token spans white space), each distinct word once per block, with a bounded
memory of recent words in every Python worker.

Defined results: a null or empty text has only the end id; documents without id come last; rows that repeat an id are
documents of their own, ordered by text hash and text; an empty table gives an empty file set; other columns are
not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.llm import rans, words as W
from cohortlens.llm.shared import new_path, written

MEMORY_WORDS, AT_ONCE = 400_000, 4096
_OTHER, _LETTER, _MARK = 0, 1, 2
_KIND = np.array([_LETTER if b >= 0x80 or chr(b).isalpha() else _MARK if 0x20 < b < 0x7F and not chr(b).isdigit() else _OTHER for b in range(256)], np.int8)
_workers: dict[str, WordEncoder] = {}


class Memory:
    """Recent entries: two generations, the older one is dropped when the younger has ``size`` entries."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, keys: list) -> list:
        young, old = self.young, self.old
        return [young.get(k) or old.get(k) for k in keys]

    def put(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


class WordEncoder:
    """Token ids of words, with a bounded memory.

    A word of ASCII letters and other bytes from 0x80 on, perhaps with ASCII punctuation behind them, is two pieces if
    all its letters are below U+0250: the tokenizer splits there, and its normalisation of such letters is lower case.
    New runs of letters go to the tokenizer in one text with blanks between; each ends where a token ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        suffix = settings["model"].get("end_of_word_suffix")
        # without word ends in the vocabulary every word goes to the tokenizer by itself
        self.letters = Tokenizer.from_str(json.dumps(settings | {"normalizer": None})) if suffix else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.runs, self.words = Memory(MEMORY_WORDS), Memory(MEMORY_WORDS // 4)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def whole(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        found = self.words.get(words)
        missing = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(missing), AT_ONCE):
            part = missing[at : at + AT_ONCE]
            texts = [words[i].decode("utf-8", "replace") for i in part]
            for i, x in zip(part, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                found[i] = np.array(x.ids, "<u4").tobytes()
        self.words.put([words[i] for i in missing], [found[i] for i in missing])
        return found

    def letter_runs(self, runs: list[bytes]) -> list[bytes | None]:
        """Ids of each run of letters in lower case; None for what is not letters below U+0250."""
        found = self.runs.get(runs)
        missing, texts = [], []
        for i in [i for i, x in enumerate(found) if x is None]:
            text = runs[i].decode("utf-8", "replace")
            if not text.isascii():
                text = text.lower()
                if max(text) >= "\u0250" or not text.isalpha():
                    continue
            missing.append(i)
            texts.append(text)
        for low in range(0, len(missing), AT_ONCE):  # the tokenizer's own record of a text is many times its size
            ids = np.array(self.letters.encode(" ".join(texts[low : low + AT_ONCE]), add_special_tokens=False).ids, "<u4")
            part, ends = missing[low : low + AT_ONCE], np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end each run of letters with a word end")
            raw = ids.tobytes()
            for i, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                found[i] = raw[4 * a : 4 * b]
        self.runs.put([runs[i] for i in missing], [found[i] for i in missing])
        return found

    def pieces(self, block: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct pieces, their bounds, and the two pieces of each word."""
        data, starts, ends = block.data, block.starts, block.ends
        kind = _KIND[data]
        size = W.sums_between_pairs(kind == _LETTER, starts, ends)
        back = np.concatenate([[False], (kind[1:] == _LETTER) & (kind[:-1] != _LETTER)])[: len(data)]
        # letters, then punctuation: no other byte, and letters begin at the first byte only
        turns = W.sums_between_pairs(back, np.minimum(starts + 1, ends), ends)
        simple = (size > 0) & (turns == 0) & (W.sums_between_pairs(kind == _OTHER, starts, ends) == 0) & (kind[starts] == _LETTER)
        if self.letters is None:
            simple[:] = False
        split = np.where(simple, starts + size, ends)
        coded: list[bytes] = [b""]
        first, second = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at = np.flatnonzero(simple)
        low = block.lower()
        one, where = W.distinct(W.span_hashes(low, starts[at], split[at]))
        raw = low.tobytes()
        runs = self.letter_runs([raw[s:e] for s, e in zip(starts[at][one].tolist(), split[at][one].tolist(), strict=True)])
        unfit = np.array([x is None for x in runs], bool)[where] if len(at) else np.zeros(0, bool)
        first[at] = where + len(coded)
        coded += [x or b"" for x in runs]
        split[at[unfit]] = ends[at[unfit]]
        simple[at[unfit]] = False
        raw = data.tobytes()
        for which, target, lo, hi in ((np.flatnonzero(~simple), first, starts, ends), (np.flatnonzero(split < ends), second, split, ends)):
            one, where = W.distinct(W.span_hashes(data, lo[which], hi[which], 1))
            target[which] = where + len(coded)
            coded += self.whole([raw[s:e] for s, e in zip(lo[which][one].tolist(), hi[which][one].tolist(), strict=True)])
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)])
        return np.frombuffer(b"".join(coded), "<u4"), bounds, np.stack([first, second], axis=1).ravel()

    def texts(self, block: W.Words, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, each with the end id, and the bounds of each text's."""
        flat, place, piece = self.pieces(block)
        size = np.diff(place)[piece]
        ends = np.cumsum(size)
        ids = flat[np.repeat(place[:-1][piece] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], np.cumsum(W.sums_between(size, 2 * block.first) + 1)])
        out = np.full(bounds[-1], end_id, np.uint32)
        is_end = np.zeros(bounds[-1], bool)
        is_end[bounds[1:] - 1] = True
        out[~is_end] = ids
        return out, bounds


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, partitions: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, part, offset in the part, n_tokens and ids (32-bit little-endian), in order within each part."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order, "text")
    rows = rows.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = WordEncoder.of(tokenizer), 0
        for batch, block in W.blocks(batches, "text"):
            ids, bounds = encoder.texts(block, end_id)
            blobs = pa.Array.from_buffers(pa.binary(), len(block), [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids)])
            columns = [batch.column(0), batch.column(2), pa.array(at + bounds[:-1]), pa.array(np.diff(bounds)), blobs]
            at += int(bounds[-1])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "offset", "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part int, offset long, n_tokens long, ids binary")


def frequencies(coded: DataFrame) -> DataFrame:
    """symbol, n over all documents: a histogram per task, then one row per symbol."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                seen = np.bincount(np.frombuffer(blob.as_buffer(), "<u4"))
                if len(seen) > len(total):
                    total = np.concatenate([total, np.zeros(len(seen) - len(total), np.int64)])
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["symbol", "n"])

    return coded.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


_BLOCK_FIELDS = "n int, words binary, states binary, point_steps array<int>, point_words array<long>, point_states binary, ids_crc long, words_crc long"


def coded_blocks(coded: DataFrame, symbols: list[tuple[int, int]], at_once: int = 64) -> DataFrame:
    """Blocks: part, offset of the first id in the part, coded ids, and the pieces of documents in it."""
    id_type = coded.schema["doc_id"].dataType.simpleString()
    schema = f"part int, offset long, {_BLOCK_FIELDS}, docs array<struct<doc_id:{id_type},doc_offset:long,n_tokens:long,piece:long,size:long>>"
    names = _names(_BLOCK_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.of(np.array([s for s, _ in symbols], np.int64), np.array([n for _, n in symbols], np.int64))
        ready: list[tuple] = []
        part, start, held, pieces, size = None, 0, [], [], 0
        types = [pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]

        def close() -> None:
            nonlocal held, pieces, size
            if size:
                ready.append((part, start, np.concatenate(held), pieces))
            held, pieces, size = [], [], 0

        def out() -> pa.RecordBatch:
            made = rans.encode([x[2] for x in ready], table)
            columns = [pa.array([x[0] for x in ready], pa.int32()), pa.array([x[1] for x in ready], pa.int64())]
            columns += [pa.array([m[k] for m in made], kind) for k, kind in zip(names, types, strict=True)]
            columns.append(pa.array([x[3] for x in ready], pa.list_(piece_type)))
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "offset", *names, "docs"])

        piece_type = None
        for batch in batches:
            if piece_type is None:
                piece_type = pa.struct([("doc_id", batch.schema.field("doc_id").type), ("doc_offset", pa.int64()), ("n_tokens", pa.int64()), ("piece", pa.int64()), ("size", pa.int64())])
            for row in range(batch.num_rows):
                doc_id, own, offset = batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row].as_py()
                ids = np.frombuffer(batch.column(4)[row].as_buffer(), "<u4")
                if own != part or offset != start + size:  # another part, or rows of it that another task has
                    close()
                    part, start = own, offset
                at = 0
                while at < len(ids):
                    take = min(rans.BLOCK_IDS - size, len(ids) - at)
                    held.append(ids[at : at + take])
                    pieces.append({"doc_id": doc_id, "doc_offset": offset, "n_tokens": len(ids), "piece": at, "size": take})
                    size, at = size + take, at + take
                    if size == rans.BLOCK_IDS:
                        close()
                        start = offset + at
                        if len(ready) == at_once:
                            yield out()
        close()
        if ready:
            yield out()

    return coded.select("doc_id", "part", "offset", "n_tokens", "ids").mapInArrow(run, schema)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the file set of ``docs`` under ``path``."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = new_path(spark, "tokenised")
    rows = tokenised(docs, tokenizer, end_id, partitions)
    rows.write.option("compression", "zstd").parquet(scratch)
    rows = spark.read.schema(rows.schema).parquet(scratch)
    counts = frequencies(rows)
    counts.coalesce(1).write.parquet(f"{path}/frequencies")  # a row per symbol of the vocabulary
    parts = rows.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/parts")
    coded_blocks(rows, _symbols(spark, path)).write.option("compression", "none").parquet(f"{path}/blocks")


def _symbols(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    rows = spark.read.schema("symbol long, n long").parquet(f"{path}/frequencies").orderBy("symbol").collect()
    return [(r["symbol"], r["n"]) for r in rows]


def decoded(spark: SparkSession, path: str, give: Callable[[np.ndarray], object], result: str, id_type: str = "long", at_once: int = 64) -> DataFrame:
    """A row per piece of a document: doc_id, part, doc_offset, n_tokens, piece, size, and ``give(ids)`` as ``result``."""
    symbols = _symbols(spark, path)
    pieces = f"array<struct<doc_id:{id_type},doc_offset:long,n_tokens:long,piece:long,size:long>>"
    blocks = spark.read.schema(f"part int, offset long, {_BLOCK_FIELDS}, docs {pieces}").parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.of(np.array([s for s, _ in symbols], np.int64), np.array([n for _, n in symbols], np.int64))
        for batch in batches:
            for low in range(0, batch.num_rows, at_once):
                part = batch.slice(low, at_once)
                rows = part.select(_names(_BLOCK_FIELDS)).to_pylist()
                lists = part.column("docs").combine_chunks() if isinstance(part.column("docs"), pa.ChunkedArray) else part.column("docs")
                flat = lists.flatten()
                number = np.repeat(np.arange(len(rows)), np.asarray(lists.value_lengths()))
                size = np.asarray(flat.field("size"))
                ids = rans.decode(rows, table)
                values, at, last = [], 0, -1
                for b, n in zip(number.tolist(), size.tolist(), strict=True):
                    at = at if b == last else 0
                    values.append(give(ids[b][at : at + n]))
                    at, last = at + n, b
                own = pa.array(np.asarray(part.column("part"))[number], pa.int32())
                columns = [flat.field("doc_id"), own, *[flat.field(x) for x in ("doc_offset", "n_tokens", "piece", "size")], pa.array(values)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "doc_offset", "n_tokens", "piece", "size", "value"])

    return blocks.mapInArrow(run, f"doc_id {id_type}, part int, doc_offset long, n_tokens long, piece long, size long, value {result}")


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _gf2_times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def crc32_combine(first: int, second: int, length: int) -> int:
    """crc32 of a joined text from the crc32 of its two parts and the bytes of the second."""
    matrix = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):  # one zero byte
        matrix = [_gf2_times(matrix, row) for row in matrix]
    while length:
        if length & 1:
            first = _gf2_times(matrix, first)
        matrix = [_gf2_times(matrix, row) for row in matrix]
        length >>= 1
    return first ^ second


def document_checksums(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a file set."""
    pieces = written(decoded(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "long", id_type), "pieces")
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    columns = ["doc_id", "part", "doc_offset", "n_tokens"]
    whole = pieces.where("size = n_tokens").select(*columns, F.col("value").alias("ids_crc32"))
    torn = pieces.where("size < n_tokens").groupBy("part", "doc_offset").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "size", "value"))).alias("pieces")
    )

    @F.udf("long")
    def joined(rows):
        out = rows[0]["value"]
        for r in rows[1:]:
            out = crc32_combine(out, r["value"], 4 * r["size"])
        return out

    every = whole.unionByName(torn.select(*columns, joined("pieces").alias("ids_crc32")))
    out = every.join(parts, "part")
    return out.select("doc_id", (F.col("base") + F.col("doc_offset")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """doc_id, start, ids of every document: the decoded file set."""
    pieces = decoded(spark, path, lambda ids: ids.tolist(), "array<long>", id_type)
    parts = spark.read.schema("part int, base long").parquet(f"{path}/parts")
    ordered = F.sort_array(F.collect_list(F.struct("piece", "value")))
    rows = pieces.groupBy("part", "doc_offset").agg(F.min("doc_id").alias("doc_id"), F.flatten(F.transform(ordered, lambda x: x["value"])).alias("ids"))
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("doc_offset")).alias("start"), "ids")
