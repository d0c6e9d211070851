"""Helpers of the pipeline operators: tables in, written tables between jobs, rows without identity."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; ``spark.checkpoint.dir`` names it."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs read it again, whatever executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digest(*cols: Column) -> Column:
    """128-bit hex digest of columns; null differs from the empty string."""
    return F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])))


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """Schema of ``df`` with the fields of ``ddl`` behind its own."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


SLICE_BYTES = 1 << 20


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text", inside: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of the batches with about a megabyte of text each (a longer text is a part of its own), and their texts; a null
    text is empty.  ``inside`` names the struct column that holds ``text``."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(inside or text))
        column = pc.fill_null(pc.struct_field(column, text) if inside else column, "")
        total = np.cumsum(np.asarray(pc.binary_length(column), dtype=np.int64))
        at = 0
        while at < len(column):
            before = int(total[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, end - at), column.slice(at, end - at).cast(pa.large_binary()).to_pylist()
            at = end
