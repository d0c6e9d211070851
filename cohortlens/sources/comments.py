"""Reading and writing comment tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cohortlens.operators.clean import first_per_key

RAW_SCHEMA = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "id", "author", "body", "created_utc", "subreddit", "link_id", "parent_id", "score", "author_flair_text"
        )
    ]
    + [T.StructField("_corrupt", T.StringType())]
)


def read_jsonl(spark: SparkSession, path: str | Sequence[str], keep_corrupt: bool = False) -> DataFrame:
    """JSON lines by path or glob, with the file, the split start and the row's place in it.

    Blank lines are skipped by the reader, malformed ones are dropped unless asked for.
    ``_pos`` grows with the line number inside a file.
    """
    df = (
        spark.read.schema(RAW_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_folder"), F.col("_metadata.file_block_start").alias("_block"))
        .withColumn("_pos", F.struct("_block", F.monotonically_increasing_id().alias("_row")))
        .drop("_block")
    )
    # the test also reads a field: a scan that needs the corrupt column alone is refused
    ok = F.concat_ws("", F.substring("id", 1, 0), "_corrupt") == ""
    return df if keep_corrupt else df.where(ok).drop("_corrupt")


def line_counts(lines: DataFrame, file: Column) -> DataFrame:
    """Parsed and malformed lines per file (``lines`` read with ``keep_corrupt``).

    A field besides the corrupt one has to be read, or the scan is refused.
    """
    field = F.hash("id")
    return lines.groupBy(file.alias("_file")).agg(
        F.count(F.when(F.col("_corrupt").isNull(), field)).alias("parsed"),
        F.count(F.when(F.col("_corrupt").isNotNull(), field)).alias("malformed"),
    )


def corrupt_counts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return line_counts(read_jsonl(spark, path, keep_corrupt=True), F.col("_file"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Rows of a scan dealt to ``partitions`` by key before costly text work; without a number the scan stays as it is.

    For tables in a few unsplittable files; large tables have splits enough.
    """
    return df.repartition(partitions, key) if partitions else df


def read_text_table(spark: SparkSession, path: str, text: str = "body", fmt: str | None = None) -> DataFrame:
    """CSV or JSON table of texts without the null ones."""
    fmt = fmt or ("json" if path.rstrip("/").endswith((".json", ".jsonl")) else "csv")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path).na.drop(subset=[text])


def lenient_score(c: Column) -> Column:
    """Whole part of a number between 1 and 5, else null."""
    n = c.try_cast("double")
    return F.when((n >= 1) & (n < 6), F.floor(n).cast("int"))


def read_annotations(
    spark: SparkSession,
    path: str,
    rater: str | None = None,
    score_header: str = "your score",
    reasoning_header: str = "reasoning",
) -> DataFrame:
    """An annotation sheet: quoted multi-line text, lenient item numbers and scores.

    Headers are matched by their lower-cased beginning; an answer key passes its own two.
    """
    sheet = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("lineSep", "\n").csv(path)
    )
    by_prefix = {c.lower(): c for c in sheet.columns}

    def pick(start: str) -> Column:
        name = next((v for k, v in by_prefix.items() if k.startswith(start)), None)
        return F.col(f"`{name}`") if name else F.lit(None).cast("string")

    out = sheet.select(
        pick("item").try_cast("double").try_cast("int").alias("item"),
        pick("comment text").alias("text"),
        pick("subreddit").alias("subreddit"),
        lenient_score(pick(score_header)).alias("score"),
        pick(reasoning_header).alias("reasoning"),
        pick("your confidence").alias("confidence"),
    ).where(F.col("item").isNotNull())
    return out.withColumn("rater", F.lit(rater)) if rater else out


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def merged(existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("author", "subreddit")) -> DataFrame:
    """Union that keeps the existing row of a key."""
    both = existing.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    return first_per_key(both, list(keys), ["_gen", *rest]).drop("_gen")


def complete_folders(spark: SparkSession, parent: str) -> list[str]:
    """Folders that Spark has marked complete, by name; none if ``parent`` is not there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(parent)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    paths = [x.getPath() for x in fs.listStatus(folder)]
    done = [p for p in paths if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(p.toString() for p in done)


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _generations(spark: SparkSession, path: str) -> list[str]:
    """Complete merges of a table, oldest first."""
    return complete_folders(spark, f"{path.rstrip('/')}__merged")


def current(spark: SparkSession, path: str) -> str:
    """Folder of the newest complete merge of a table, or the table itself."""
    return ([path] + _generations(spark, path))[-1]


def merge_save(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str] = ("author", "subreddit")) -> str:
    """Merge new rows into a table as a new generation beside it; returns the written folder.

    A generation counts when Spark has marked it complete, so readers of ``current`` never see half a merge, and the
    input is never the folder being written: a lost executor can always re-read it.  The next call goes on from there.
    """
    number = len(_generations(spark, path)) + 1
    target = f"{path.rstrip('/')}__merged/{number:08d}-{uuid.uuid4().hex}"
    write(merged(spark.read.parquet(current(spark, path)), new, keys), target, mode="errorifexists")
    return target


def pending(todo: DataFrame, done: DataFrame, key: str = "id", source: str = "source") -> DataFrame:
    """Rows still to be scored; failed ones count as not done."""
    return todo.join(done.where(F.col(source) != "error").select(key), key, "left_anti")
