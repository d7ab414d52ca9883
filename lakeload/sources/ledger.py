"""The ledger: what happened to each input file, as Parquet.

Entries lie in buckets by a hash of the file's path, and within a bucket in a folder for each load. A
load looks at the buckets of its own files only. Once a bucket has many folders they are merged into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.functions.paths import glob_escape, qualify, source_key
from lakeload.sources.files import (
    children,
    existing_folders,
    make_folder,
    note_paths,
    path_frame,
    remove_noted_folders,
)

LOADED = "loaded"
QUARANTINED = "quarantined"
FAILED = "failed"
# A failed file stays pending.
CONSUMED = (LOADED, QUARANTINED)

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("modified", T.LongType()),
        T.StructField("rows_loaded", T.LongType()),
        T.StructField("rows_rejected", T.LongType()),
        T.StructField("extra_columns", T.ArrayType(T.StringType())),
        T.StructField("recorded_at", T.TimestampType()),
    ]
)
LEDGER_SCHEMA = T.StructType([*ENTRY_SCHEMA.fields, T.StructField("load_id", T.StringType())])
# A bucket is named by the first digits of the key of a file's path, a hash in hexadecimal digits.
DIGITS = 2
STORED_SCHEMA = T.StructType(
    [*LEDGER_SCHEMA.fields, T.StructField("bucket", T.StringType()), T.StructField("part", T.StringType())]
)
# Folders of loads in a bucket, beyond which they are merged.
MERGE_OVER = 64


def ledger_path(root: str) -> str:
    return f"{root}/ledger"


def create_ledger(spark: SparkSession, root: str) -> None:
    """Make the ledger's folder if absent."""
    make_folder(spark, ledger_path(qualify(spark, root)))


def bucket_of(path: Column) -> Column:
    """The bucket of a file: the first digits of its source key."""
    return F.substring(F.md5(path), 1, DIGITS)


def _write(entries: DataFrame, root: str, part: Column) -> None:
    # A file for each bucket that has an entry: never more than files were loaded.
    keyed = entries.withColumns({"bucket": bucket_of(F.col("path")), "part": part})
    (
        keyed.select(*STORED_SCHEMA.names)
        .repartition("bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "part")
        .parquet(ledger_path(root))
    )


def append_entries(entries: DataFrame, root: str, load_id: str) -> None:
    """Record the entries of one load. The same load recorded again replaces its entries."""
    _write(entries.withColumn("load_id", F.lit(load_id)), root, F.lit(load_id))


def _read(spark: SparkSession, root: str, folders: Sequence[str]) -> DataFrame:
    base = ledger_path(qualify(spark, root))
    read = spark.read.schema(STORED_SCHEMA).option("basePath", base)
    return read.parquet(*[glob_escape(folder) for folder in folders])


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """All entries ever recorded; a path that was tried more than once has several."""
    return _read(spark, root, [ledger_path(qualify(spark, root))]).select(*LEDGER_SCHEMA.names)


def read_entries(spark: SparkSession, root: str, paths: Iterable[str]) -> DataFrame:
    """Entries in the buckets of these paths, a bounded set; no other bucket is listed or read."""
    base = ledger_path(qualify(spark, root))
    buckets = sorted({source_key(path)[:DIGITS] for path in paths})
    folders = existing_folders(spark, [f"{base}/bucket={b}" for b in buckets])
    if not folders:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    # The names also as a filter, so that the plan tells what it reads.
    wanted = F.col("bucket").isin(*buckets)
    return _read(spark, root, folders).where(wanted).select(*LEDGER_SCHEMA.names)


def merge_loads(spark: SparkSession, root: str, over: int = MERGE_OVER) -> int:
    """Merge the loads in each bucket that has more than ``over`` of them; returns the buckets merged.

    Merged entries are written first, what they came from is removed after, so a crash in between loses
    nothing; entries that it leaves twice are made one by the next merge. No load may run meanwhile.
    """
    root = qualify(spark, root)
    buckets = children(path_frame(spark, [ledger_path(root)])).where("is_folder").select("path")
    parts = children(buckets.repartition(spark.sparkContext.defaultParallelism)).where("is_folder")
    bucket = F.regexp_extract("path", "/(bucket=[^/]*)/[^/]*$", 1).alias("name")
    crowded = parts.groupBy(bucket).count().where(F.col("count") > over).select("name")
    names = [r.name for r in crowded.collect()]  # buckets, 16 ** DIGITS at most
    if not names:
        return 0
    folders = [f"{ledger_path(root)}/{name}" for name in names]
    note = f"{root}/_merged/{uuid.uuid4().hex}"
    note_paths(children(path_frame(spark, folders)).where("is_folder"), note)
    old = _read(spark, root, folders).select(*LEDGER_SCHEMA.names).distinct()
    _write(old, root, F.lit(f"merged-{uuid.uuid4().hex}"))
    remove_noted_folders(spark, note)
    return len(names)


def latest_entries(ledger: DataFrame) -> DataFrame:
    """The last entry of each path."""
    fields = [f.name for f in LEDGER_SCHEMA if f.name != "path"]
    last = F.max_by(F.struct(*fields), F.struct("recorded_at", "load_id")).alias("last")
    return ledger.groupBy("path").agg(last).select("path", "last.*")


def consumed_paths(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("status").isin(*CONSUMED)).select("path")


def pending_files(
    files: DataFrame, ledger: DataFrame, ignore_duplicates: bool = True
) -> DataFrame:
    """Files that are still to be ingested: all of them, or those the ledger has not consumed.

    A path identifies a file: one that is delivered again with new content counts as consumed.
    """
    if not ignore_duplicates:
        return files
    return files.join(consumed_paths(ledger), "path", "left_anti")


def unconsumed(spark: SparkSession, root: str, paths: Sequence[str]) -> list[str]:
    """Those of a bounded set of paths that the ledger has not consumed, in the same order."""
    known = read_entries(spark, root, paths)
    pending = pending_files(path_frame(spark, paths), known)
    left = {row.path for row in pending.collect()}
    return [path for path in paths if path in left]
