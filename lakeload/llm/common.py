"""What the operators share: text slices in tasks, written intermediates, checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.paths import scratch_dir
from lakeload.sources.files import remove_folder

# Rows a join side may have to be broadcast; they are keys and numbers, some 50 bytes each.
BROADCAST_ROWS = 1_000_000
# Bytes of text a task works on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 20


def text_of(column: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written as Parquet to the session's shared folder and read from there.

    Cuts the lineage: a lost executor costs a read, not the work before it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.written_path = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Remove what ``written`` has made, once all that is read from it has been written in turn.

    Of a table that was not written as it is, nothing is removed.
    """
    for df in tables:
        if getattr(df, "written_path", None):
            remove_folder(df.sparkSession, df.written_path)


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows with a broadcast hint if there are few enough, else as they are, for a shuffle.

    Call it on a written table: the rows are counted, up to one more than allowed.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def give_back() -> None:
    """Return memory that a worker has freed to the machine, for the tasks of other stages.

    Workers live on between stages; without this each keeps the most that any stage needed.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may lack it
    if trim is not None:
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches cut at ``size`` bytes of text; a slice holds one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, length in enumerate(lengths):
            if i > start and held + length > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += length
        if start < len(lengths):
            yield batch.slice(start)
        give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> list[Column]:
    """Columns that tell a document's rows apart: its id and a hash of its text.

    Rows equal in both are interchangeable for every operator that uses the key.
    """
    return [F.col("doc_id"), F.xxhash64(text_of()).alias("text_key")]


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose (doc_id, text_key) is not among ``keys``; null ids compare as equal.

    ``keys`` is a written table; it is broadcast when small, else both sides are shuffled.
    """
    keys = checked_broadcast(keys.select(F.col("doc_id").alias("_k1"), F.col("text_key").alias("_k2")))
    same = docs["doc_id"].eqNullSafe(F.col("_k1")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("_k2"))
    return docs.join(keys, same, "left_anti")
