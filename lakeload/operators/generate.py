"""Sample records, generated on the executors from row numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.hashing import coin, digest, int_vectors, random_key, uniform
from lakeload.functions.schema import COLUMNS

# Key lengths, measure ranges and vector length of a sample record.
ID_LENGTH = 10
LIBRARY_LENGTH = 4
SUB_ID_LENGTH = 3
MW_MAX = 100
LOGP_MAX = 10
FINGERPRINT_LENGTH = 2048

# A record is tens of kilobytes; this keeps a task's output near a hundred megabytes.
ROWS_PER_TASK = 4000

_DENSE_FINGERPRINTS = ("FP1", "FP2", "FP3")
_SPARSE_FINGERPRINTS = ("FP4", "FP5")


def generate_records(
    rows: DataFrame,
    row_id: str = "id",
    file_name: str = "file_name",
    fingerprint_length: int = FINGERPRINT_LENGTH,
) -> DataFrame:
    """One record per input row; rows that share a file name share a library.

    Keeps ``file_name`` as a thirteenth column, for a sink that writes one folder per file.
    No shuffle: every value is an expression over the row's own number and file name. A record
    is far wider than the row it is made from, so ``rows`` should come in narrow partitions;
    see ``task_count``.
    """

    def row_digest(tag: str) -> Column:
        return digest(tag, F.col(file_name), F.col(row_id))

    columns = {
        "ID": random_key(row_digest("ID"), ID_LENGTH),
        "Library_ID": random_key(digest("Library_ID", F.col(file_name)), LIBRARY_LENGTH),
        "MW": uniform(row_digest("MW"), MW_MAX),
        "LogP": uniform(row_digest("LogP"), LOGP_MAX),
    }
    for name in ("Sub_ID_1", "Sub_ID_2", "Sub_ID_3"):
        columns[name] = random_key(row_digest(name), SUB_ID_LENGTH)
    digests = {name: row_digest(name) for name in _DENSE_FINGERPRINTS}
    for name in _SPARSE_FINGERPRINTS:
        digests[name] = F.when(coin(row_digest(name + " present")), row_digest(name))
    made = rows.withColumn("_vectors", int_vectors(digests, fingerprint_length))
    columns |= {name: F.col("_vectors")[name] for name in digests}
    return made.select(
        *[columns[name].alias(name) for name in COLUMNS], F.col(file_name).alias("file_name")
    )


def task_count(spark: SparkSession, rows: int) -> int:
    """Partitions to generate this many records in: enough for every core, none too large."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def sample_records(
    spark: SparkSession,
    rows_per_file: dict[str, int],
    fingerprint_length: int = FINGERPRINT_LENGTH,
) -> DataFrame:
    """Records for a set of named files, given the row count of each."""
    parts = [
        spark.range(0, count, 1, task_count(spark, count)).select(
            "id", F.lit(name).alias("file_name")
        )
        for name, count in rows_per_file.items()
    ]
    return generate_records(
        reduce(DataFrame.unionByName, parts), fingerprint_length=fingerprint_length
    )
