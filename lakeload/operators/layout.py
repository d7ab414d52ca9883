"""Distribution and ordering of rows ahead of a write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PARTITIONS = 10  # fixed value: partitions a file is spread over
CLUSTER_KEYS = ("verdict", "src", "Library_ID", "ID")


def spread(df: DataFrame, partitions: int = DEFAULT_PARTITIONS) -> DataFrame:
    """Deal the rows evenly over ``partitions``, whatever their keys."""
    return df.repartition(partitions)


def cluster_within(df: DataFrame, keys: tuple[str, ...] = CLUSTER_KEYS) -> DataFrame:
    """Order each partition by the keys. No shuffle.

    Enough for a source file that one task reads: all of its rows are already together.
    """
    return df.sortWithinPartitions(*keys)


def cluster_across(
    df: DataFrame, partitions: int, keys: tuple[str, ...] = CLUSTER_KEYS
) -> DataFrame:
    """Range-partition by the keys, then order each partition.

    Output files hold disjoint key ranges, so a lookup can skip all but a few. The row's
    position breaks ties: a key that holds a third of all rows is cut into several ranges
    instead of filling one task. Positions come from the scan, so a recomputed task yields
    the same ones.
    """
    tie = "_position"
    return (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(partitions, *keys, tie)
        .sortWithinPartitions(*keys)
        .drop(tie)
    )
