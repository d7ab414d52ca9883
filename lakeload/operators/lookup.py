"""Queries over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.functions.schema import COLUMNS


def lookup_by_id(table: DataFrame, target_id: str, library_id: str | None = None) -> DataFrame:
    """All rows with this ID, in canonical column order. An ID need not be unique.

    A typed predicate, never query text: it reaches the scan, where footers, bloom filters and
    page indexes on the ordered ID column skip the rest. A known library prunes partitions too.
    """
    hits = table.filter(F.col("ID") == F.lit(target_id))
    if library_id is not None:
        hits = hits.filter(F.col("Library_ID") == F.lit(library_id))
    return hits.select(*COLUMNS)


def preview(table: DataFrame, rows: int = 4) -> DataFrame:
    """The first rows by ID, three columns: a top-k, each task keeps ``rows`` candidates."""
    return (
        table.select("ID", "Library_ID", "Sub_ID_3")
        .orderBy("ID", "Library_ID", "Sub_ID_3")
        .limit(rows)
    )
