"""Bring any set of input columns to the canonical schema, by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.functions.schema import (
    COLUMNS,
    MEASURES,
    SOURCE_COLUMNS,
    STAGING_SCHEMA,
    TABLE_SCHEMA,
)


def matched_columns(names: Iterable[str]) -> dict[str, str]:
    """Canonical name -> input name, ignoring case. A name given twice matches nothing."""
    found: dict[str, list[str]] = {}
    for name in names:
        found.setdefault(name.lower(), []).append(name)
    return {c: found[c.lower()][0] for c in COLUMNS if len(found.get(c.lower(), [])) == 1}


def extra_columns(names: Iterable[str]) -> list[str]:
    """Input columns that have no place in the canonical schema, in input order."""
    names = list(names)
    used = set(matched_columns(names).values())
    return [n for n in names if n not in used]


def align_columns(df: DataFrame) -> DataFrame:
    """Select the twelve columns in canonical order; a missing one becomes a typed null.

    Extra columns are dropped; the columns that tell where a row came from are kept. One
    ``select``, so the scan below reads only what is matched.
    """
    source = {name: name for name in SOURCE_COLUMNS if name in df.columns}
    matched = matched_columns(n for n in df.columns if n not in source)
    aligned = [
        F.col(f"`{matched[name]}`").alias(name)
        if name in matched
        else F.lit(None).cast("string").alias(name)
        for name in COLUMNS
    ]
    return df.select(*aligned, *source)


def cast_measures(df: DataFrame) -> DataFrame:
    """Narrow the measures to float32; text that is not a number becomes null."""
    return df.withColumns(
        {name: F.col(name).try_cast(STAGING_SCHEMA[name].dataType) for name in MEASURES}
    )


def widen_measures(df: DataFrame) -> DataFrame:
    """Table type of the measures: the float32 value held as a double."""
    return df.withColumns(
        {name: F.col(name).cast(TABLE_SCHEMA[name].dataType) for name in MEASURES}
    )
