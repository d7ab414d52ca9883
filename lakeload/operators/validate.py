"""Required-column checks. Parquet does not enforce NOT NULL, so this is the only guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeload.functions.schema import (
    CORRUPT_RECORD,
    EXCESS_FIELDS,
    FIELD_COUNT,
    LIBRARY_NAME,
    LOADED,
    MEASURES,
    REJECTED,
    REQUIRED,
)
from lakeload.operators.align import cast_measures, widen_measures


# The folder name that stands for null, the characters that folder names escape, and
# the longest name of a folder in bytes.
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]"""
_FOLDER_BYTES = 255


def _unusable_library() -> Column:
    """Whether a library's name cannot be a folder: too long, or the name that stands for null."""
    name = F.col("Library_ID")
    escaped = F.length(name) - F.length(F.regexp_replace(name, _ESCAPED, ""))
    size = F.octet_length(name) + 2 * escaped + len("Library_ID=")
    return (size > _FOLDER_BYTES) | (name == _NULL_FOLDER)


def _missing(name: str) -> Column:
    # A partition value cannot be the empty string: the file layout stores it as null.
    if name == "Library_ID":
        return F.col(name).isNull() | (F.col(name) == "")
    return F.col(name).isNull()


def reject_reasons(level: str = "table", excess: Column | None = None) -> Column:
    """Comma-joined names of the required columns that are null; empty for a valid row.

    After them FIELD_COUNT where ``excess`` holds, a row with more fields than its header, whose
    values cannot be told apart, and LIBRARY_NAME for a library that cannot be stored as one.

    Text rather than an array at this point: joining skips nulls inside generated code.
    """
    checks = [F.when(_missing(name), F.lit(name)) for name in REQUIRED[level]]
    checks.append(F.when(_unusable_library(), F.lit(LIBRARY_NAME)))
    if excess is not None:
        checks.append(F.when(excess, F.lit(FIELD_COUNT)))
    return F.concat_ws(",", *checks)


def classify_rows(aligned: DataFrame, level: str = "table") -> DataFrame:
    """Type the measures and tell valid rows from rejected ones, in one pass.

    Takes aligned text rows. A rejected row keeps its reasons, the text of its library and
    measures and, when its field count did not fit the header, the raw line. Fields too few are no
    ground for rejection, since absent trailing fields are nulls; fields too many are.
    """
    texts = {f"{name}_text": F.col(name) for name in MEASURES}
    texts["Library_text"] = F.col("Library_ID")
    typed = widen_measures(cast_measures(aligned.withColumns(texts)))
    if CORRUPT_RECORD not in aligned.columns:
        typed = typed.withColumn(CORRUPT_RECORD, F.lit(None).cast("string"))
    excess = F.col(EXCESS_FIELDS) if EXCESS_FIELDS in aligned.columns else None
    checked = typed.withColumn("reasons", reject_reasons(level, excess))
    valid = F.col("reasons") == ""
    return checked.withColumns(
        {
            "verdict": F.when(valid, F.lit(LOADED)).otherwise(F.lit(REJECTED)),
            "reject_reasons": F.when(~valid, F.split("reasons", ",")),
            **{name: F.when(~valid, F.col(name)) for name in [CORRUPT_RECORD, *texts]},
        }
    ).drop("reasons")
