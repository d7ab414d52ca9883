"""The record schemas at the three stages: text input, typed staging, and the table."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, order, types and required sets of the record format.
COLUMNS = (
    "ID",
    "Library_ID",
    "Sub_ID_1",
    "Sub_ID_2",
    "Sub_ID_3",
    "MW",
    "LogP",
    "FP1",
    "FP2",
    "FP3",
    "FP4",
    "FP5",
)
MEASURES = ("MW", "LogP")
REQUIRED = {
    "staging": ("ID",),
    "table": (
        "ID",
        "Library_ID",
        "Sub_ID_1",
        "Sub_ID_2",
        "MW",
        "LogP",
        "FP1",
        "FP2",
        "FP3",
    ),
}


def _record_schema(measure_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField(name, measure_type if name in MEASURES else T.StringType())
            for name in COLUMNS
        ]
    )


TEXT_SCHEMA = _record_schema(T.StringType())
STAGING_SCHEMA = _record_schema(T.FloatType())
TABLE_SCHEMA = _record_schema(T.DoubleType())

# Columns that travel with a row from the scan to the table.
SOURCE_PATH = "source_path"
CORRUPT_RECORD = "corrupt_record"
EXCESS_FIELDS = "excess_fields"
SOURCE_COLUMNS = (SOURCE_PATH, CORRUPT_RECORD, EXCESS_FIELDS)

# Reasons for rejection that are not the name of a missing column.
FIELD_COUNT = "FIELD_COUNT"
LIBRARY_NAME = "LIBRARY_NAME"

# What a rejected row keeps besides the twelve columns. All null on loaded rows.
REJECT_FIELDS = [
    T.StructField("reject_reasons", T.ArrayType(T.StringType())),
    T.StructField("Library_text", T.StringType()),
    T.StructField("MW_text", T.StringType()),
    T.StructField("LogP_text", T.StringType()),
    T.StructField(CORRUPT_RECORD, T.StringType()),
]

# Physical partitioning of the row store; see lakeload.sources.table.
PARTITION_COLUMNS = ("verdict", "src", "Library_ID")
LOADED = "loaded"
REJECTED = "rejected"

ROW_STORE_SCHEMA = T.StructType(
    TABLE_SCHEMA.fields
    + REJECT_FIELDS
    + [
        T.StructField("verdict", T.StringType()),
        T.StructField("src", T.StringType()),
    ]
)
