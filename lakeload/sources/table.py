"""The row store: Parquet partitioned by verdict, source file and library, ordered by ID.

Loaded and rejected rows leave the scan in one write, told apart by the ``verdict`` partition;
two writes would decompress every input twice. ``src`` comes ahead of ``Library_ID`` so that all
rows of a source lie under one folder per verdict: a repeated load replaces them, and the counts
of a batch are read without listing the rest of the table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeload.functions.paths import glob_escape, normalize, qualify
from lakeload.functions.schema import (
    COLUMNS,
    LOADED,
    PARTITION_COLUMNS,
    REJECT_FIELDS,
    REJECTED,
    ROW_STORE_SCHEMA,
    SOURCE_PATH,
    TABLE_SCHEMA,
)
from lakeload.sources.files import existing_folders, make_folder

# A record is mostly vectors of digits, tens of kilobytes in all. They never repeat, so no
# dictionary is tried, and the fastest zstd level also packs them best. Small pages let the
# page index on the ordered ID column skip within a row group; the bloom filter on ID spares
# files whose range of IDs covers the one looked for. Its size follows the number of IDs in the
# row group, 2 kB to 1 MB: a lookup reads one for each row group it cannot rule out otherwise.
VECTOR_OPTIONS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    **{f"parquet.enable.dictionary#FP{i}": "false" for i in range(1, 6)},
}
PARQUET_OPTIONS = {
    **VECTOR_OPTIONS,
    "parquet.page.row.count.limit": "1024",
    "parquet.bloom.filter.enabled#ID": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.candidates.number#ID": "10",
}

STORED_FIELDS = [f for f in ROW_STORE_SCHEMA.fields if f.name not in PARTITION_COLUMNS]


def rows_path(root: str) -> str:
    return f"{root}/rows"


def verdict_path(root: str, verdict: str) -> str:
    return f"{rows_path(root)}/verdict={verdict}"


def create_table(spark: SparkSession, root: str) -> str:
    """Make the table's folders if absent; returns the qualified root. Safe to repeat."""
    root = qualify(spark, root)
    for verdict in (LOADED, REJECTED):
        make_folder(spark, verdict_path(root, verdict))
    return root


def to_row_store(classified: DataFrame) -> DataFrame:
    """Classified rows in the shape of the row store.

    Only loaded rows are laid out by library. Rejected ones of a source share a folder, lest a
    few of them in each library become as many files.
    """
    laid_out = {
        "src": F.md5(SOURCE_PATH),
        "Library_ID": F.when(F.col("verdict") == LOADED, F.col("Library_ID")),
    }
    return partition_ready(classified.withColumns(laid_out))


def partition_ready(rows: DataFrame) -> DataFrame:
    """Row-store rows whose partition columns are not nullable.

    A nullable text partition column would make the writer add a projection of its own and,
    with it, a second sort. Null and empty values share one folder, which reads back as null.
    """
    return rows.select(
        *[F.col(f.name) for f in STORED_FIELDS],
        *[F.coalesce(name, F.lit("")).alias(name) for name in PARTITION_COLUMNS],
    )


def append_rows(clustered: DataFrame, root: str, replace: bool = False) -> None:
    """Write clustered row-store rows.

    A plain append where the sources are new to the table; any output committer can do that.
    With ``replace`` the partitions that are written again are replaced.
    """
    (
        clustered.write.mode("overwrite" if replace else "append")
        .option("partitionOverwriteMode", "dynamic")
        .options(**PARQUET_OPTIONS)
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(rows_path(root))
    )


def source_folders(spark: SparkSession, root: str, sources: Iterable[str]) -> list[str]:
    """Existing folders of these sources, at most one per source and verdict."""
    return existing_folders(
        spark,
        [
            f"{rows_path(root)}/verdict={verdict}/src={source}"
            for verdict in (LOADED, REJECTED)
            for source in sorted(set(sources))
        ],
    )


def stored_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Data files below the folders, as a DataFrame of ``path`` and ``length``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load([glob_escape(folder) for folder in folders])
        .select("path", "length")
    )


def count_by_source(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    """Stored rows per ``src`` and ``verdict`` below the folders; reads Parquet footers only."""
    return (
        spark.read.schema(ROW_STORE_SCHEMA)
        .option("basePath", rows_path(root))
        .parquet(*[glob_escape(folder) for folder in folders])
        .groupBy("src", "verdict")
        .count()
    )


def _read_verdict(
    spark: SparkSession, root: str, verdict: str, fields: list[T.StructField]
) -> DataFrame:
    # The schema is explicit: inference would turn a library named 00 into the integer 0.
    schema = T.StructType([*fields, T.StructField("src", T.StringType())])
    return spark.read.schema(schema).parquet(
        f"{glob_escape(rows_path(qualify(spark, root)))}/verdict={verdict}"
    )


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """Loaded rows: the twelve columns in canonical order, then ``src``.

    Lists the table's folders now; keep the result for repeated lookups. Rows that were published
    to a warehouse table are read by its name instead.
    """
    return _read_verdict(spark, root, LOADED, TABLE_SCHEMA.fields).select(*COLUMNS, "src")


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Rejected rows: the twelve columns, what is known about the rejection, then ``src``."""
    rows = _read_verdict(spark, root, REJECTED, TABLE_SCHEMA.fields + REJECT_FIELDS)
    details = [f.name for f in REJECT_FIELDS if f.name != "Library_text"]
    named = rows.withColumn("Library_ID", F.col("Library_text"))
    return named.select(*COLUMNS, *details, "src")


def register_table(spark: SparkSession, name: str, root: str) -> None:
    """Make the loaded rows queryable by name in the session catalog.

    A name that belongs to a table elsewhere is an error, not a table to be taken for this one.
    The catalog learns here what folders there are; a warehouse table learns with each load.
    """
    root = create_table(spark, root)
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}"
        for f in [*TABLE_SCHEMA.fields, T.StructField("src", T.StringType())]
    )
    location = f"{rows_path(root)}/verdict={LOADED}".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"PARTITIONED BY (src, Library_ID) LOCATION '{location}'"
    )
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'")
    found = described.first()
    if found is None or normalize(found.data_type).rstrip("/") != f"{rows_path(root)}/verdict={LOADED}":
        raise ValueError(f"{name} is not the table at {root}")
    spark.sql(f"MSCK REPAIR TABLE {name}")
