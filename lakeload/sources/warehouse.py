"""The warehouse table: loaded rows under a catalog name, by library and source, bucketed by ID.

The row store is where a load writes in one pass over the text; the warehouse is where its rows go
from there, as a table of Spark's catalog: partitioned by ``Library_ID``, then ``src``, and cut into
buckets by a hash of ``ID``, ordered by ``ID`` within each. The catalog knows its partitions, so a
lookup in a library lists that library only, and an ID is looked for in one bucket of each partition.
A load replaces the partitions of its own sources and registers no others.

Rows are dealt by ``REBALANCE`` on library, source and bucket: what is larger than the advisory size of
adaptive execution is split over several tasks and files, a hot library or ID too, and small ones share
a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.paths import glob_escape, normalize, qualify
from lakeload.functions.schema import LOADED, ROW_STORE_SCHEMA, TABLE_SCHEMA
from lakeload.sources.files import child_names, existing_folders, make_folder, remove_folder
from lakeload.sources.table import PARQUET_OPTIONS, rows_path, verdict_path

BUCKETS = 16
KEYS = ("Library_ID", "src")
# Data columns, then the partition columns, as the catalog orders them.
STORED = [f for f in TABLE_SCHEMA.fields if f.name not in KEYS]

Counts = dict[tuple[str, str], int]


def warehouse_path(root: str, buckets: int) -> str:
    # The number of buckets is in the name: files of another number must not be read with this one.
    return f"{root}/warehouse/buckets-{buckets}"


def open_warehouse(spark: SparkSession, name: str, root: str, buckets: int = BUCKETS) -> DataFrame:
    """The table of that name, made if absent.

    Where the catalog has forgotten a table whose files are there, as a session's own catalog does
    at its end, its partitions are found again, once. A name that belongs to another table is an
    error, and so is another number of buckets than the files have.
    """
    root = qualify(spark, root)
    location = warehouse_path(root, buckets)
    others = [n for n in child_names(spark, f"{root}/warehouse") if f"{root}/warehouse/{n}" != location]
    if others:
        raise ValueError(f"{root} has a warehouse of {', '.join(others)}")
    known = spark.catalog.tableExists(name)
    if not known:
        make_folder(spark, location)
        _create(spark, name, location, buckets)
        if child_names(spark, location):
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    if described is None or normalize(described.data_type).rstrip("/") != location:
        raise ValueError(f"{name} is not the warehouse of {root}")
    return spark.table(name)


def _create(spark: SparkSession, name: str, location: str, buckets: int) -> None:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORED)
    columns += "".join(f", {key} string" for key in KEYS)
    # Only the partitions that an insert has rows for are replaced.
    settings = {**PARQUET_OPTIONS, "partitionOverwriteMode": "dynamic"}
    options = ", ".join(f"'{key}' '{value}'" for key, value in settings.items())
    place = location.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS ({options}) "
        f"PARTITIONED BY ({', '.join(KEYS)}) CLUSTERED BY (ID) SORTED BY (ID) INTO {buckets} BUCKETS "
        f"LOCATION '{place}'"
    )


def _of(rows: DataFrame, sources: Iterable[str]) -> DataFrame:
    return rows.where(F.col("src").isin(sorted(set(sources))))


def held_rows(spark: SparkSession, name: str, sources: Sequence[str]) -> Counts:
    """Rows of these sources in the table, by source and verdict; partitions and footers are read."""
    if not sources:
        return {}
    counted = _of(spark.table(name), sources).groupBy("src").count().collect()
    return {(r.src, LOADED): r["count"] for r in counted}


def _partitions(rows: DataFrame) -> set[tuple[str | None, str]]:
    return {tuple(r) for r in rows.select(*KEYS).distinct().collect()}


def publish(spark: SparkSession, name: str, root: str, sources: Sequence[str], buckets: int) -> None:
    """Move the loaded rows of these sources from the row store into the table.

    They take the place of all that the table held of the sources. Safe to repeat after a crash
    anywhere: the row store gives up its rows last.
    """
    folders = existing_folders(spark, [f"{verdict_path(root, LOADED)}/src={s}" for s in sorted(set(sources))])
    held = _partitions(_of(spark.table(name), sources))
    written: set[tuple[str | None, str]] = set()
    if folders:
        rows = _stored(spark, root, folders)
        if held:  # of sources that came before, names of libraries
            written = _partitions(_of(rows, {src for _, src in held}))
        _insert(rows, name, buckets)
    for library, src in sorted(held - written, key=str):
        _drop(spark, name, warehouse_path(root, buckets), library, src)
    for folder in folders:
        remove_folder(spark, folder)


def _stored(spark: SparkSession, root: str, folders: Sequence[str]) -> DataFrame:
    read = spark.read.schema(ROW_STORE_SCHEMA).option("basePath", rows_path(root))
    rows = read.parquet(*[glob_escape(folder) for folder in folders])
    return rows.select(*[f.name for f in STORED], *KEYS)


def _insert(rows: DataFrame, name: str, buckets: int) -> None:
    bucket = F.pmod(F.hash("ID"), F.lit(buckets))  # the hash that buckets are made by
    dealt = rows.withColumn("_bucket", bucket).hint("rebalance", *KEYS, "_bucket").drop("_bucket")
    dealt.write.insertInto(name, overwrite=True)


def _drop(spark: SparkSession, name: str, location: str, library: str | None, src: str) -> None:
    """Remove a partition. Files first: what the catalog still names is found again after a crash."""
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    remove_folder(spark, f"{location}/{names.getPartitionPathString('Library_ID', library)}/src={src}")
    value = "null" if library is None else "'" + library.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (Library_ID = {value}, src = '{src}')")


def publish_all(spark: SparkSession, name: str, root: str, buckets: int = BUCKETS, at_once: int = 500) -> int:
    """Move all that the row store holds into the table, some sources at a time; returns how many.

    For a table that was loaded without a warehouse. No load may run meanwhile.
    """
    root = qualify(spark, root)
    open_warehouse(spark, name, root, buckets)
    names = sorted(n.removeprefix("src=") for n in child_names(spark, verdict_path(root, LOADED)) if n.startswith("src="))
    for start in range(0, len(names), at_once):
        publish(spark, name, root, names[start : start + at_once], buckets)
    return len(names)
