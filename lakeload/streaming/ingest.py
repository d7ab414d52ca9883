"""Ingest runs: the file-name stream, explicit lists, retries and source clean-up."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.paths import glob_escape, qualify
from lakeload.sources.discovery import (
    LISTING,
    combine_files,
    discover_files,
    in_order,
    listed_files,
)
from lakeload.sources.files import file_facts, note_paths, remove_folder, remove_noted
from lakeload.sources.ledger import (
    FAILED,
    LOADED,
    create_ledger,
    latest_entries,
    merge_loads,
    pending_files,
    read_ledger,
    unconsumed,
)
from lakeload.sources.table import create_table
from lakeload.sources.warehouse import open_warehouse
from lakeload.streaming.load import IngestOptions, load_files
from lakeload.streaming.progress import observed

_NO_OPTIONS = IngestOptions()


def prepare(spark: SparkSession, root: str, options: IngestOptions = _NO_OPTIONS) -> str:
    """Make table, ledger and warehouse table if absent; returns the qualified root."""
    root = create_table(spark, root)
    create_ledger(spark, root)
    if options.warehouse:
        open_warehouse(spark, options.warehouse, root, options.buckets)
    return root


# How the stream keeps the names that it has seen: on the executors, in memory and on disk.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def ingest_stream(
    spark: SparkSession,
    folder: str,
    root: str,
    options: IngestOptions = _NO_OPTIONS,
    checkpoint: str | None = None,
) -> None:
    """Ingest the files of a folder that no earlier run has seen, then stop.

    A stream of file names, not of rows: files differ in their headers, and a row stream has
    one schema. Each run lists the folder, in tasks, and adds the listing to a table of names that the
    stream reads. What the stream has seen within ``max_file_age`` of the newest file is state on the
    executors, and is dropped; so an interrupted run goes on where it stopped. At the end the listing
    is compared with the ledger, in tasks, for files that came late and are older than that.
    """
    root = prepare(spark, root, options)
    run_id = uuid.uuid4().hex
    listings = f"{root}/listings"
    found = discover_files(spark, folder, options.extension, options.recursive)
    # The stream's own list is of these files of names, and not of the files that they name.
    found.write.mode("append").parquet(f"{listings}/run={run_id}")
    names = (
        spark.readStream.schema(LISTING)
        .option("recursiveFileLookup", True)
        .parquet(glob_escape(listings))
        .withWatermark("modificationTime", _interval(options.max_file_age))
        .dropDuplicatesWithinWatermark(["path"])
    )

    loads: list[int] = []

    def load(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        query_id = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        # Written down, since state should be asked once.
        note = f"{root}/_names/{query_id}-{batch_id:09d}"
        note_paths(batch, note)
        new = session.read.schema("path string").parquet(glob_escape(note))
        loads.append(_load_in_rounds(new, root, options, f"{query_id}-{batch_id:09d}", ask=True))
        remove_folder(session, note)

    with _settings(spark, _STATE):
        query = (
            observed(names).writeStream.foreachBatch(load)
            .option("checkpointLocation", checkpoint or f"{root}/_checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    listed = spark.read.schema(LISTING).parquet(glob_escape(f"{listings}/run={run_id}"))
    loads.append(_load_in_rounds(_unrecorded(listed, root), root, options, run_id))
    remove_folder(spark, listings)  # all of them have been through the stream
    if any(loads):  # else the ledger is as it was
        merge_loads(spark, root)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for as long as a query takes to start, which copies them."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _interval(age: str) -> str:
    """An age such as ``30d`` as an interval; one that is spelled as an interval stays."""
    units = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}
    short = re.fullmatch(r"(\d+)\s*([dhms])", age.strip())
    return f"{short[1]} {units[short[2]]}" if short else age


def ingest_files(
    files: DataFrame, root: str, options: IngestOptions = _NO_OPTIONS
) -> None:
    """Ingest the files in column ``path`` that are pending, a bounded number at a time.

    With ``ignore_duplicates`` off every file is read again and its rows are replaced.
    """
    spark = files.sparkSession
    root = prepare(spark, root, options)
    if "position" not in files.columns:
        files = files.withColumn("position", F.lit(None).cast("long"))
    once = files.groupBy("path").agg(F.min("position").alias("position"))
    pending = pending_files(once, read_ledger(spark, root), options.ignore_duplicates)
    _load_in_rounds(pending, root, options, uuid.uuid4().hex)


def _load_in_rounds(
    files: DataFrame, root: str, options: IngestOptions, run_id: str, ask: bool = False
) -> int:
    """Load files in order, a bounded number at a time; returns the number of loads.

    Sorted also because names come to the driver with one job per partition; after a sort there are
    few. With ``ask`` known files are left out: the ledger is read in the buckets of a round's files.
    """
    spark = files.sparkSession
    if "position" not in files.columns:
        files = files.withColumn("position", F.lit(None).cast("long"))
    names = (row.path for row in in_order(files).select("path").toLocalIterator())
    number = 0
    for paths in _rounds(names, options.files_per_load(spark)):
        if ask and options.ignore_duplicates:
            paths = unconsumed(spark, root, paths)
        load_files(spark, paths, root, f"{run_id}-{number:09d}", options)
        number += 1
    return number


def _unrecorded(files: DataFrame, root: str) -> DataFrame:
    """Files the ledger has no entry for, whatever their status."""
    return files.join(read_ledger(files.sparkSession, root).select("path"), "path", "left_anti")


def _rounds(names: Iterator[str], size: int) -> Iterator[list[str]]:
    while paths := list(islice(names, size)):
        yield paths


def retry_failed(
    spark: SparkSession, root: str, options: IngestOptions = _NO_OPTIONS
) -> None:
    """Try again the files whose last attempt failed; the stream itself has moved past them."""
    root = prepare(spark, root, options)
    entries = read_ledger(spark, root)
    has_failed = F.col("status") == FAILED
    if not entries.filter(has_failed).isEmpty():
        failed = latest_entries(entries).filter(has_failed)
        _load_in_rounds(failed.select("path"), root, options, uuid.uuid4().hex)


def ingest(
    spark: SparkSession,
    folder: str,
    root: str,
    listed: Sequence[str] = (),
    options: IngestOptions = _NO_OPTIONS,
    checkpoint: str | None = None,
    delete_consumed: bool = False,
) -> DataFrame:
    """One run: earlier failures, explicitly listed files, then what is new in the folder.

    Returns the last ledger entry of every file.
    """
    root = prepare(spark, root, options)
    retry_failed(spark, root, options)
    if options.ignore_duplicates:
        if listed:
            ingest_files(listed_files(spark, listed), root, options)
        ingest_stream(spark, folder, root, options, checkpoint)
    else:
        found = discover_files(spark, folder, options.extension, options.recursive)
        listed_and_found = combine_files(listed_files(spark, listed), found)
        ingest_files(listed_and_found, root, options)
    if delete_consumed:
        found = discover_files(spark, folder, options.extension, options.recursive)
        # Listed files may lie elsewhere.
        named = combine_files(listed_files(spark, listed), found).select("path")
        delete_loaded(file_facts(named), root)
    return latest_entries(read_ledger(spark, root))


def delete_loaded(files: DataFrame, root: str) -> int:
    """Remove source files that are safely in the table; returns how many.

    Runs after the stream has ended, never inside a batch: a replay needs its files. A file
    whose length or time of change is not that of the probe is kept, and so is every quarantined or failed one.
    """
    spark = files.sparkSession
    root = qualify(spark, root)
    entries = latest_entries(read_ledger(spark, root))
    loaded = entries.filter(F.col("status") == LOADED).select("path", "bytes", "modified")
    unchanged = files.join(loaded, "path").filter(
        (F.col("length") == F.col("bytes"))
        & (F.unix_millis("modificationTime") == F.col("modified"))
    )
    note = f"{root}/_removal/{uuid.uuid4().hex}"
    note_paths(unchanged, note)
    return remove_noted(spark, note)
