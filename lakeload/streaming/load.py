"""Loading one bounded set of files into the table, safe to repeat."""

from __future__ import annotations

import datetime
import logging
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.paths import glob_escape, source_key
from lakeload.functions.schema import REJECTED, ROW_STORE_SCHEMA
from lakeload.operators.align import extra_columns
from lakeload.operators.layout import cluster_across, cluster_within
from lakeload.operators.validate import classify_rows
from lakeload.sources import ledger, table, warehouse
from lakeload.sources.discovery import DEFAULT_EXTENSION
from lakeload.sources.files import note_paths, path_frame, remove_folder, remove_noted
from lakeload.sources.probe import probe_headers, verify_files
from lakeload.sources.tsv import group_by_width, read_aligned
from lakeload.sources.warehouse import BUCKETS

_LOG = logging.getLogger(__name__)

# Row counts by (source key, verdict).
Counts = dict[tuple[str, str], int]


@dataclass(frozen=True)
class IngestOptions:
    """Settings of an ingest run.

    ``max_files``: files in one load; by default enough to keep every core busy twice.
    ``partitions``: ranges of IDs, each written by a task of its own, that every source file is
    spread over, whatever its size; a file larger than ``file_bytes`` gets one for each such part
    of it, if that is more. A source with one range is ordered and written by the task that
    scans it, without a shuffle.
    ``max_file_age``: the stream forgets the names of files that are older than the newest one by
    so much; such files, should they come late, are found by the ledger.
    ``warehouse``: the catalog name of a warehouse table, of ``buckets`` buckets, that each load moves its
    rows to; without one they stay in the row store.
    ``verify_first``: decompress every file once before loading. By default only the files of
    a load that failed are examined, which saves a pass over the input.
    """

    level: str = "table"
    extension: str = DEFAULT_EXTENSION
    recursive: bool = False
    ignore_duplicates: bool = True
    max_files: int | None = None
    partitions: int = 1
    file_bytes: int = 256 << 20
    max_file_age: str = "30d"
    verify_first: bool = False
    scans_per_write: int = 32
    warehouse: str | None = None
    buckets: int = BUCKETS

    def files_per_load(self, spark: SparkSession) -> int:
        return self.max_files or max(500, 2 * spark.sparkContext.defaultParallelism)

    def ranges(self, length: int) -> int:
        """Ranges of IDs that a source file of this length is spread over."""
        return max(1, self.partitions, -(-length // self.file_bytes))


@dataclass
class Outcome:
    """What a load has decided about its files so far."""

    refused: dict[str, tuple[str, str]] = field(default_factory=dict)
    counts: Counts = field(default_factory=dict)


def load_files(
    spark: SparkSession,
    paths: Sequence[str],
    root: str,
    load_id: str,
    options: IngestOptions,
) -> None:
    """Load the files of one micro-batch and record each in the ledger.

    Rows first, ledger second, the caller's checkpoint last: a crash in between repeats the
    load, and the repeat replaces every row and entry the first attempt wrote.
    """
    if not paths:
        return
    probed = probe_headers(path_frame(spark, paths)).collect()
    outcome = Outcome(refused={f.path: (f.status, f.reason) for f in probed if f.status})
    sound = [f for f in probed if not f.status]
    if options.verify_first:
        sound = _quarantine_damaged(spark, sound, outcome)
    _write_sound(spark, sound, root, load_id, options, outcome)
    for leftover in (_staging_path(root, load_id), _stale_path(root, load_id)):
        remove_folder(spark, leftover)
    # A refused file may have rows in the table from an earlier delivery; they stay.
    kept = [source_key(path) for path in outcome.refused]
    outcome.counts.update(_count_rows(spark, root, kept))
    if options.warehouse:
        outcome.counts.update(warehouse.held_rows(spark, options.warehouse, kept))
    entries = [_entry(file, outcome) for file in probed]
    ledger.append_entries(
        spark.createDataFrame(entries, ledger.ENTRY_SCHEMA), root, load_id
    )


def _staging_path(root: str, load_id: str) -> str:
    return f"{root}/_staging/{load_id}"


def _stale_path(root: str, load_id: str) -> str:
    return f"{root}/_stale/{load_id}"


def _write_sound(
    spark: SparkSession,
    files: list[Row],
    root: str,
    load_id: str,
    options: IngestOptions,
    outcome: Outcome,
) -> None:
    """Write all files together; on an error set the damaged ones aside and write the rest.

    An error of Spark's that is no scan's (a full disk, a lost permission, a cancelled job) is no
    file's fault: it ends the load, and its files stay pending.
    """
    if not options.verify_first:
        try:
            outcome.counts.update(_write(spark, files, root, load_id, options))
            return
        except Exception as error:
            if _is_systemic(error):
                raise
            _LOG.warning("load %s failed, looking for damaged files", load_id, exc_info=True)
            files = _quarantine_damaged(spark, files, outcome)
    _write_or_refuse(spark, files, root, load_id, options, outcome)


def _write_or_refuse(
    spark: SparkSession,
    files: list[Row],
    root: str,
    load_id: str,
    options: IngestOptions,
    outcome: Outcome,
) -> None:
    """Write the files together or, on an error, in halves, down to the files that fail.

    A few bad files among many cost a few more writes, and none of the good ones is held back.
    """
    try:
        outcome.counts.update(_write(spark, files, root, load_id, options))
    except Exception as error:
        if _is_systemic(error):
            raise
        if len(files) == 1:
            _LOG.warning("file %s failed", files[0].path, exc_info=True)
            outcome.refused[files[0].path] = (ledger.FAILED, _first_line(error))
            return
        middle = len(files) // 2
        for half in (files[:middle], files[middle:]):
            _write_or_refuse(spark, half, root, load_id, options, outcome)


def _quarantine_damaged(spark: SparkSession, files: list[Row], outcome: Outcome) -> list[Row]:
    if not files:
        return files
    verified = verify_files(path_frame(spark, (f.path for f in files)))
    damaged = {r.path: r.reason for r in verified.filter("reason is not null").collect()}
    outcome.refused.update(
        {path: (ledger.QUARANTINED, reason) for path, reason in damaged.items()}
    )
    return [f for f in files if f.path not in damaged]


def _write(
    spark: SparkSession, files: list[Row], root: str, load_id: str, options: IngestOptions
) -> Counts:
    """Put the rows of the files into the table and return what it then holds of them."""
    if not files:
        return {}
    sources = [source_key(f.path) for f in files]
    stale = _note_stored_files(spark, root, sources, load_id)
    split = [f for f in files if options.ranges(f.length) > 1]
    whole = [f for f in files if options.ranges(f.length) == 1]
    rows_seen = 0
    for group in _scan_batches(whole, options.scans_per_write):
        rows_seen += _observed(
            _classified(spark, group, options),
            lambda rows: table.append_rows(cluster_within(rows), root, replace=bool(stale)),
        )
    for group in _scan_batches(split, options.scans_per_write):
        rows_seen += _write_split(spark, group, root, load_id, options, bool(stale))
    if stale:
        remove_noted(spark, stale)
    counts = _count_rows(spark, root, sources)
    if sum(counts.values()) != rows_seen:
        raise RuntimeError(
            f"scanned {rows_seen} rows but the table holds {sum(counts.values())}"
        )
    if options.warehouse:
        warehouse.publish(spark, options.warehouse, root, sources, options.buckets)
    return counts


def _classified(spark: SparkSession, files: list[Row], options: IngestOptions) -> DataFrame:
    return table.to_row_store(classify_rows(read_aligned(spark, files), options.level))


def _write_split(
    spark: SparkSession,
    files: list[Row],
    root: str,
    load_id: str,
    options: IngestOptions,
    replace: bool,
) -> int:
    """Write files that get several ranges: to a staged Parquet folder first, from there in ranges.

    gzip is read by one task per file, and range partitioning samples its input: straight from
    the text that would be two slow passes. The staged copy can be split, so the sampling, the
    shuffle and the sort run in parallel. It is removed at the end of the load.
    """
    staged = _staging_path(root, load_id)
    rows_seen = _observed(
        _classified(spark, files, options),
        lambda df: df.write.mode("overwrite")
        .options(**table.VECTOR_OPTIONS)
        .option("maxRecordsPerFile", 100_000)
        .parquet(staged),
    )
    partitions = sum(options.ranges(f.length) for f in files)
    rows = table.partition_ready(
        spark.read.schema(ROW_STORE_SCHEMA).parquet(glob_escape(staged))
    )
    table.append_rows(cluster_across(rows, partitions), root, replace)
    return rows_seen


def _scan_batches(files: list[Row], scans: int) -> Iterable[list[Row]]:
    """Files in runs of at most ``scans`` numbers of columns, to bound the size of a plan."""
    groups = group_by_width(files)
    for start in range(0, len(groups), scans):
        yield [file for group in groups[start : start + scans] for file in group]


def _observed(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Run a write and return the number of rows that went through it."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def _note_stored_files(
    spark: SparkSession, root: str, sources: list[str], load_id: str
) -> str | None:
    """Write down which files the table already holds for these sources, if any.

    The write replaces partition by partition; what an earlier version of a source left in
    partitions the new one does not touch has to go afterwards. Kept as a table, since a large
    source may have very many files.
    """
    folders = table.source_folders(spark, root, sources)
    if not folders:
        return None
    note = _stale_path(root, load_id)
    note_paths(table.stored_files(spark, folders), note)
    return note


def _count_rows(spark: SparkSession, root: str, sources: list[str]) -> Counts:
    folders = table.source_folders(spark, root, sources)
    if not folders:
        return {}
    counted = table.count_by_source(spark, root, folders).collect()
    return {(r.src, r.verdict): r["count"] for r in counted}


def _entry(file: Row, outcome: Outcome) -> tuple:
    src = source_key(file.path)
    status, reason = outcome.refused.get(file.path, (ledger.LOADED, None))
    return (
        file.path,
        src,
        status,
        reason,
        file.length,
        file.modified,
        outcome.counts.get((src, ledger.LOADED), 0),
        outcome.counts.get((src, REJECTED), 0),
        extra_columns(file.header) if file.header else [],
        datetime.datetime.now(datetime.timezone.utc),
    )


# Conditions of errors that are a file's: it cannot be read to its end, or it is not there.
_FILE_CONDITIONS = ("FAILED_READ_FILE", "PATH_NOT_FOUND")
# Whoever asks has no right to read: classes of errors, by their simple names.
_REFUSALS = (
    "AccessControlException",
    "AccessDeniedException",
    "AWSAccessDeniedException",
    "CredentialInitializationException",
    "NoAuthWithAWSException",
    "NoAwsCredentialsException",
)
_LOST_FILE = "FileNotFoundException"  # also what a local file without permission gives


@dataclass(frozen=True)
class Cause:
    """One error of a chain: its class, Spark's condition and SQLSTATE where it has them, its text."""

    kind: str
    condition: str | None
    state: str | None
    text: str


def _told(throwable, method: str) -> str | None:
    """What a Java error tells under this method, if it is an error of Spark's."""
    try:
        return getattr(throwable, method)()
    except (Py4JError, TypeError):
        return None


def _causes(error: Exception) -> list[Cause]:
    """The Java errors behind an error, the innermost last; none if it is Python's own."""
    found, throwable = [], getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while throwable is not None:
        kind = throwable.getClass().getSimpleName()
        condition, state = (_told(throwable, m) for m in ("getCondition", "getSqlState"))
        found.append(Cause(kind, condition, state, throwable.toString()))
        throwable = throwable.getCause()
    return found


def _refused(cause: Cause) -> bool:
    return cause.kind in _REFUSALS or (cause.kind == _LOST_FILE and "Permission denied" in cause.text)


def _is_systemic(error: Exception) -> bool:
    """Whether Spark failed for a reason that no file has, so that none is to blame.

    That is so unless an error of the chain is a file's by its condition, and also where the store
    refuses to be read, for then no file can be.
    """
    causes = _causes(error)
    of_file = any((c.condition or "").partition(".")[0] in _FILE_CONDITIONS for c in causes)
    return bool(causes) and (not of_file or any(_refused(c) for c in causes))


def _first_line(error: Exception) -> str:
    """First line of the innermost Java cause, or of the error itself; Spark's condition ahead of it."""
    causes = _causes(error)
    text = causes[-1].text if causes else str(error)
    line = next(iter(text.strip().splitlines()), type(error).__name__)
    conditions = [f"{c.condition} {c.state or ''}".strip() for c in causes if c.condition]
    return f"[{conditions[-1]}] {line}" if conditions and conditions[-1].split()[0] not in line else line
