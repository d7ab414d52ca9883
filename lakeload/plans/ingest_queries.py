"""The ledger, incremental runs, replays, damaged files and clean-up."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.functions.paths import scratch_dir
from lakeload.plans.fixtures import (
    INBOX,
    RECORDS_CTE,
    VALID_SQL,
    event_records,
    label_of,
    new_damaged_inbox,
    new_inbox,
    new_mixed_inbox,
    write_inbox,
)
from lakeload.sources.discovery import discover_files
from lakeload.sources.ledger import (
    ENTRY_SCHEMA,
    LOADED,
    append_entries,
    create_ledger,
    pending_files,
    read_ledger,
)
from lakeload.sources.table import read_table
from lakeload.streaming.ingest import ingest, ingest_stream
from lakeload.streaming.progress import report, watched


def _label() -> Column:
    return label_of(F.col("path")).alias("label")


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when the ledger has consumed two of five libraries, and with the ledger
    ignored."""
    root = scratch_dir(spark, "ledger")
    create_ledger(spark, root)
    files = discover_files(spark, new_inbox(spark, sf_dir), ".gz", recursive=True)
    done = files.filter(_label().isin("1-URGENT", "5-LOW"))
    known = {"path": F.col("path"), "status": F.lit(LOADED)}
    entries = done.select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY_SCHEMA]
    )
    append_entries(entries, root, "earlier")
    ledger = read_ledger(spark, root)
    rest = pending_files(files, ledger).withColumn("mode", F.lit("skip known"))
    everything = pending_files(files, ledger, ignore_duplicates=False)
    return (
        rest.unionByName(everything.withColumn("mode", F.lit("take all")))
        .select("mode", _label())
        .distinct()
    )


PENDING_SQL = """
SELECT DISTINCT 'skip known' AS mode, o_orderpriority AS label FROM orders
WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT DISTINCT 'take all', o_orderpriority FROM orders"""

_MIDDLE_DAY = "2024-01-16"


def _two_deliveries(spark: SparkSession, sf_dir: str, root: str) -> str:
    """Files per day, delivered in two parts with a run after each; returns the inbox."""
    folder = scratch_dir(spark, "inbox")
    rows = event_records(spark, sf_dir)
    options = replace(INBOX, max_files=32)
    for delivery in (F.col("Sub_ID_2") < _MIDDLE_DAY, F.col("Sub_ID_2") >= _MIDDLE_DAY):
        write_inbox(rows.filter(delivery), "Sub_ID_2", folder)
        ingest_stream(spark, folder, root, options)
    return folder


def _rows_per_day(spark: SparkSession, root: str) -> DataFrame:
    """Rows per day, and how many loads its files went through."""
    loads = read_ledger(spark, root).groupBy("src").agg(
        F.countDistinct("load_id").alias("loads")
    )
    # Rows are counted per source ahead of the join, so that it sees a row per file.
    per_source = read_table(spark, root).groupBy("src", F.col("Sub_ID_2").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        per_source.join(loads, "src")
        .groupBy("day")
        .agg(F.sum("n").alias("n_rows"), F.max("loads").alias("n_loads"))
    )


def _rows_per_day_sql(loads: int) -> str:
    return f"""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_rows,
       CAST({loads} AS BIGINT) AS n_loads
FROM events GROUP BY 1"""


INCREMENTAL_SQL = _rows_per_day_sql(loads=1)
REPLAY_SQL = _rows_per_day_sql(loads=2)


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run takes only the new files."""
    root = scratch_dir(spark, "table")
    _two_deliveries(spark, sf_dir, root)
    return _rows_per_day(spark, root)


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both checkpoint and ledger are lost and everything is loaded again: no row is doubled."""
    root = scratch_dir(spark, "table")
    folder = _two_deliveries(spark, sf_dir, root)
    options = replace(INBOX, max_files=32, ignore_duplicates=False)
    ingest_stream(spark, folder, root, options, checkpoint=scratch_dir(spark, "checkpoint"))
    return _rows_per_day(spark, root)


def forced_reingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known files are taken again on demand; the ledger shows two loads of each, the table
    its rows once."""
    folder, root = new_inbox(spark, sf_dir), scratch_dir(spark, "table")
    ingest(spark, folder, root, options=INBOX)
    ingest(spark, folder, root, options=replace(INBOX, ignore_duplicates=False))
    loads = read_ledger(spark, root).groupBy("src").agg(
        F.countDistinct("load_id").alias("loads")
    )
    rows = read_table(spark, root).groupBy("src", "Library_ID").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        rows.join(loads, "src")
        .groupBy("Library_ID", "loads")
        .agg(F.sum("n").alias("n_rows"))
    )


FORCED_REINGEST_SQL = f"""{RECORDS_CTE}
SELECT Library_ID, CAST(2 AS BIGINT) AS loads, count(*) AS n_rows
FROM records WHERE {VALID_SQL} GROUP BY Library_ID"""


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one library are cut off and a listed file does not exist; the rest loads."""
    folder, root = new_damaged_inbox(spark, sf_dir), scratch_dir(spark, "table")
    entries = ingest(
        spark, folder, root, listed=[f"{folder}/label=none/absent.tsv.gz"], options=INBOX
    )
    return entries.groupBy(_label(), "status").agg(
        F.sum("rows_loaded").alias("rows_loaded"),
        F.sum("rows_rejected").alias("rows_rejected"),
    )


QUARANTINE_SQL = f"""{RECORDS_CTE}
SELECT Library_ID AS label,
       CASE Library_ID WHEN '5-LOW' THEN 'quarantined' ELSE 'loaded' END AS status,
       CAST(CASE Library_ID WHEN '5-LOW' THEN 0
            ELSE count(*) FILTER ({VALID_SQL}) END AS BIGINT) AS rows_loaded,
       CAST(CASE Library_ID WHEN '5-LOW' THEN 0
            ELSE count(*) FILTER (NOT ({VALID_SQL})) END AS BIGINT) AS rows_rejected
FROM records GROUP BY Library_ID
UNION ALL SELECT 'none', 'failed', CAST(0 AS BIGINT), CAST(0 AS BIGINT)"""


def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are in the table are removed; a quarantined one stays."""
    folder, root = new_damaged_inbox(spark, sf_dir), scratch_dir(spark, "table")
    entries = ingest(spark, folder, root, options=INBOX, delete_consumed=True)
    left = discover_files(spark, folder, ".tsv.gz", recursive=True).select("path")
    return (
        entries.join(left.withColumn("left", F.lit(1)), "path", "left")
        .groupBy(_label())
        .agg((F.count("left") > 0).alias("remains"))
    )


CLEANUP_SQL = """
SELECT DISTINCT o_orderpriority AS label, o_orderpriority = '5-LOW' AS remains FROM orders"""


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows loaded and rejected per library, and the columns that had no place."""
    root = scratch_dir(spark, "table")
    entries = ingest(spark, new_mixed_inbox(spark, sf_dir), root, options=INBOX)
    extra = F.concat_ws(",", F.col("extra_columns")).alias("extra")
    return entries.groupBy(_label(), extra).agg(
        F.sum("rows_loaded").alias("rows_loaded"),
        F.sum("rows_rejected").alias("rows_rejected"),
    )


LOAD_METRICS_SQL = f"""{RECORDS_CTE}
SELECT Library_ID AS label,
       CASE WHEN whole THEN '' ELSE 'Batch_Note' END AS extra,
       count(*) FILTER (whole AND {VALID_SQL}) AS rows_loaded,
       count(*) FILTER (NOT (whole AND {VALID_SQL})) AS rows_rejected
FROM (SELECT *, Library_ID IN ('1-URGENT', '2-HIGH') AS whole FROM records)
GROUP BY Library_ID, whole"""


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listener hears of two runs: files that are new in each batch, and what the ledger has of it."""
    root = scratch_dir(spark, "table")
    with watched(spark) as listener:
        _two_deliveries(spark, sf_dir, root)
    return report(spark, root, listener).select("batch", "new_files", "entries", "files_loaded", "rows_loaded")


RUN_PROGRESS_SQL = f"""
SELECT CAST(CASE WHEN day < '{_MIDDLE_DAY}' THEN 0 ELSE 1 END AS BIGINT) AS batch,
       count(DISTINCT day) AS new_files, count(DISTINCT day) AS entries, count(DISTINCT day) AS files_loaded,
       CAST(count(*) AS BIGINT) AS rows_loaded
FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) GROUP BY 1"""
