"""What ingest runs are doing, as their streams report it."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lakeload.sources.ledger import LOADED, read_ledger

# Name under which a stream's new names are observed.
NEW_NAMES = "new_names"
_SCHEMA = "query_id string, batch long, listed long, new_files long, milliseconds long"


def observed(names: DataFrame) -> DataFrame:
    """The names, counted as they pass; the count is part of the stream's progress."""
    return names.observe(NEW_NAMES, F.count(F.lit(1)).alias("files"))


class RunProgress(StreamingQueryListener):
    """Collects a row for each micro-batch: names listed, those of them that are new, and its time."""

    def __init__(self) -> None:
        self.batches: list[tuple[str, int, int, int, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        metrics = progress.observedMetrics.get(NEW_NAMES)
        if metrics is not None:  # a stream of ours, and a batch that has run
            row = (progress.id, progress.batchId, progress.numInputRows, metrics.files, progress.batchDuration)
            self.batches.append((str(row[0]), *row[1:]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        """The batches so far."""
        return spark.createDataFrame(self.batches, _SCHEMA)


@contextmanager
def watched(spark: SparkSession) -> Iterator[RunProgress]:
    """A listener for as long as the block lasts; at its end it has heard of all that happened in it."""
    listener = RunProgress()
    spark.streams.addListener(listener)
    try:
        yield listener
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)


def batch_of(load_id: Column) -> tuple[Column, Column]:
    """Query and micro-batch of a load that a stream has made, by the load's id."""
    parts = r"^(.*)-(\d{9})-\d{9}$"
    return F.regexp_extract(load_id, parts, 1), F.regexp_extract(load_id, parts, 2).try_cast("long")


def report(spark: SparkSession, root: str, listener: RunProgress) -> DataFrame:
    """Each micro-batch with what the ledger has of its loads: entries, loaded files, and rows.

    A file that an earlier run has consumed is new to a stream without a checkpoint, and has no entry.
    """
    query_id, batch = batch_of(F.col("load_id"))
    recorded = (
        read_ledger(spark, root)
        .groupBy(query_id.alias("query_id"), batch.alias("batch"))
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.count_if(F.col("status") == LOADED).alias("files_loaded"),
            F.sum("rows_loaded").alias("rows_loaded"),
            F.sum("rows_rejected").alias("rows_rejected"),
        )
    )
    return listener.frame(spark).join(recorded, ["query_id", "batch"], "left")
