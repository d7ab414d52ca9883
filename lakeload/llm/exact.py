"""Exact duplicates with a heavy-hitter split.

Texts are equal when they are identical after each run of blanks (space, tab, line feed, vertical
tab, form feed, carriage return) has become one space; they are compared by the SHA-256 of that
form. A Misra-Gries summary of each partition finds the digests that may be frequent, an exact
count verifies them, and the verified ones are broadcast with their row that stays: a frequent
text is removed map-side and never shuffled. All other digests are grouped by an ordinary shuffle.

``HEAVY`` is the least share of all rows that makes a digest frequent, so there are 1 / HEAVY of them
at most, and a partition's summary holds 4 / HEAVY counters. Both change what a run costs, not
what it finds.

Results for odd input: a null text counts as the empty one; a null id is greater than all others,
so such a row stays only among its like; of rows alike in id and text one stays; texts are read
whole; empty tables give no rows; other columns are not read, and may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import checked_broadcast, text_of, written

HEAVY = 1 / 1024
# Least row of a group in this order stays: known ids first, then by id, then as they were read.
ORDER = ("unknown", "doc_id", "row")


def normalized(text: Column) -> Column:
    """The text with each run of blanks made one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def digest_of(column: str = "text") -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalized(text_of(column)), 256))


class Summary:
    """A Misra-Gries summary: at most ``size`` counters, none below the true count by over ``lost``."""

    def __init__(self, size: int):
        self.size, self.lost, self.counters = size, 0, {}

    def add(self, digests: list[bytes], counts: list[int]) -> None:
        for digest, count in zip(digests, counts, strict=True):
            self.counters[digest] = self.counters.get(digest, 0) + count
        if len(self.counters) > self.size:
            # Taking the next largest count off all of them is as many ordinary steps at once.
            kept = np.fromiter(self.counters.values(), np.int64, len(self.counters))
            step = int(np.partition(kept, -(self.size + 1))[-(self.size + 1)])
            self.counters = {d: c - step for d, c in self.counters.items() if c > step}
            self.lost += step


def _summaries(digests: DataFrame, size: int) -> DataFrame:
    """``digest`` and ``count`` of each partition's counters; what it lost under a null digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(size)
        for batch in batches:
            found = batch.column("digest").value_counts()
            summary.add(found.field("values").to_pylist(), found.field("counts").to_pylist())
        rows = [*summary.counters.items(), (None, summary.lost)]
        columns = [pa.array([d for d, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["digest", "count"])

    return digests.select("digest").mapInArrow(work, "digest binary, count long")


def _least() -> Column:
    return F.min(F.struct(*ORDER)).alias("least")


def frequent(digests: DataFrame, heavy: float = HEAVY) -> DataFrame:
    """``digest``, exact ``size`` and ``least`` row of each digest with that share of all rows.

    ``digests`` is a written table. Counters fall short of the true counts by the sum of what the
    summaries lost at most, a quarter of the bound; candidates are all digests that may reach it,
    so 4 / 3 / heavy of them at most, and their exact counts are made with partial sums.
    """
    # An empty partition has no summary, an empty table none at all.
    summaries = written(_summaries(digests, int(np.ceil(4 / heavy))), "summaries")
    counted = summaries.groupBy("digest").agg(F.sum("count").alias("count"))
    lost = F.col("count") + F.lit(
        summaries.where("digest IS NULL").agg(F.sum("count")).first()[0] or 0
    )
    least = max(2, int(np.ceil(digests.count() * heavy)))
    likely = written(counted.where(F.col("digest").isNotNull() & (lost >= least)).select("digest"), "likely")
    rows = digests.join(F.broadcast(likely), "digest", "left_semi")
    exact = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), _least())
    return written(exact.where(F.col("size") >= least), "frequent")


def digests_of(docs: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``unknown`` (no id) and ``digest`` of each document, written."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.col("doc_id").isNull().alias("unknown"),
        digest_of().alias("digest"),
    )
    return written(rows, "digests")


def _judged(docs: DataFrame, heavy: float) -> DataFrame:
    digests = digests_of(docs)
    winners = frequent(digests, heavy)
    common = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), _least())
    both = common.unionByName(rest.join(groups, "digest"))
    return both.select(
        "doc_id",
        F.col("least.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("least.row")).alias("kept"),
        "digest",
    )


def judge(docs: DataFrame, heavy: float = HEAVY) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of each row.

    ``keep_id`` is the id of the row that stays of all with an equal text, the least one;
    ``group_size`` is their number.
    """
    hexed = F.lower(F.hex("digest")).alias("text_sha256")
    return _judged(docs, heavy).select("doc_id", "keep_id", "group_size", "kept", hexed)


def one_of_each(docs: DataFrame, heavy: float = HEAVY) -> DataFrame:
    """``docs`` with the row that stays of each group, all columns kept.

    Rows alike in id and text are told apart by nothing this looks at, so any one of them stays.
    """
    judged = _judged(docs, heavy).where("group_size > 1")
    keys = judged.groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    keys = written(
        keys.where("not stays or rows > 1").select(F.col("doc_id").alias("_k1"), F.col("digest").alias("_k2"), "stays"),
        "copies",
    )

    def met(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        other = checked_broadcast(some.select("_k1", "_k2"))
        same = rows["doc_id"].eqNullSafe(other["_k1"]) & (digest_of() == other["_k2"])
        return rows.join(other, same, how)

    single, again = met(docs, keys, "left_anti"), keys.where("stays")
    if not again.limit(1).count():
        return single
    firsts = met(docs, again, "left_semi")
    any_row = F.first(F.struct(*[docs[c] for c in docs.columns])).alias("_row")
    firsts = firsts.groupBy(F.col("doc_id").alias("_k1"), digest_of().alias("_k2")).agg(any_row)
    return single.unionByName(firsts.select("_row.*"))


EXACT_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d
"""
