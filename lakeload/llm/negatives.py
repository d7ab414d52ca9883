"""Hard negatives by a vertical scan of vectors (branch and bound on decomposed data).

Vectors are stored by dimension: a column of integers for each. For an anchor the columns are read
in the order of its own components, the largest first, and a score is built up for all candidates
at once. What the columns still to come can add lies between bounds, made from the least and the
greatest value of each column; candidates that can no longer be among the best leave the bitmap, so
later columns are read for a few only. A candidate that is left at the end has its exact score.

The scan is made twice: for the best vectors of an anchor's own label, its positives, and then for
those of other labels in the window of scores that each positive sets.

Anchors meet all vectors block by block: vectors are dealt into groups of about ``GROUP`` rows,
anchors into groups of about ``ANCHORS``, and each two groups meet under a key of their own, in one
task. A group's best are joined by a top-k for each anchor. Where there are many groups, one in
``SAMPLE`` is scanned ahead and gives thresholds that all others start from. Sizes change the
cost and not the result.

Results for odd input: rows with a null label, a null vector or a null or non-finite component take
no part; shorter vectors count as ending in zeros, an empty one as all zeros; a null id is greater
than all others and no anchor's; repeated rows each take part, but are one anchor, and rows with an
anchor's own id are not its positives; ties go by id; an anchor without a positive, or a positive
with no row in its window, gives no rows; empty tables give none; other columns are not read.
Scores are exact while they stay under 2^63.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeload.llm.common import written

POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 30, 90
GROUP, ANCHORS, SAMPLE = 8_192, 2_048, 64
# Columns read between two looks at the bounds, and the id that stands for none in comparisons.
STEP, NO_ID = 4, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Settings:
    """What is asked for and how the work is cut up."""

    positives: int = POSITIVES
    negatives: int = NEGATIVES
    low: int = LOW
    high: int = HIGH
    group: int = GROUP
    anchors: int = ANCHORS
    sample: int = SAMPLE


# --- Vertical table ---------------------------------------------------------------------------


def vertical(rows: DataFrame, label: Column, scale: float) -> DataFrame:
    """``row``, ``vec_id``, ``label`` and a column ``d0``, ``d1``, ... for each dimension, written.

    A component is the floor of ``scale`` times its value, as a double.
    """
    plain = rows.select("vec_id", label.cast("long").alias("label"), "embedding")
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = plain.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    width = sound.agg(F.max(F.size("embedding"))).first()[0] or 0

    def dimension(i: int) -> Column:
        x = F.coalesce(F.get("embedding", F.lit(i)).cast("double"), F.lit(0.0))
        return F.floor(F.lit(scale) * x).cast("long").alias(f"d{i}")

    columns = [dimension(i) for i in range(width)]
    row = F.monotonically_increasing_id().alias("row")
    return written(sound.select(row, "vec_id", "label", *columns), "vertical")


def _dimensions(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in ("row", "vec_id", "label")]


def _groups(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


# --- The scan of one group ----------------------------------------------------------------------


def _numbers(table: pa.Table, name: str, null: int = 0) -> np.ndarray:
    return table.column(name).fill_null(null).to_numpy().astype(np.int64, copy=False)


class Block:
    """Candidates by column, with the least and the greatest value of each."""

    def __init__(self, table: pa.Table, dimensions: list[str]):
        self.ids = _numbers(table, "vec_id", NO_ID)
        self.known = table.column("vec_id").is_valid().to_numpy()
        self.labels = _numbers(table, "label")
        self.columns = [_numbers(table, d) for d in dimensions]
        some = len(self.ids) > 0
        self.low = np.array([c.min() if some else 0 for c in self.columns], np.int64)
        self.high = np.array([c.max() if some else 0 for c in self.columns], np.int64)

    def scan(self, vector: np.ndarray, bitmap: np.ndarray, stays) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the candidates in ``bitmap`` that stay to the end.

        ``stays(least, most)`` tells from bounds of their scores which of them go on.
        """
        order = np.argsort(-np.abs(vector), kind="stable")
        one, two = vector * self.low, vector * self.high
        # Bounds of what is still to come after so many columns.
        least = np.append(np.cumsum(np.minimum(one, two)[order][::-1])[::-1], 0)
        most = np.append(np.cumsum(np.maximum(one, two)[order][::-1])[::-1], 0)
        at = np.flatnonzero(bitmap)
        score = np.zeros(len(at), np.int64)
        for number, d in enumerate(order.tolist(), 1):
            score += vector[d] * self.columns[d][at]
            if number % STEP == 0 or number == len(order):
                on = stays(score + least[number], score + most[number])
                if not on.all():
                    at, score = at[on], score[on]
            if not len(at):
                break
        return at, score

    def first(self, at: np.ndarray, score: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The best of them, equal scores by id."""
        best = np.lexsort((self.ids[at], -score))[:count]
        return at[best], score[best]


def _kth(values: np.ndarray, k: int, least: int) -> int:
    """The kth greatest of the values, if there are so many and it is over ``least``."""
    return max(least, int(np.partition(values, -k)[-k])) if len(values) >= k else least


def _anchors_of(table: pa.Table, dimensions: list[str]):
    vectors = np.stack([_numbers(table, d) for d in dimensions], axis=1) if dimensions else np.zeros((len(table), 0), np.int64)
    ids, labels = _numbers(table, "vec_id", NO_ID), _numbers(table, "label")
    return zip(table.column("anchor").to_pylist(), ids.tolist(), labels.tolist(), vectors, table.column("bounds").to_pylist(), strict=True)


HITS = "anchor long, window long, vec_id long, score long"
_HIT_TYPES = [pa.int64()] * 4


def _hits(block: Block, found: list[tuple[int, int | None, np.ndarray, np.ndarray]]) -> pa.Table:
    sizes = [len(at) for _, _, at, _ in found]
    places = np.concatenate([np.zeros(0, np.int64), *(at for _, _, at, _ in found)])
    columns = [
        pa.array(np.repeat(np.array([a for a, *_ in found], np.int64), sizes)),
        pa.array(np.repeat(np.array([w for _, w, *_ in found], np.int64), sizes)),
        pa.array(block.ids[places], mask=~block.known[places]),
        pa.array(np.concatenate([np.zeros(0, np.int64), *(s for *_, s in found)])),
    ]
    return pa.Table.from_arrays(columns, names=["anchor", "window", "vec_id", "score"])


def _best_of_own_label(count: int, dimensions: list[str]):
    """For a cogroup: the best rows of each anchor's label in a group of vectors."""

    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        block, found = Block(rows, dimensions), []
        for anchor, own, label, vector, bounds in _anchors_of(anchors, dimensions):
            start = bounds[0]["least"] if bounds else -NO_ID

            def stays(least, most, start=start):
                return most >= _kth(least, count, start)

            at, score = block.scan(vector, (block.labels == label) & (block.ids != own), stays)
            found.append((anchor, 0, *block.first(at, score, count)))
        return _hits(block, found)

    return work


def _best_in_windows(count: int, dimensions: list[str]):
    """For a cogroup: the best rows of other labels in each window of an anchor's."""

    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        block, found = Block(rows, dimensions), []
        for anchor, _, label, vector, bounds in _anchors_of(anchors, dimensions):
            floors = [max(w["low"], w["least"]) for w in bounds]

            def stays(least, most, bounds=bounds, floors=floors):
                on = np.zeros(len(least), bool)
                for w, window in enumerate(bounds):
                    sure = least[(least >= window["low"]) & (most <= window["high"])]
                    floors[w] = _kth(sure, count, floors[w])
                    on |= (most >= floors[w]) & (least <= window["high"])
                return on

            at, score = block.scan(vector, block.labels != label, stays)
            for w, window in enumerate(bounds):
                inside = (score >= floors[w]) & (score <= window["high"])
                found.append((anchor, window["window"], *block.first(at[inside], score[inside], count)))
        return _hits(block, found)

    return work


# --- All groups -----------------------------------------------------------------------------------


def _best(hits: DataFrame, count: int) -> DataFrame:
    """The best hits of each anchor and window, with their ``rank``."""
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _met(rows: DataFrame, anchors: DataFrame, shares: Column, work, s: Settings) -> DataFrame:
    """Hits of each group of vectors named in ``shares`` with each group of anchors."""
    parts = _groups(anchors.count(), s.anchors)
    left = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    part = F.pmod(F.xxhash64("anchor"), F.lit(parts)).cast("int")
    right = anchors.withColumns({"part": part, "share": F.explode(shares)})
    keys = ("share", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, HITS)


def _raised(anchors: DataFrame, ahead: DataFrame, count: int) -> DataFrame:
    """The anchors, their windows with the scores that the last of the best found ahead has."""
    reached = ahead.where(F.col("rank") == count).select("anchor", "window", F.col("score").alias("reached"))
    each = anchors.select("anchor", F.explode("bounds").alias("b")).select("anchor", "b.*")
    each = each.join(reached, ["anchor", "window"], "left")
    least = F.greatest("least", "reached").alias("least")  # passes over nulls
    bounds = F.collect_list(F.struct("window", "low", "high", least)).alias("bounds")
    return written(anchors.drop("bounds").join(each.groupBy("anchor").agg(bounds), "anchor"), "raised")


def _scan(rows: DataFrame, anchors: DataFrame, make, count: int, s: Settings, groups: int) -> DataFrame:
    """The best ``count`` hits of each anchor and window over all rows, written.

    ``anchors`` has its windows in ``bounds``: ``window``, ``low``, ``high`` and ``least``, a score
    that the last of the best is known to reach.
    """
    work = make(count, _dimensions(rows.drop("share")))
    last = F.lit(groups - 1)
    if groups > s.sample:
        some = F.sequence(F.lit(0), last, F.lit(s.sample))
        ahead = _met(rows.where(F.col("share") % s.sample == 0), anchors, some, work, s)
        anchors = _raised(anchors, _best(ahead, count), count)
    return written(_best(_met(rows, anchors, F.sequence(F.lit(0), last), work, s), count), "best")


def _hundredths(percent: int, name: str) -> Column:
    """So many hundredths of an integer column, rounded down."""
    product = f"({percent} * {name})"
    return F.expr(f"({product} - pmod({product}, 100)) div 100")


def mine(
    rows: DataFrame,
    is_anchor: Column,
    label: Column | None = None,
    scale: float = 256.0,
    settings: Settings = Settings(),
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` has ``vec_id``, ``label`` (an integer) and ``embedding``; ``is_anchor`` is a condition on
    ``vec_id``; ``label`` replaces the label. Scores are inner products of the integer vectors.
    """
    s = settings
    table = vertical(rows, F.col("label") if label is None else label, scale)
    dimensions = _dimensions(table)
    groups = _groups(table.count(), s.group)
    dealt = table.withColumn("share", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).drop("row")
    chosen = table.where(is_anchor).groupBy("vec_id", "label", *dimensions).agg(F.min("row").alias("anchor"))
    anchors = written(chosen, "anchors")

    def windows(name: Column, low: Column, high: Column) -> Column:
        columns = {"window": name, "low": low, "high": high, "least": F.lit(-NO_ID)}
        return F.struct(*[c.cast("long").alias(n) for n, c in columns.items()])

    whole = F.array(windows(F.lit(0), F.lit(-NO_ID), F.lit(NO_ID))).alias("bounds")
    positives = _scan(dealt, anchors.select("*", whole), _best_of_own_label, s.positives, s, groups)
    positives = positives.select(
        "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"
    )

    # A positive's window goes by its score, so that positives of equal score share one.
    score = F.col("positive_score")
    low, high = -_hundredths(-s.low, "positive_score"), _hundredths(s.high, "positive_score")
    each = positives.select("anchor", "positive_score").distinct()
    bounds = each.groupBy("anchor").agg(F.collect_list(windows(score, low, high)).alias("bounds"))
    negatives = _scan(dealt, anchors.join(bounds, "anchor"), _best_in_windows, s.negatives, s, groups)
    negatives = negatives.select(
        "anchor",
        F.col("window").alias("positive_score"),
        F.col("vec_id").alias("negative_id"),
        F.col("score").alias("negative_score"),
        "rank",
    )
    named = positives.drop("rank").join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(negatives, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
