"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes ratios.

A text's n-grams are hashed to a fixed number of features. A feature's value is the logarithm of
one plus its count, times the logarithm of its rate in toxic over its rate in other texts (Wang
and Manning, 2012), all scaled to length one. Spark counts features over all training rows; a
logistic regression is then fitted to a bounded, balanced sample of them in one task. The model
is two arrays of fixed size, so it can be broadcast at any size of the corpus.

Results for odd input: a null text counts as the empty one, which has no n-grams and the score of
the intercept; null labels and ids train nothing, and a label's repeated rows count once, the
greater label winning; texts are scored whole; without training rows of both classes all scores
are 0; repeated rows get a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import checked_broadcast, slices, text_of, written

ORDERS, BITS = (4, 5, 6), 20
# Least number of texts that have a feature, least absolute log ratio, and that in standard errors.
LEAST_TEXTS, LEAST_RATIO, LEAST_ERRORS = 5, 1.0, 2.0
# Bound of the sample that the regression is fitted to, for each class.
SAMPLE_PER_CLASS = 3000
EPOCHS, RATE, DECAY = 8, 0.1, 1e-4
FOLDS = 5


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log ratio of each feature, 0 if it is not used
    weight: np.ndarray
    intercept: float


def features(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Feature of each n-gram of the lower-cased text between two blanks."""
    line = " " + text.lower() + " " if text else ""
    units = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(units) < min(orders):
        return np.zeros(0, np.int64)
    out, hashed = [], np.zeros(len(units), np.uint64)
    for n in range(1, max(orders) + 1):
        if len(units) < n:
            break
        hashed = (hashed[: len(units) - n + 1] ^ units[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        hashed ^= hashed >> np.uint64(29)
        if n in orders:
            out.append((hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64)


def vector(text: str, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Used features of a text and their values, of length one together."""
    found = features(text)
    used = np.sort(found[ratio[found] != 0])
    if not len(used):
        return used, np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], used[1:] != used[:-1]]))
    counts = np.diff(np.append(first, len(used)))
    used = used[first]
    values = ratio[used] * np.log1p(counts)
    return used, values / np.sqrt(values @ values)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``toxic`` of the training rows."""
    plain = labels.where("doc_id is not null and toxic is not null")
    wanted = plain.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    wanted = written(wanted.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")), "labels")
    rows = docs.select("doc_id", text_of().alias("text"))
    return rows.join(checked_broadcast(wanted), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")


def log_ratios(training: DataFrame, bits: int = BITS) -> np.ndarray:
    """Log ratio of each feature over all training rows; 0 for rare and indifferent ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        texts = np.zeros(2, np.int64)
        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                kind = int(toxic > 0)
                counts[kind][np.unique(features(text))] += 1
                texts[kind] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        arrays = [
            np.append(seen, -1),
            np.append(counts[0][seen], texts[0]),
            np.append(counts[1][seen], texts[1]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["f", "other", "toxic"])

    rows = training.select("text", "toxic").mapInArrow(work, "f long, other long, toxic long")
    totals = rows.groupBy("f").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    # Feature -1 holds the number of texts. What is collected has at most 2**bits rows.
    kept = totals.where((F.col("f") < 0) | (F.col("other") + F.col("toxic") >= LEAST_TEXTS)).toArrow()
    f, other, toxic = (kept.column(i).to_numpy() for i in range(3))
    ratio = np.zeros(1 << bits, np.float32)
    total = f == -1
    if not total.any() or not (other[total][0] and toxic[total][0]):
        return ratio
    found = np.log((toxic + 1) / toxic[total][0]) - np.log((other + 1) / other[total][0])
    errors = np.sqrt(1 / (toxic + 1) + 1 / (other + 1))
    used = ~total & (np.abs(found) >= np.maximum(LEAST_RATIO, LEAST_ERRORS * errors))
    ratio[f[used]] = found[used]
    return ratio


def fit_sample(texts: list[str], toxic: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by adaptive gradient steps.

    The rarer class weighs more: by the square root of how many times rarer it is.
    """
    weight, slope = np.zeros(len(ratio)), np.full(len(ratio), 1e-3)
    intercept, intercept_slope = 0.0, 1e-3
    rows = [vector(text, ratio) for text in texts]
    draw = np.random.default_rng(0)
    share = np.bincount(toxic, minlength=2) + 1
    weights = np.sqrt(share.max() / share)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            at, values = rows[i]
            margin = float(np.clip(weight[at] @ values + intercept, -30, 30))
            error = (1 / (1 + np.exp(-margin)) - toxic[i]) * weights[toxic[i]]
            step = error * values + DECAY * weight[at]
            slope[at] += step * step
            weight[at] -= RATE * step / np.sqrt(slope[at])
            intercept_slope += error * error
            intercept -= RATE * error / np.sqrt(intercept_slope)
    return weight, intercept


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """The model of the labelled rows outside the held-out fold.

    Feature counts cover all of them; the regression sees at most ``per_class`` rows of each class,
    those with the least hash of their id.
    """
    training = _labelled(docs, labels)
    ratio = log_ratios(training)
    empty = Model(ratio, np.zeros(len(ratio), np.float32), -30.0)
    if not ratio.any():
        return empty
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    ids = training.select("doc_id", (F.col("toxic") > 0).alias("kind"), F.xxhash64("doc_id").alias("h"))
    picked = None
    for kind in (True, False):
        some = ids.where(F.col("kind") == kind).orderBy("h", "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    picked = written(picked.select(F.col("doc_id").alias("_id")).distinct(), "sample")
    sample = training.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            row
            for batch in batches
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
        ]
        if not rows:
            return
        toxic = np.array([int(r[2] > 0) for r in rows])
        weight, intercept = fit_sample([r[1] for r in rows], toxic, shared.value)
        at = np.flatnonzero(weight)
        arrays = [pa.array(np.append(at, -1)), pa.array(np.append(weight[at], intercept))]
        yield pa.RecordBatch.from_arrays(arrays, names=["f", "w"])

    # At most 2 * per_class rows; sorted, so that the fit does not depend on their order.
    one = sample.repartition(1).sortWithinPartitions("doc_id", F.xxhash64("text"))
    fitted = one.mapInArrow(work, "f long, w double").toArrow()
    f, w = fitted.column(0).to_numpy(), fitted.column(1).to_numpy()
    if not len(f):
        return empty
    weight = np.zeros(len(ratio), np.float32)
    weight[f[f >= 0]] = w[f >= 0]
    return Model(ratio, weight, float(w[f < 0][0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and the ``score`` (0 to 1) of each row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, weight, intercept = shared.value.ratio, shared.value.weight, shared.value.intercept
        for batch in slices(batches):
            margins = np.full(batch.num_rows, intercept)
            for i, text in enumerate(batch.column("text").to_pylist()):
                at, values = vector(text, ratio)
                margins[i] += weight[at] @ values
            scores = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
            arrays = [batch.column("doc_id"), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, f"doc_id {kind}, score double")
