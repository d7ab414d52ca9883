"""Document fingerprints by consistent weighted sampling.

A document is the bag of its lower-cased words, each weighted by its count. For each of the
signature's places every word draws two gamma variates and a uniform one from its hash (Ioffe,
2010); the word with the least score is the sample, together with the step of its weight. Two
documents agree in a place with a probability equal to their generalised Jaccard similarity, the
sum of the lesser weights over the sum of the greater.

Results for odd input: a null text counts as the empty one; empty texts have one fingerprint and
likeness 1 among themselves, 0 to others; texts are read whole; null ids come first; rows of one
id follow each other by the hash of their text; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import slices, text_of, written

PLACES, SEED = 64, 7
# Rows of a range of ids, which one task reads in order.
RANGE_ROWS, SAMPLED, RANGES = 5000, 30, 4096
# Weighted words whose draws a worker keeps, about half a kilobyte each.
HELD = 150_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniforms(words: np.ndarray, places: int, lane: int) -> list[np.ndarray]:
    """Three uniform variates in (0, 1] for each word and place, of 21 bits each."""
    offsets = _mixed((np.arange(places, dtype=np.uint64) + np.uint64(1 + 1000 * lane)) * _GOLDEN)
    drawn = _mixed(words[:, None] ^ offsets)
    scale, mask = np.float32(2.0**-21), np.uint64((1 << 21) - 1)
    parts = (drawn >> np.uint64(43), drawn >> np.uint64(22) & mask, drawn & mask)
    return [(x.astype(np.int32).astype(np.float32) + np.float32(1)) * scale for x in parts]


def samples(words: np.ndarray, weights: np.ndarray, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Score and step of each weighted word (a row) in each place (a column)."""
    one, two, beta = _uniforms(words, places, 0)
    three, four, _ = _uniforms(words, places, 1)
    r = -np.log(one * two)  # gamma variate of shape two
    c = -np.log(three * four)
    np.maximum(r, np.float32(1e-7), out=r)
    np.maximum(c, np.float32(1e-30), out=c)
    score, step = np.log(c), np.zeros(r.shape, np.int32)
    many = np.flatnonzero(weights > 1)  # the step of a word that occurs once is zero
    step[many] = np.floor(np.log(weights[many].astype(np.float32))[:, None] / r[many] + beta[many])
    score -= r * (step - beta + np.float32(1))
    return score, step


class Signer:
    """Signs the texts of a slice; the draws of a weighted word are made once."""

    def __init__(self, places: int = PLACES, seed: int = SEED) -> None:
        self.places, self.seed = places, seed
        self._forget()

    def _forget(self) -> None:
        self.held: dict[str | tuple[str, int], int] = {}
        self._grow(1 << 16)

    def _grow(self, size: int, kept: int = 0) -> None:
        shapes = {"words": np.uint64, "score": np.float32, "step": np.int32}
        for name, kind in shapes.items():
            made = np.empty(size if name == "words" else (size, self.places), kind)
            if kept:
                made[:kept] = getattr(self, name)[:kept]
            setattr(self, name, made)

    def sign(self, texts: list[str]) -> list[bytes]:
        if len(self.held) > HELD:
            self._forget()
        flat: list[str] = []
        ends = [0]
        for text in texts:
            flat += text.lower().split()
            ends.append(len(flat))
        coded = pa.array(flat, pa.string()).dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        # Words of each text with their counts, in order of text.
        pairs, counts = np.unique(owner << 32 | code, return_counts=True)
        items, at = np.unique(counts << 32 | (pairs & 0xFFFFFFFF), return_inverse=True)
        slots = self._slots(items, coded.dictionary.to_pylist())[at]
        bounds = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)).tolist()
        across, out = np.arange(self.places), []
        for start, end in zip(bounds, bounds[1:]):
            if start == end:
                out.append(bytes(2 * self.places))
                continue
            row = slots[start:end]
            best = row[self.score[row].argmin(axis=0)]
            steps = self.step[best, across].astype(np.uint64)
            chosen = _mixed(self.words[best] + steps * _GOLDEN)
            out.append((chosen & np.uint64(0xFFFF)).astype(">u2").tobytes())
        return out

    def _slots(self, items: np.ndarray, words: list[str]) -> np.ndarray:
        """Where the draws of each (count, word) are kept, after drawing for the new ones."""
        held, first, new = self.held, len(self.held), []
        slots = np.empty(len(items), np.int64)
        for i, item in enumerate(items.tolist()):
            word, n = words[item & 0xFFFFFFFF], item >> 32
            key = word if n == 1 else (word, n)
            at = held.get(key)
            if at is None:
                held[key] = at = first + len(new)
                new.append((word, n))
            slots[i] = at
        self._draw(new, first)
        return slots

    def _draw(self, new: list[tuple[str, int]], first: int) -> None:
        """Hash, scores and steps of weighted words not met before; they are kept."""
        need = first + len(new)
        if need > len(self.words):
            self._grow(max(need, 2 * len(self.words)), first)
        digest = xxhash.xxh64_intdigest
        hashes = (digest(word.encode(), self.seed) for word, _ in new)
        self.words[first:need] = np.fromiter(hashes, np.uint64, len(new))
        weights = np.fromiter((n for _, n in new), np.int64, len(new))
        for start in range(0, len(new), 512):
            at = slice(first + start, min(first + start + 512, need))
            drawn = samples(self.words[at], weights[start : start + 512], self.places)
            self.score[at], self.step[at] = drawn


def likeness(one: bytes, other: bytes) -> float:
    """Share of places in which two signatures agree."""
    return float(np.mean(np.frombuffer(one, ">u2") == np.frombuffer(other, ">u2")))


def fingerprints(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """``doc_id`` and the ``fingerprint`` (hex) of each row's whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(places)
        for batch in slices(batches):
            made = [x.hex() for x in signer.sign(batch.column("text").to_pylist())]
            arrays = [batch.column("doc_id"), pa.array(made, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fingerprint"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, f"doc_id {kind}, fingerprint string")


def _is_text(docs: DataFrame) -> bool:
    return docs.schema["doc_id"].dataType.simpleString() == "string"


def _bounds(docs: DataFrame, n: int, total: int) -> list:
    """Bounds of ``n`` ranges of ids, from a sample that balances the ranges and changes no result."""
    if n < 2:
        return []
    order = F.col("doc_id") if _is_text(docs) else F.col("doc_id").cast("double")
    ids = docs.select(order.alias("id")).where("id IS NOT NULL").sample(min(1.0, SAMPLED * n / total), seed=1)
    found = sorted(r.id for r in ids.collect())
    return sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []


def ranges_with_next(docs: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """Documents dealt out by ranges of ``doc_id``, sorted, each range with the row that follows it.

    Columns ``part``, ``follower`` (true for the added row, which comes last), ``doc_id`` and
    ``text``. Texts are shuffled once. The driver holds a bound and a first row's key for each
    range, of which there are ``RANGES`` at most.
    """
    plain = docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    total = docs.count()
    n = min(RANGES, max(1, -(-total // rows)))
    bounds = _bounds(docs, n, total)

    @F.pandas_udf("long")
    def part_of(ids):
        import pandas as pd

        known = ids.notna()
        parts = [bisect_right(bounds, i) if k else 0 for i, k in zip(ids.tolist(), known)]
        return pd.Series(parts, dtype="int64")

    # Ids in text keep their own order, all others that of numbers.
    order = F.col("doc_id") if _is_text(docs) else F.col("doc_id").cast("double")
    dealt = plain.withColumn("part", part_of(order))
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    heads = dealt.groupBy("part").agg(first).orderBy("part").collect()
    if not heads:
        return dealt.select("part", F.lit(False).alias("follower"), "doc_id", "text")
    follows = [
        (heads[i - 1].part, row.first.doc_id, row.first.text_key) for i, row in enumerate(heads)
    ]
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    keys = spark.createDataFrame(follows, f"before long, _id {kind}, _key long")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    added = plain.join(F.broadcast(keys), same).select(
        F.col("before").alias("part"), F.lit(True).alias("follower"), "doc_id", "text_key", "text"
    )
    own = dealt.select("part", F.lit(False).alias("follower"), "doc_id", "text_key", "text")
    together = own.union(added).repartition(n, "part")
    ordered = together.sortWithinPartitions("part", "follower", "doc_id", "text_key")
    return ordered.select("part", "follower", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half, rounded down, replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, places: int = PLACES) -> DataFrame:
    """Fingerprints of all texts and of their edits by the next document, and their likeness."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def finished(signer: Signer, rows: list[tuple]) -> pa.RecordBatch:
        """Rows but the last, each with the one after it."""
        edits = [edited(a[3], b[3]) for a, b in zip(rows, rows[1:])]
        own, changed = signer.sign([r[3] for r in rows]), signer.sign(edits)
        columns = [[] for _ in names]
        for i, edit in enumerate(edits):
            if rows[i][0] != rows[i + 1][0] or rows[i][1]:  # the end of a range, its follower
                continue
            values = (
                rows[i][2],
                len(rows[i][3]),
                hashlib.sha256(edit.encode()).hexdigest(),
                own[i].hex(),
                changed[i].hex(),
                likeness(own[i], changed[i]),
                likeness(own[i], own[i + 1]),
            )
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        kinds = [id_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    id_type = pa.int32() if kind == "int" else pa.string() if kind == "string" else pa.int64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, held = Signer(places), []
        for batch in slices(batches):
            held += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            yield finished(signer, held)
            held = held[-1:]

    return ranges_with_next(docs).mapInArrow(work, schema)
