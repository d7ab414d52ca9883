"""Ranked lexical search over norm buckets of impact vectors.

A document is a vector of impacts, one for each of its terms that some query has: the term's weight
times its saturated, length-normalised count. A query is the set of its terms, so a score is the sum
of the impacts under them. Vectors are ordered by length (Euclidean norm) within each file and cut
into buckets. For each query a bucket is passed over, and with it all that follow, when by Cauchy and
Schwarz the length of its longest vector times the root of the number of terms is under the score of
the best found so far. Inside a bucket the greatest impact of each coordinate bounds what a document
without the query's foremost terms can reach, so only documents with one of those are looked at;
the sums over them, with the lengths and the coordinates that remain, bound the score again. What
survives is scored anew in integers.

The longest vectors of the whole corpus are searched ahead of the others; the scores found there are
thresholds that all tasks start from. No vector is shuffled: a task returns its best for each query,
and those are joined by a top-k.

Queries go in batches of about ``BATCH`` terms, each a pass over the texts, so what a task holds of
them is bounded; counts of documents and terms are over all documents.

Results for odd input: a null text has no terms, as has an empty one, and neither is counted or found;
a query without terms finds nothing; queries alike in id and text are one, those that share an id with
other texts are ranked each by itself; a null id of a document is greater than all others; repeated
rows are documents of their own; equal scores go by id; texts are read whole; empty tables give no
rows; other columns are not read, and may have any names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeload.llm.common import slices, text_of, written

TOP = 10
# Distinct terms of the queries, with repeats between queries, in a batch.
BATCH = 200_000
# Vectors in a bucket, and the number of longest ones that are searched first.
BUCKET, AHEAD = 4_096, 20_000
# Fixed values of the score: weight scale, count scale, share of the length that counts.
WEIGHT, COUNT, FLAT, SLOPE, DAMP = 1000, 1_000_000_000, 10, 90, 8
NO_ID = np.iinfo(np.int64).max

# ASCII letters in lower case, digits and all bytes of other characters stay; the rest are blanks.
_KEPT = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
TABLE = bytes(_KEPT[b] + 32 if 65 <= b <= 90 else _KEPT[b] for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters, digits and all other characters beyond ASCII."""
    return text.translate(TABLE).split()


# --- Queries ------------------------------------------------------------------------------------


def _query_terms(items: DataFrame) -> DataFrame:
    """``query``, ``item_id`` and its distinct ``terms`` in order, written; queries without any go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            terms = pa.array([sorted(set(terms_of(t))) for t in texts], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), terms], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.select("item_id", text_of().alias("text")).distinct()
    found = rows.mapInArrow(work, f"item_id {kind}, terms array<binary>").where(F.size("terms") > 0)
    return written(found.select(F.monotonically_increasing_id().alias("query"), "item_id", "terms"), "queries")


@dataclass
class Queries:
    """A batch of queries: each one's terms as numbers into the sorted list of all of them."""

    keys: list[int]
    terms: list[np.ndarray]
    names: list[bytes]

    @staticmethod
    def of(rows: pa.Table) -> Queries:
        lists = rows.column("terms").to_pylist()
        names = sorted({t for terms in lists for t in terms})
        number = {t: i for i, t in enumerate(names)}
        terms = [np.array([number[t] for t in own], np.int64) for own in lists]
        return Queries(rows.column("query").to_pylist(), terms, names)


# --- Counts -------------------------------------------------------------------------------------


def _counted(docs: DataFrame, names: Broadcast) -> DataFrame:
    """``doc_id``, number of terms ``n``, and the batch's ``terms`` by number with their ``counts``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(names.value)}
        for batch in slices(batches):
            sizes, ends, terms, counts = [], [0], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                found = terms_of(text)
                sizes.append(len(found))
                for term, count in Counter(found).items():
                    at = number.get(term)
                    if at is not None:
                        terms.append(at)
                        counts.append(count)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            columns = [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "counts"])

    schema = f"doc_id {kind}, n long, terms array<int>, counts array<int>"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, schema)


def weight(documents: int, holding: int) -> int:
    """A term's weight by the number of documents that hold it."""
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * holding + 1)))


# --- Impact vectors -----------------------------------------------------------------------------


@dataclass
class Corpus:
    """What a score needs of the whole corpus: its size in documents and terms, the terms' weights."""

    documents: int
    length: int
    weights: np.ndarray

    def impacts(self, n: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weight times saturated count, for terms of documents with ``n`` terms."""
        m = FLAT + SLOPE * n * self.documents // self.length
        return self.weights[terms] * (COUNT * counts // (1000 * counts + DAMP * m))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start of each document, and each entry's document in the batch, term and count."""
    lists = batch.column("terms")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    place = np.repeat(np.arange(len(sizes)), sizes)
    return offsets[:-1] - offsets[0], place, lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()


def _vectors(counted: DataFrame, corpus: Broadcast) -> DataFrame:
    """Documents with a term, with the ``norm`` of their impacts; each file from the longest on."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema) + ", norm double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            _, place, terms, counts = _flat(batch)
            impacts = corpus.value.impacts(n[place], terms, counts.astype(np.int64))
            norms = np.sqrt(np.bincount(place, impacts.astype(np.float64) ** 2, len(n)))
            yield batch.append_column("norm", pa.array(norms))

    rows = counted.where(F.size("terms") > 0).mapInArrow(work, schema).where("norm > 0")
    return rows.sortWithinPartitions(F.col("norm").desc())


# --- The search of a bucket -----------------------------------------------------------------------


class Bucket:
    """Vectors from the longest on, with the entries of each term together."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus):
        n = batch.column("n").to_numpy()
        _, place, terms, counts = _flat(batch)
        impacts = corpus.impacts(n[place], terms, counts.astype(np.int64))
        order = np.argsort(terms, kind="stable")
        self.place, self.impacts = place[order], impacts[order]
        self.names, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.impacts, self.starts) if len(order) else np.zeros(0, np.int64)
        ids = batch.column("doc_id")
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(NO_ID).to_numpy()
        self.norms = batch.column("norm").to_numpy()

    def _sum(self, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The values of these terms' entries, summed by document."""
        parts = [slice(self.starts[t], self.ends[t]) for t in terms]
        places = np.concatenate([self.place[p] for p in parts])
        return np.bincount(places, np.concatenate([values[p] for p in parts]), len(self.norms))

    def exact(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Scores of these documents, in integers."""
        scores = np.zeros(len(places), np.int64)
        for t in terms:
            part = slice(self.starts[t], self.ends[t])
            at = np.minimum(np.searchsorted(self.place[part], places), self.ends[t] - self.starts[t] - 1)
            met = self.place[part][at] == places
            scores[met] += self.impacts[part][at[met]]
        return scores

    def search(self, query: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that reach the threshold, and perhaps some others.

        Bounds are computed in doubles and widened by more than their rounding.
        """
        wide = 1 + 1e-9
        if math.sqrt(len(query)) * self.norms[0] * wide < threshold:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, query), len(self.names) - 1)
        terms = at[self.names[at] == query]
        terms = terms[np.argsort(-self.most[terms], kind="stable")]
        # What all terms from each one on can add.
        rest = np.append(np.cumsum(self.most[terms][::-1])[::-1], 0).astype(np.float64)
        foremost = int(np.searchsorted(-rest * wide, -max(threshold, 1), side="right"))
        if not foremost:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, values = terms[:foremost], self.impacts.astype(np.float64)
        score = self._sum(first, values)
        places = np.flatnonzero(score > 0)
        score = score[places]
        others = len(terms) - foremost
        if others:
            over = self.norms[places] ** 2 - self._sum(first, values**2)[places]
            more = np.minimum(rest[foremost], np.sqrt(others * np.maximum(over, 0)) * wide + 1)
            # The norm's own rounding, relative to its square, may be all that is left of it.
            more = np.maximum(more, np.minimum(rest[foremost], self.norms[places] * 1e-6))
            score = score + more
        places = places[score * wide >= threshold]
        return places, self.exact(terms, places)


def _search(vectors: DataFrame, corpus: Broadcast, queries: Broadcast, thresholds: Broadcast, top: int) -> DataFrame:
    """The best of each task for each query: ``query``, ``doc_id``, ``score``."""
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        floors = [thresholds.value.get(k, 1) for k in asked.keys]
        held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in asked.keys]
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET):
                bucket = Bucket(batch.slice(start, BUCKET), corpus.value)
                for q, query in enumerate(asked.terms):
                    places, scores = bucket.search(query, floors[q])
                    on = scores >= floors[q]
                    if not on.any():
                        continue
                    places, scores = places[on], scores[on]
                    ids = np.concatenate([held[q][0], bucket.ids[places]])
                    known = np.concatenate([held[q][1], bucket.known[places]])
                    scores = np.concatenate([held[q][2], scores])
                    best = np.lexsort((ids, -scores))[:top]
                    held[q] = ids[best], known[best], scores[best]
                    if len(best) == top:
                        floors[q] = max(floors[q], int(scores[best[-1]]))
        for key, (ids, known, scores) in zip(asked.keys, held, strict=True):
            columns = [pa.array([key] * len(ids), pa.int64()), pa.array(ids, mask=~known), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return vectors.mapInArrow(work, f"query long, doc_id {kind}, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# --- All documents ----------------------------------------------------------------------------------


def _rank_batch(spark: SparkSession, docs: DataFrame, queries: Queries, top: int, ahead: int) -> DataFrame:
    """``query``, ``rank``, ``doc_id`` and ``score`` of the best documents of each query, written."""
    share = spark.sparkContext.broadcast
    counted = written(_counted(docs, share(queries.names)), "counted")
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    found = held.toArrow()  # one row for each term of the batch
    holding = np.zeros(len(queries.names), np.int64)
    holding[found.column("term").to_numpy()] = found.column("n").to_numpy()
    total = counted.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    documents, length = total[0], total[1] or 1
    weights = np.array([weight(documents, int(n)) for n in holding], np.int64)
    corpus, asked = share(Corpus(documents, length, weights)), share(queries)
    vectors = written(_vectors(counted, corpus), "vectors")
    # The longest vectors first: their best scores are bounds for all others.
    longest = max(0.0, 1 - ahead / max(1, documents))
    bound = vectors.agg(F.percentile_approx("norm", F.lit(longest))).first()[0] or 0.0
    first = written(_search(vectors.where(F.col("norm") >= bound), corpus, asked, share({}), top), "ahead")
    reached = _best(first, top).where(F.col("rank") == top).select("query", "score").collect()
    thresholds = share({r.query: r.score for r in reached})
    others = _search(vectors.where(F.col("norm") < bound), corpus, asked, thresholds, top)
    return written(_best(first.union(others), top), "ranked")


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, batch: int = BATCH, ahead: int = AHEAD) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the best documents for each item."""
    spark = docs.sparkSession
    queries = _query_terms(items)
    terms = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    batches = -(-terms // batch)
    number = F.pmod(F.xxhash64("query"), F.lit(max(1, batches)))
    ranked = None
    for i in range(batches):
        some = Queries.of(queries.where(number == i).select("query", "terms").toArrow())
        if some.keys:
            found = _rank_batch(spark, docs, some, top, ahead)
            ranked = found if ranked is None else ranked.unionByName(found)
    if ranked is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        ranked = spark.createDataFrame([], f"query long, doc_id {kind}, score long, rank int")
    return ranked.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


SEARCH_SQL = """
WITH words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM len),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT item_id, row, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total.len)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN len USING (row), total
  GROUP BY item_id, row, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
