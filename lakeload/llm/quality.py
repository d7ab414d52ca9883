"""Quality by an interpolated modified Kneser-Ney model over words and characters.

A text is a sequence of units: a word that is frequent in the trusted texts is one unit, together with
the space before it, and every other word is spelled, a character a unit. So an n-gram spans up to
four frequent words, or the letters of a rare one and what stands before it, and no word is unknown.
The model's n-grams are counted on trusted texts only. Counts, continuation counts and the totals
of contexts are tables sharded by n-gram and joined there (Chen and Goodman, 1998). Documents are
cut into blocks; a block asks for each of its distinct n-grams once, the joins answer with log
probabilities, and the answers are brought together with the block's texts, which gives each
document's perplexity, per character. What is moved grows with the distinct n-grams of blocks and
not with their words. A block asks for an n-gram once however often it holds it, so that no n-gram has
more rows than there are blocks.

A share of the trusted texts, told by a hash of the id, is held out of the counts. Thresholds are
quantiles, for each language, of how far the held-out log perplexities lie from their median, with a
margin. Short texts vary more, so the distance counts by the square root of the length, up to some
thousand characters, without steps. A language leans on all texts the more the fewer of its own are
held out. Both ends count: endless repetition is as odd as noise.

A character beyond the basic plane counts as U+FFFD, each digit as 0, and the frequent words take the
code units that stand for no character, so four units are one 64-bit key, exactly.

Results for odd input: a null text counts as the empty one, which has no event and is kept; a
null language is a language of its own; null ids are scored like others but trust nothing; labels
of one id are taken together, and trusted if one of them is; texts are scored whole; repeated
rows get a row each; words of equal count are units in the order of their characters; without
trusted texts held out nothing is rejected, and a language without them takes the band over all;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeload.llm.common import checked_broadcast, discard, give_back, row_key, slices, text_of, without, written
from lakeload.llm.exact import Summary

ORDER = 4
# Bytes of text in a block, which is scored in one piece; a longer text is a block of its own.
BLOCK_BYTES = 32 << 20
# Upper quantile of the held-out texts' distances from the median; the lower one is its complement. The
# band of kept texts is wider on both sides by that multiple of the distance.
QUANTILE, MARGIN = 0.99, 1.0
# A text of n characters varies as the root of 1 + STEADY / n.
STEADY = 2000
# A language counts as if it had so many texts more, which lie as those of all languages do.
LEANING = 50
# One in so many trusted texts is held out of the model and sets the thresholds.
HELD_OUT = 5
# Least share of all words that makes a word frequent; 1 / SHARE words at most.
SHARE = 1 / 1024
_START = "\x02" * (ORDER - 1)  # stands before the first character
# Code points without a character of their own: they number the frequent words.
_FIRST_WORD, _LAST_WORD = 0xD800, 0xDFFF


class Units:
    """Texts as units: a frequent word and the space before it are one, all else is spelled."""

    def __init__(self, words: list[str]) -> None:
        if len(words) > _LAST_WORD - _FIRST_WORD + 1:
            raise ValueError(f"{len(words)} frequent words are too many to be numbered")
        self.numbered = {w: chr(_FIRST_WORD + i) for i, w in enumerate(words)}

    def keys_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The key of each unit with the three before it, text after text, and where each text's keys end."""
        numbered, coded = self.numbered.get, []
        for text in texts:
            first, *words = text.split(" ")
            coded.append(_START + " ".join([first, *[numbered(w, w) for w in words]]))
        points = np.frombuffer("".join(coded).encode("utf-32-le", "surrogatepass"), "<u4")
        spaces = points[:-1] == 32
        spaces &= (points[1:] >= _FIRST_WORD) & (points[1:] <= _LAST_WORD)
        kept = np.append(~spaces, True)
        ends = np.cumsum(kept)[np.cumsum([len(c) for c in coded]) - 1]
        units = points[kept]
        units[units > 0xFFFF] = 0xFFFD
        units[(units >= 48) & (units <= 57)] = 48
        units = units.astype(np.uint64)
        pairs = units[:-1] << np.uint64(16) | units[1:]
        keys = pairs[:-2] << np.uint64(32) | pairs[2:]
        # Those that begin within the last three units of a text reach into the next one.
        whole = np.ones(len(units), bool)
        whole[(ends[:, None] - np.arange(1, ORDER)).ravel()] = False
        return keys[whole[: len(keys)]].view(np.int64), ends - (ORDER - 1) * np.arange(1, len(texts) + 1)


def frequent_words(texts: DataFrame, share: float = SHARE) -> list[str]:
    """Words between spaces that make up ``share`` of all words in the column ``text``, most frequent first.

    Misra-Gries summaries of the partitions find all words that may be frequent, 4 / 3 / share of them
    at most, which are then counted exactly.
    """

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, total = Summary(int(np.ceil(4 / share))), 0
        for batch in slices(batches):
            counts = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(text.split(" "))
            total += counts.total()
            summary.add(list(counts), list(counts.values()))
        rows = [*summary.counters.items(), (None, total - summary.lost)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], schema=likely_schema)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(filter(candidates.__contains__, text.split(" ")))
        if counts:
            columns = [pa.array(list(counts)), pa.array(list(counts.values()))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    likely_schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    rows = texts.select("text")
    summaries = written(rows.mapInArrow(likely, "word string, n long"), "summaries")
    counted = summaries.groupBy("word").agg(F.sum("n").alias("n"))
    # What summaries lost is at most a quarter of the least count, so three quarters of it remain.
    rest = counted.where("word IS NULL").first()
    least = (rest.n if rest else 0) * share
    candidates = {r.word for r in counted.where((F.col("n") >= least * 0.75) & (F.col("word") != "")).collect()}
    discard(summaries)
    found = rows.mapInArrow(exact, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in found.where(F.col("n") >= max(2, least)).orderBy(F.desc("n"), "word").collect()]


def gram_counts(texts: DataFrame, words: list[str]) -> DataFrame:
    """``k`` and ``c``: each n-gram of the highest order in the column ``text``, and its count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(words)
        for batch in slices(batches):
            found = pc.value_counts(pa.array(units.keys_of(batch.column("text").to_pylist())[0]))
            yield pa.RecordBatch.from_arrays(found.flatten(), names=["k", "c"])

    rows = texts.select("text").mapInArrow(work, "k long, c long")
    return rows.groupBy("k").agg(F.sum("c").alias("c"))


def _suffix(key: Column, order: int) -> Column:
    """The last ``order`` units of a key."""
    return key if order == ORDER else key.bitwiseAND(F.lit((1 << 16 * order) - 1))


def _context(key: Column) -> Column:
    """All but the last unit."""
    return F.shiftrightunsigned(key, 16)


class Model:
    """Sharded tables of the model: for each order the grams' counts and the contexts' sums."""

    def __init__(self, trusted: DataFrame, share: float = SHARE) -> None:
        self.grams, self.contexts = {}, {}
        self.words = frequent_words(trusted, share)
        grams = written(gram_counts(trusted, self.words), "grams")
        for order in range(ORDER, 0, -1):
            self.grams[order] = grams
            if order > 1:
                # An n-gram's lower-order count is the number of units that precede it.
                shorter = grams.groupBy(_suffix(F.col("k"), order - 1).alias("k"))
                grams = written(shorter.agg(F.count(F.lit(1)).alias("c")), "grams")
        self.vocabulary = self.grams[1].count() + 1  # one for units never seen
        for order, grams in self.grams.items():
            counts = grams.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
            self.contexts[order] = self._sums(grams, self.discounts(counts))
            self.grams[order] = self._discounted(grams, self.discounts(counts))

    @staticmethod
    def discounts(counts) -> tuple[float, float, float]:
        """Discounts of counts of one, two and more, from the numbers of n-grams with small counts."""
        n1, n2, n3, n4 = counts
        if not (n1 and n2):
            return 0.5, 0.5, 0.5
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0)
        return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))

    @staticmethod
    def _discounted(grams: DataFrame, d: tuple[float, float, float]) -> DataFrame:
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        return grams.select("k", (F.col("c") - off).alias("left"))

    @staticmethod
    def _sums(grams: DataFrame, d: tuple[float, float, float]) -> DataFrame:
        """For each context the sum of its counts and the mass that the discounts set free."""
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        sums = grams.groupBy(_context(F.col("k")).alias("context"))
        return sums.agg(F.sum("c").alias("total"), F.sum(off).alias("free"))

    def log_probabilities(self, asked: DataFrame) -> DataFrame:
        """``k`` and ``logp`` for distinct n-grams ``k`` of the highest order.

        Each order's distinct suffixes are joined with its counts and contexts and with the
        probabilities of the order below.
        """
        wanted = {ORDER: asked}
        for order in range(ORDER - 1, 0, -1):
            wanted[order] = wanted[order + 1].select(_suffix(F.col("k"), order).alias("k")).distinct()
        below: Column = F.lit(1.0 / self.vocabulary)
        answers = None
        for order in range(1, ORDER + 1):
            rows = wanted[order].join(self.grams[order], "k", "left")
            if order == 1:  # one context, the empty one
                sums = self.contexts[1].first()
                total, free = (sums.total, sums.free) if sums else (None, None)
                rows = rows.withColumn("total", F.lit(total).cast("long")).withColumn("free", F.lit(free).cast("double"))
            else:
                context = self.contexts[order]
                rows = rows.withColumn("context", _context(F.col("k"))).join(context, "context", "left")
                lower = answers.select(F.col("k").alias("suffix"), F.col("p").alias("below"))
                rows = rows.withColumn("suffix", _suffix(F.col("k"), order - 1)).join(lower, "suffix")
                below = F.col("below")
            seen = (F.coalesce("left", F.lit(0.0)) + F.col("free") * below) / F.col("total")
            answers = rows.select("k", F.when(F.col("total").isNull(), below).otherwise(seen).alias("p"))
        return answers.select("k", F.log("p").alias("logp"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices with their block's number, which tells partitions and the pieces of one apart."""
    block, held = TaskContext.get().partitionId() << 24, 0
    for batch in slices(batches):
        size = batch.column("text").nbytes
        if held and held + size > BLOCK_BYTES:
            block, held = block + 1, 0
        held += size
        yield block, batch


def _asked(words: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of each block."""
    units, current, held = Units(words), None, []

    def answer() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held))
        arrays = [pa.array(np.full(len(keys), current)), pa.array(keys)]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "k"])

    for block, batch in _blocks(batches):
        if current is not None and block != current:
            yield answer()
            held = []
        current = block
        held.append(pc.unique(pa.array(units.keys_of(batch.column("text").to_pylist())[0])).to_numpy())
    if current is not None:
        yield answer()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice as one compressed value, with its block."""
    packer = zstandard.ZstdCompressor(level=6)
    for block, batch in _blocks(batches):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        data = packer.compress(sink.getvalue().to_pybytes())
        arrays = [pa.array([block]), pa.array([data], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["block", "data"])


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are split alike within, also when executors come or go; the number is that of now."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if not before:
        spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if not before:
            spark.conf.unset(name)


def score(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, ``lang``, ``n`` characters and ``logp`` per character of each row, written.

    A block's questions and texts are told apart by its partition, so ``docs`` must give the same rows to
    the same partitions when it is read again, as files do. A text whose answers are missing fails the job.
    """
    with same_splits(docs.sparkSession):
        return _score(docs, Model(trusted))


def _score(docs: DataFrame, model: Model) -> DataFrame:
    words = model.words
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang")}
    rows = docs.select(*row_key(), "lang", text_of().alias("text"))
    asked = written(rows.mapInArrow(lambda b: _asked(words, b), "block long, k long"), "asked")
    answers = model.log_probabilities(asked.select("k").distinct())
    answered = asked.join(answers, "k").select("block", "k", "logp")
    packed = rows.mapInArrow(_packed, "block long, data binary")

    def work(texts: pa.Table, table: pa.Table) -> pa.Table:
        keys = table.column("k").to_numpy()
        order = np.argsort(keys)
        keys, logs = keys[order], table.column("logp").to_numpy()[order]
        units, unpacker, out = Units(words), zstandard.ZstdDecompressor(), []
        for data in texts.column("data").to_pylist():
            batch = pa.ipc.open_stream(unpacker.decompress(data)).read_all().combine_chunks()
            values = batch.column("text").to_pylist()
            own, ends = units.keys_of(values)
            # Each distinct key of the slice is looked up once.
            coded = pa.array(own).dictionary_encode()
            places, own = coded.indices.to_numpy(), coded.dictionary.to_numpy()
            at = np.searchsorted(keys, own)
            if len(own) and (at.max() >= len(keys) or (keys[at] != own).any()):
                raise RuntimeError("a block changed between two reads of the documents")
            each = np.split(logs[at][places], ends[:-1])
            n = np.array([len(t) for t in values])
            mean = np.array([x.sum() for x in each]) / np.maximum(n, 1)
            columns = [batch.column(c) for c in ("doc_id", "text_key", "lang")]
            columns += [pa.array(n, pa.int64()), pa.array(mean, pa.float64())]
            out.append(pa.table(columns, names=["doc_id", "text_key", "lang", "n", "logp"]))
        give_back()
        return pa.concat_tables(out)

    schema = f"doc_id {kinds['doc_id']}, text_key long, lang {kinds['lang']}, n long, logp double"
    grouped = packed.groupBy("block").cogroup(answered.groupBy("block"))
    scored = written(grouped.applyInArrow(work, schema), "scored")
    discard(asked)
    return scored


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.where("doc_id is not null and quality = 1")
    return written(good.select(F.col("doc_id").alias("_id")).distinct(), "trusted")


def held_out(id_: Column) -> Column:
    """Whether a trusted text sets thresholds, and is not trained on."""
    return F.pmod(F.xxhash64(id_.cast("string")), F.lit(HELD_OUT)) == 0


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``doc_id``, ``text_key``, ``lang``, ``n``, ``perplexity``, the band ``low`` to ``high``, ``keep``."""
    ids = trusted_ids(labels)
    learned, spared = ids.where(~held_out(F.col("_id"))), ids.where(held_out(F.col("_id")))
    rows = docs.select("doc_id", text_of().alias("text"))
    good = rows.join(checked_broadcast(learned), F.col("doc_id") == F.col("_id"), "left_semi")
    scored = score(docs, good).withColumn("log_perplexity", -F.col("logp"))
    same = F.col("lang").eqNullSafe(F.col("_lang"))

    def by_language(rows: DataFrame, **of_rows: Column) -> DataFrame:
        """``rows`` with the columns that ``of_rows`` aggregates over the held-out texts of their language."""
        known = rows.where("n > 0").join(checked_broadcast(spared), F.col("doc_id") == F.col("_id"), "left_semi")
        count = F.count(F.lit(1)).alias("_n")
        whole = known.agg(*[c.alias(name) for name, c in of_rows.items()]).first()
        langs = known.groupBy(F.col("lang").alias("_lang")).agg(count, *[c.alias(f"_{x}") for x, c in of_rows.items()])
        joined = rows.join(checked_broadcast(written(langs, "languages")), same, "left")
        for name in of_rows:
            on = F.lit(whole[name]).cast("double")
            drawn = (F.col("_n") * F.col(f"_{name}") + LEANING * on) / (F.col("_n") + LEANING)
            joined = joined.withColumn(name, F.coalesce(drawn, on))
        return joined.drop("_lang", "_n", *[f"_{x}" for x in of_rows])

    steady = F.sqrt(F.col("n") / (F.col("n") + STEADY))
    scored = by_language(scored, middle=F.percentile_approx("log_perplexity", 0.5, 10_000))
    away = (F.col("log_perplexity") - F.col("middle")) * F.when(F.col("n") > 0, steady)
    scored = by_language(
        scored.withColumn("away", away),
        below=F.percentile_approx("away", 1 - quantile, 10_000),
        above=F.percentile_approx("away", quantile, 10_000),
    )
    wide = (1 + margin) / F.when(F.col("n") > 0, steady)
    return scored.select(
        "doc_id",
        "text_key",
        "lang",
        "n",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp(F.col("middle") + F.col("below") * wide).alias("low"),
        F.exp(F.col("middle") + F.col("above") * wide).alias("high"),
        F.coalesce(F.col("away").between(F.col("below") * (1 + margin), F.col("above") * (1 + margin)), F.lit(True)).alias("keep"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, all columns kept."""
    rejected = judge(docs, labels).where("not keep").select("doc_id", "text_key").distinct()
    return without(docs, written(rejected, "rejected"))
