"""BPE encoding and decoding with a transducer lexicon of the corpus' frequent words.

A corpus' words are counted by Spark; the most frequent are encoded once and compiled into the
lexicon. Tasks look a slice's distinct words up together and merge only unseen words, those of a
slice at once, by the vocabulary's exact merge rules, so the ids never depend on what the lexicon holds.

Results for odd input: a null text counts as the empty one, which has no ids; null ids and
repeated rows pass through, one result each; texts are encoded whole; an empty table gives an
empty lexicon and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import slices, text_of, written
from lakeload.llm.lexicon import Lexicon, compile_lexicon

# Words compiled into the lexicon: speed only, and a bound for what is broadcast.
LEXICON_WORDS = 60_000
# Distinct words a counting task holds before it hands them on.
HELD_WORDS = 100_000
# Bytes of the longest words merged together; a longer one is merged alone.
TOGETHER = 48
_NEVER, _ID = 1 << 62, (1 << 32) - 1
# Control characters that Python's split takes for blanks.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    """Vocabulary, merges and text rules of a word-level BPE file."""

    def __init__(self, data: str) -> None:
        spec = json.loads(data)
        model, rules = spec["model"], spec["normalizer"]["normalizers"]
        split, bytewise = spec["pre_tokenizer"]["pretokenizers"]
        known = (
            [r["type"] for r in rules] == ["NFC", "Replace", "Lowercase"]
            and (split["type"], split["behavior"], split["invert"]) == ("Split", "Removed", True)
            and (bytewise["type"], bytewise["add_prefix_space"]) == ("ByteLevel", False)
            and not bytewise["use_regex"]
            and spec["decoder"] is None
            and spec["post_processor"] is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "fuse_unk", "byte_fallback"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        )
        if not known:
            raise ValueError("the file has rules that this encoder does not implement")
        self.suffix = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.added.items()]}
        # The pair's rank and, in the lower bits, the id that it becomes.
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            # Of a pair listed twice, the later rank counts.
            self.merges[self.ids[a], self.ids[b]] = rank << 32 | self.ids[a + b]
        # The same by number, for many pairs at once.
        numbered = sorted((a << 32 | b, found) for (a, b), found in self.merges.items())
        self.pairs, self.found = np.array(numbered, np.int64).reshape(-1, 2).T.copy()
        letters = byte_letters()
        self.first = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.suffix] for c in letters]
        self.words_of = regex.compile(split["pattern"]["Regex"]).findall
        self.blank = regex.compile(rules[1]["pattern"]["Regex"])
        marks = "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # Lower-casing goes letter by letter, without the rule for a final sigma.
            text = text.replace("Σ", "σ")
        if any(c in text for c in _SEPARATORS):  # blank to Python, not to the file's rule
            return self.blank.sub(" ", text).lower().split(" ")
        return text.lower().split()

    def pieces(self, text: str) -> list[str]:
        """What stands between blanks, in order; an added token is a piece after a line feed.

        No word holds a blank, so words can be looked for in each distinct piece once.
        """
        if self.marks is None or not any(t in text for t in self.added):
            return self._pieces(text)
        out = []
        for i, part in enumerate(self.marks.split(text)):
            out += ["\n" + part] if i % 2 else self._pieces(part)
        return out

    def words(self, piece: str) -> list[str]:
        return [piece] if piece[:1] == "\n" or piece.isalpha() else self.words_of(piece)

    def encode(self, piece: str) -> list[int]:
        return [i for word in self.words(piece) for i in self.merge(word)]

    def merge(self, word: str) -> list[int]:
        """Ids of a word, joining the pair of the lowest rank, leftmost first, while there is one."""
        if word[0] == "\n":
            return [self.added[word[1:]]]
        data = word.encode("utf-8")
        ids = [self.first[b] for b in data[:-1]] + [self.last[data[-1]]]
        if len(ids) > TOGETHER:
            return self._merge_long(ids)
        look = self.merges.get
        ranked = [look(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while ranked:
            best = min(ranked)
            if best == _NEVER:
                break
            at = ranked.index(best)
            ids[at : at + 2] = [best & _ID]
            del ranked[at]
            if at:
                ranked[at - 1] = look((ids[at - 1], ids[at]), _NEVER)
            if at < len(ranked):
                ranked[at] = look((ids[at], ids[at + 1]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words without end."""
        n, merges = len(ids), self.merges
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = []

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                found = merges.get((ids[i], ids[after[i]]))
                if found is not None:
                    heapq.heappush(heap, (found, i, ids[i], ids[after[i]]))

        for i in range(n):
            push(i)
        while heap:
            found, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = found & _ID, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            push(before[i])
        return [x for x, kept in zip(ids, alive, strict=True) if kept]

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The entry of ``merges`` for each pair, ``_NEVER`` for a pair that is not in it."""
        if not len(self.pairs):
            return np.full(len(left), _NEVER)
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.found[at], _NEVER)

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What ``merge`` gives for each word, end to end, and how many ids each word has.

        A round joins one pair in every word that has one to join; words without one leave.
        """
        data = [word.encode("utf-8") for word in words]
        alone = [i for i, d in enumerate(data) if len(d) > TOGETHER or d[0] == 10]
        parts = [np.array(self.merge(words[i]), np.int64) for i in alone]
        owners = [np.full(len(part), i) for i, part in zip(alone, parts, strict=True)]
        n = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        word = np.repeat(np.arange(len(data)), n)
        together = np.ones(len(data), bool)
        together[alone] = False
        flat, word = flat[together[word]], word[together[word]]
        n = n[together]
        ids = np.array(self.first, np.int64)[flat]
        ends = np.cumsum(n) - 1
        ids[ends] = np.array(self.last, np.int64)[flat[ends]]
        rank = np.append(self._ranked(ids[:-1], ids[1:]), _NEVER)[: len(ids)]
        rank[ends] = _NEVER
        while len(n):
            best = np.minimum.reduceat(rank, np.cumsum(n) - n)
            live = best < _NEVER
            if not live.all():
                on = np.repeat(live, n)
                parts.append(ids[~on])
                owners.append(word[~on])
                ids, word, rank, n, best = ids[on], word[on], rank[on], n[live], best[live]
                if not len(n):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, n))
            at = hits[np.append(True, np.diff(word[hits]) > 0)]
            ids[at] = best & _ID
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, word, rank, n = ids[kept], word[kept], rank[kept], n - 1
            at -= np.arange(len(at))
            ends = np.cumsum(n) - 1
            right, left = at < ends, at > ends - n + 1
            rank[at] = _NEVER
            rank[at[right]] = self._ranked(ids[at[right]], ids[at[right] + 1])
            rank[at[left] - 1] = self._ranked(ids[at[left] - 1], ids[at[left]])
        merged = np.concatenate([*parts, np.zeros(0, np.int64)])
        owner = np.concatenate([*owners, np.zeros(0, np.int64)])
        return merged[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return " ".join(self.tokens[i] for i in ids)


def load_vocabulary(path: str) -> str:
    """Text of the vocabulary file, read by the driver; its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@lru_cache(maxsize=2)
def _vocabulary(data: str) -> Vocabulary:
    return Vocabulary(data)


@lru_cache(maxsize=1)
def _lexicon(data: bytes) -> Lexicon:
    return Lexicon(data)


def word_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``word`` and ``n``: each piece between blanks in all texts; counted in tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _vocabulary(shared.value).pieces
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())]
            out = pa.RecordBatch.from_arrays(arrays, names=["word", "n"])
            held.clear()
            return out

        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                held.update(pieces(text))
            if len(held) > HELD_WORDS:
                yield flush()
        yield flush()

    counts = docs.select(text_of().alias("text")).mapInArrow(work, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS) -> bytes:
    """Lexicon file of the most frequent words of all texts, at most ``words`` of them.

    Words seen once, the bulk of the distinct ones, cost the same merged or looked up: they are
    counted, but not written. Words of one class of frequency are taken all or none, so the classes' sizes tell which words to
    fetch: at most ``words`` of them come to the driver, whatever the number of partitions.
    """
    counts = written(word_counts(docs, vocabulary).where("n > 1"), "word-counts")
    # Exact for small counts, then in steps of about a hundredth: some thousand classes at most.
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.lit(4096) + F.floor(F.log2("n") * 64))
    classes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size")).collect()
    least, left = None, words
    for row in sorted(classes, key=lambda r: -r.level):
        left -= row["size"]
        if left < 0:
            break
        least = row.level
    rows = [] if least is None else counts.where(level >= least).select("word").collect()
    vocab = _vocabulary(vocabulary)
    return compile_lexicon({r.word: vocab.encode(r.word) for r in rows if len(r.word.encode()) <= 64})


def _runs(pool: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``pool`` end to end, each from its start on."""
    before = np.cumsum(n) - n
    return pool[np.repeat(starts - before, n) + np.arange(n.sum())]


class Encoder:
    """Encodes slices of texts by one lexicon and one vocabulary."""

    def __init__(self, vocabulary: str, lexicon: bytes) -> None:
        self.vocabulary = _vocabulary(vocabulary)
        self.lexicon = _lexicon(lexicon)
        tokens = self.vocabulary.tokens
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens, default=-1) + 1)], pa.large_string())

    def _unseen(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces end to end and how many each has; each distinct word is merged once."""
        place: dict[str, int] = {}
        row, n = [], []
        for piece in pieces:
            words = self.vocabulary.words(piece)
            row += [place.setdefault(word, len(place)) for word in words]
            n.append(len(words))
        merged, each = self.vocabulary.merge_all(list(place))
        row = np.array(row, np.int64)
        ids = _runs(merged, (np.cumsum(each) - each)[row], each[row])
        upto = np.append(0, np.cumsum(each[row]))
        return ids, np.diff(upto[np.append(0, np.cumsum(n, dtype=np.int64))])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Ids of all texts end to end, where each text's begin (and the last end), and decoded texts."""
        pieces, ends = [], [0]
        for text in texts:
            pieces += self.vocabulary.pieces(text)
            ends.append(len(pieces))
        known = pa.array(pieces, pa.large_string()).dictionary_encode()
        del pieces
        row, unique = known.indices.to_numpy(), known.dictionary
        lexicon = self.lexicon
        at = lexicon.find(unique.cast(pa.large_binary()).to_pylist())
        # Ids of known pieces lie in the lexicon, those of unseen ones are appended.
        starts, n = lexicon.id_from[at], lexicon.id_from[at + 1] - lexicon.id_from[at]
        new = np.flatnonzero(at < 0)
        more, each = self._unseen(unique.take(pa.array(new)).to_pylist())
        starts[new], n[new] = len(lexicon.ids) + np.cumsum(each) - each, each
        pool = np.concatenate([lexicon.ids, more]).astype("<u4")
        ids = _runs(pool, starts[row], n[row])
        bounds = np.append(0, np.cumsum(n[row]))[ends]
        lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), self.tokens.take(pa.array(ids)))
        return ids, bounds, pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def _mapped(
    docs: DataFrame,
    vocabulary: str,
    lexicon: bytes,
    schema: str,
    columns: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array], list[pa.Array]],
) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((vocabulary, lexicon))
    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in slices(batches):
            made = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(columns(batch, *made), names=names)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(work, schema)


def encode(docs: DataFrame, vocabulary: str, lexicon: bytes) -> DataFrame:
    """``doc_id``, ``ids`` and the ``decoded`` text of each row of ``docs``."""

    def columns(batch, ids, bounds, decoded):
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype("i4")))
        return [batch.column("doc_id"), lists, decoded.cast(pa.string())]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _mapped(docs, vocabulary, lexicon, f"doc_id {kind}, ids array<int>, decoded string", columns)


def encode_digests(docs: DataFrame, vocabulary: str, lexicon: bytes) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the SHA-256 of ids and decoded text, made where they arise."""

    def columns(batch, ids, bounds, decoded):
        runs = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        texts = decoded.cast(pa.large_binary()).to_pylist()
        return [
            batch.column("doc_id"),
            pa.array(np.diff(bounds), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in runs], pa.string()),
            pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        ]

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(docs, vocabulary, lexicon, schema, columns)


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id`` and the ``text`` of each row's ``ids``; null ids count as none."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared.value)
        for batch in batches:
            texts = [vocab.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            arrays = [batch.column("doc_id"), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, text string")
