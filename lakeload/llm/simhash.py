"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's bits are cut into segments. Links differ in few bits, so by the pigeonhole
principle some segment is equal and another differs in one bit at most. The equal one is a key as
it is; the other is decoded with the binary Golay code [23,12,7], a perfect code: each word of 23
bits lies within three bits of just one codeword. A word three bits away also gets the keys of
the five codewords four bits away from it, so that words one bit apart always share a key. Rows
that meet under a key are compared bit by bit. Of each component of links one document may stay.

Results for odd input: a null text counts as the empty one, whose fingerprint is zero and which
links like any other; a null id takes part with its text but is the least id of no class; texts
are read whole; repeated rows give a row each, all in one class; empty tables give no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeload.llm.common import checked_broadcast, discard, row_key, slices, text_of, without, written
from lakeload.llm.components import components

SHINGLE, MAX_BITS, SEED = 3, 2, 42
# Members of a bucket compared pair by pair in one task; larger buckets take the other way.
BUCKET = 1024

# --- Golay code -------------------------------------------------------------------------------

# Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
LENGTH, CHECKS = 23, 11


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - CHECKS)), rest)
    return rest


def _patterns() -> np.ndarray:
    """For each syndrome, the differences to the codewords that give keys; -1 where there is none."""
    table = np.full((1 << CHECKS, 6), -1, np.int64)
    bits = [1 << i for i in range(LENGTH)]
    errors = [0, *bits]
    errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    messages = np.arange(1 << (LENGTH - CHECKS), dtype=np.int64) << CHECKS
    codewords = messages ^ syndrome(messages)
    light = codewords[np.bitwise_count(codewords) == 7]
    for error, rest in zip(errors, syndrome(np.array(errors)).tolist(), strict=True):
        table[rest, 0] = error
        if error.bit_count() == 3:
            table[rest, 1:] = error ^ light[light & error == error]
    return table


_PATTERNS = _patterns()


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 12-bit codeword indices of 23-bit words; one or six for each word.

    Words at most one bit apart have an index in common.
    """
    patterns = _PATTERNS[syndrome(words)]
    rows, which = np.nonzero(patterns >= 0)
    return rows, (words[rows] ^ patterns[rows, which]) >> CHECKS


# --- Tables: which bits make a key --------------------------------------------------------------

Table = tuple[tuple[int, ...], tuple[int, ...]]  # positions of the exact bits, of the decoded bits


def pigeonhole_tables() -> list[Table]:
    """Tables for 64 bits under which all pairs of two differing bits or fewer meet.

    Of three segments one is equal. In one of the three cyclic orders it is followed by a segment
    with one error at most, whichever way two errors fall.
    """
    a, b, c = tuple(range(22)), tuple(range(22, 43)), tuple(range(43, 64))
    return [(a, b), (b, c), (c, a)]


def _bits(lanes: np.ndarray, positions: tuple[int, ...]) -> np.ndarray:
    """Bits at ``positions`` of rows of 64-bit lanes, as one number each."""
    out = np.zeros(len(lanes), np.int64)
    for i, at in enumerate(positions):
        bit = lanes[:, at // 64] >> np.uint64(at % 64) & np.uint64(1)
        out |= bit.astype(np.int64) << i
    return out


def bucket_keys(lanes: np.ndarray, tables: list[Table]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit bucket keys of fingerprints."""
    rows, keys = [], []
    for number, (exact, decoded) in enumerate(tables):
        row, index = golay_keys(_bits(lanes, decoded))
        own = _bits(lanes, exact)
        rows.append(row)
        keys.append(number << 56 | own[row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


# --- Fingerprints -------------------------------------------------------------------------------


def majority(hashes: np.ndarray) -> int:
    """Number whose bits are those set in over half of the 64-bit hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def shingle_hashes(text: str, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words, A-Z lower-cased; of all words if there are fewer."""
    words = text.encode("utf-8").lower().split()  # bytes: ASCII case and blanks only
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), seed)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: -size] + 1).tolist()]
    spans = zip(starts, ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1)


def simhash64(text: str) -> tuple[int, ...]:
    """The fingerprint over three-word shingles, repeats included."""
    return (majority(shingle_hashes(text)),)


def fingerprints(
    docs: DataFrame, make: Callable[[str], tuple[int, ...]] = simhash64, lanes: int = 1
) -> DataFrame:
    """``doc_id`` and lanes ``f0``, ``f1``, ... of the fingerprint, as signed 64-bit numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"f{i}" for i in range(lanes)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = np.array(
                [make(t) for t in batch.column("text").to_pylist()], np.uint64
            ).reshape(-1, lanes).astype(np.int64)
            columns = [batch.column("doc_id"), batch.column("text_key")]
            columns += [pa.array(made[:, i]) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", *names])

    schema = f"doc_id {kind}, text_key long, " + ", ".join(f"{n} long" for n in names)
    text = text_of()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(work, schema)


# --- Links --------------------------------------------------------------------------------------


def _distance(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ many).sum(axis=-1, dtype=np.int64)


def _linked_in_bucket(ids: np.ndarray, lanes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all members with a link into the same classes: one less than members."""
    free, a, b = np.ones(len(ids), bool), [], []
    for i in range(len(ids)):
        if not free[i]:
            continue
        free[i], reached = False, [i]
        while reached:  # breadth first; a member leaves the free ones once
            at = reached.pop()
            near = np.flatnonzero(free)
            near = near[_distance(lanes[at], lanes[near]) <= bits]
            free[near] = False
            a += ids[near].tolist()
            b += [ids[at]] * len(near)
            reached += near.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _keyed(nodes: DataFrame, tables: list[Table], lanes: int) -> DataFrame:
    names = [f"f{i}" for i in range(lanes)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                made = np.stack([part.column(n).to_numpy() for n in names], axis=1).astype(np.uint64)
                rows, keys = bucket_keys(made, tables)
                columns = [pa.array(keys), *(part.column(n).take(pa.array(rows)) for n in ("node", *names))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "node", *names])

    schema = "key long, node long, " + ", ".join(f"{n} long" for n in names)
    return nodes.select("node", *names).mapInArrow(work, schema)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of each bucket with two members or more, from batches sorted by key."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        key = columns[0]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            part = [c[start:end] for c in columns]
            if held and held[0][0][0] != key[start]:
                if len(held) > 1 or len(held[0][0]) > 1:
                    yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                held = []
            held.append(part)
    if held and (len(held) > 1 or len(held[0][0]) > 1):
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _bucket_edges(nodes: DataFrame, tables: list[Table], lanes: int, bits: int) -> DataFrame:
    """Edges found in buckets; those of large buckets as (middle, node) to be joined."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bool, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            wide = np.concatenate([np.full(len(a), w) for w, a, _ in held] or [np.zeros(0, bool)])
            a = np.concatenate([a for _, a, _ in held] or [np.zeros(0)]).astype(np.int64)
            b = np.concatenate([b for _, _, b in held] or [np.zeros(0)]).astype(np.int64)
            held.clear()
            arrays = [pa.array(wide.astype(bool)), pa.array(a), pa.array(b)]
            return pa.RecordBatch.from_arrays(arrays, names=["wide", "a", "b"])

        for _, ids, *columns in _buckets(batches):
            made = np.stack(columns, axis=1).astype(np.uint64)
            if len(ids) <= BUCKET:
                held.append((False, *_linked_in_bucket(ids, made, bits)))
            else:
                for start in range(0, len(ids), 4096):
                    part = ids[start : start + 4096]
                    middles = middle_words(made[start : start + 4096, 0]).astype(np.int64)
                    held.append((True, middles.ravel(), np.repeat(part, middles.shape[1])))
                    yield flush()
            size += len(held[-1][1]) if held else 0
            if size > 100_000:
                yield flush()
                size = 0
        yield flush()

    rows = _keyed(nodes, tables, lanes)
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", "node")
    return sorted_rows.mapInArrow(work, "wide boolean, a long, b long")


def middle_words(fps: np.ndarray) -> np.ndarray:
    """Each word and the 64 words one bit from it: words two bits apart or fewer share one."""
    flips = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    return fps[:, None] ^ flips


def golay_links(nodes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a``, ``b`` whose classes are those of all pairs within ``bits`` (two at most).

    ``nodes`` has a distinct fingerprint in each row, in ``node`` and ``f0``. Buckets with more than
    BUCKET members are not paired: a member is grouped under each word one bit from it, which is
    linear. Members of such a group are within two bits of each other, and all pairs within two
    bits have a group.
    """
    if bits != 2:
        raise ValueError("the pigeonhole tables and middle words are made for two bits")
    found = written(_bucket_edges(nodes, pigeonhole_tables(), 1, bits), "bucket-edges")
    groups = found.where("wide").groupBy("a").agg(F.min("b").alias("least"))
    joined = found.where("wide").join(groups, "a").where(F.col("b") != F.col("least"))
    tied = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    links = written(found.where("not wide").select("a", "b").union(tied).distinct(), "links")
    discard(found)
    return links


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``text_key``, ``f0``), and ``f0``, ``least`` id and ``root`` of each fingerprint."""
    prints = written(fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("f0").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(golay_links(nodes.select(F.col("f0").alias("node"), "f0")))
    rooted = nodes.join(found, nodes["f0"] == found["node"], "left")
    root = F.coalesce("component", "f0").alias("root")
    owners = written(rooted.select("f0", "least", root), "roots")
    discard(nodes, found)
    return prints, owners


def simhash_classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` as 16 hex digits and ``component_id`` for each row of ``docs``.

    Fingerprints link at two differing bits or fewer; a component's id is its least ``doc_id``.
    Equal fingerprints are one node, so copies cost a row of an aggregate and no pair.
    """
    prints, owners = _rooted(docs)
    ids = owners.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = owners.join(ids, "root").select("f0", "component_id")
    print_hex = F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "f0").select("doc_id", print_hex, "component_id")


# --- One document of each group -------------------------------------------------------------------


def copies(docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``text_key``) of all rows but the one that stays of each component, written.

    The least id of a component stays, of several texts under it that with the least hash; a known id
    stays rather than none. Rows alike in id and text share a key, so of those the one that stays is
    not told apart here.
    """
    prints, owners = _rooted(docs)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    # Once for each fingerprint, then for each component: copies are aggregated before any join.
    firsts = prints.groupBy("f0").agg(F.min(order).alias("first"))
    named = written(firsts.join(owners.select("f0", "root"), "f0"), "firsts")
    stays = named.groupBy("root").agg(F.min("first").alias("stays"))
    classes = named.join(stays, "root").select("f0", "stays")
    rows = prints.join(classes, "f0")
    kept = (F.col("text_key") == F.col("stays.text_key")) & F.col("doc_id").eqNullSafe(F.col("stays.doc_id"))
    gone = written(rows.where(~kept).select("doc_id", "text_key"), "copies")
    discard(prints, owners, named)
    return gone


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of linked fingerprints, all columns kept."""
    single = without(docs, copies(docs))
    # Rows alike in id and text: keep one. Only keys that occur twice are shuffled.
    again = single.select(*row_key()).groupBy("doc_id", "text_key").count().where("count > 1")
    again = written(again.select("doc_id", "text_key"), "repeated")
    if not again.limit(1).count():
        return single
    same = single["doc_id"].eqNullSafe(F.col("_k1")) & (F.xxhash64(text_of()) == F.col("_k2"))
    keys = again.select(F.col("doc_id").alias("_k1"), F.col("text_key").alias("_k2"))
    firsts = single.join(checked_broadcast(keys), same, "left_semi")
    columns = [F.first(F.struct(*[single[c] for c in single.columns])).alias("_row")]
    firsts = firsts.groupBy(F.col("doc_id").alias("_k1"), F.xxhash64(text_of()).alias("_k2")).agg(*columns)
    return without(single, again).unionByName(firsts.select("_row.*"))
