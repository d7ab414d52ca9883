"""Pseudo-random column expressions, a pure function of their inputs.

A lost task recomputes the same values, the result does not depend on partitioning, and any
engine with ``md5`` can reproduce it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# The key alphabet is ASCII letters and digits.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
# Vector elements are uniform integers 0..1000.
ELEMENT_COUNT = 1001
# Largest prime below 2^31.
PRIME = 2147483647


def digest(tag: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(tag), *[p.cast("string") for p in parts]))


def hex_to_long(digest_col: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest_col, start, length), 16, 10).cast("bigint")


def random_key(digest_col: Column, length: int) -> Column:
    """``length`` characters of the alphabet, three hex digits for each.

    At most ten, the length of an ID in the record format: a digest has 32 hex digits. They are
    converted for up to five characters at once, as many as a long holds.
    """
    if not 1 <= length <= 10:
        raise ValueError("length must be between 1 and 10")
    alphabet, chars = F.array(*map(F.lit, ALPHABET)), []
    for at in range(0, length, 5):
        count = min(5, length - at)
        digits = hex_to_long(digest_col, 1 + 3 * at, 3 * count)
        for i in reversed(range(count)):
            place = F.shiftright(digits, 12 * i).bitwiseAND(F.lit(0xFFF)) % len(ALPHABET)
            chars.append(F.get(alphabet, place.cast("int")))
    return F.concat(*chars)


def uniform(digest_col: Column, high: float) -> Column:
    """Double in [0, high)."""
    return hex_to_long(digest_col, 1, 8) / F.lit(4294967296.0) * F.lit(float(high))


def coin(digest_col: Column) -> Column:
    """True with probability one half."""
    return hex_to_long(digest_col, 1, 8) % 2 == 0


def int_vector(digest_col: Column, length: int) -> Column:
    """Comma-joined vector of ``length`` integers 0..1000, for lengths up to 2048; null for no digest.

    2048 is the length of a vector in the record format, and the bound below which no point
    overflows 32 bits.

    Squares of an arithmetic progression modulo a prime: two digest pieces choose start and
    step, so an element costs a few integer operations rather than a hash. They are sized so
    that no square overflows a long. The arithmetic is done on many rows at once in an Arrow-fed
    function: the same with a lambda over an array is interpreted and boxed for each element. Rows
    without a digest, which a condition leaves out ahead of the call, cost nothing.
    """
    return int_vectors({"vector": digest_col}, length)["vector"]


def int_vectors(digest_cols: dict[str, Column], length: int) -> Column:
    """A struct of vectors as of ``int_vector``, one for each named digest.

    Together they leave a task some rows at a time, however many rows a batch of digests has.
    """
    if not 1 <= length <= 2048:
        raise ValueError("length must be between 1 and 2048")
    seeds = [hex_to_long(digest_col, 1, 12) for digest_col in digest_cols.values()]
    return _vectors(list(digest_cols), length)(*seeds)


# Rows that leave a task together, and vectors whose elements are computed at once: few enough for
# their numbers to stay in a core's cache.
_ROWS = 64
_VECTORS = 16


def _element_texts(ending: str) -> np.ndarray:
    """For each element its text and ``ending`` in four bytes, padded with zeros.

    The one number that would need a fifth, 1000, is the byte 1.
    """
    texts = [f"{i}{ending}".encode().replace(b"1000", b"\1") for i in range(ELEMENT_COUNT)]
    return np.frombuffer(b"".join(text.ljust(4, b"\0") for text in texts), np.uint32)


def _vectors(names: list[str], length: int):
    inner, last = _element_texts(","), _element_texts("")
    made_type = StructType([StructField(name, StringType()) for name in names])

    @F.arrow_udf(made_type)
    def vectors(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        along = np.arange(length, dtype=np.uint32)
        prime, count = np.uint32(PRIME), np.uint32(ELEMENT_COUNT)
        # Written over again and again: fresh arrays of this size cost more than their numbers.
        narrow = np.empty((3, _VECTORS, length), np.uint32)
        wide = np.empty((2, _VECTORS, length), np.uint64)

        def texts(start: np.ndarray, step: np.ndarray) -> list[bytes]:
            x, other, codes = narrow[:, : len(start)]
            square, high = wide[:, : len(start)]
            # Starts have 28 bits and steps 20, so a point is below twice the prime. A difference
            # that would be negative wraps, and is the larger one.
            np.multiply(step[:, None], along, out=x)
            x += start[:, None]
            np.minimum(x, np.subtract(x, prime, out=other), out=x)
            square[...] = x
            square *= square
            # 2^31 is 1 modulo the prime.
            np.right_shift(square, 31, out=high)
            square &= PRIME
            square += high
            x[...] = square
            np.minimum(x, np.subtract(x, prime, out=other), out=x)
            np.floor_divide(x, count, out=other)
            other *= count
            x -= other
            np.take(inner, x, out=codes, mode="clip")
            codes[:, -1] = last[x[:, -1]]
            return [
                vector.tobytes().replace(b"\0", b"").replace(b"\1", b"1000") for vector in codes
            ]

        def column(seeds: pa.Array) -> pa.Array:
            known = seeds.is_valid().to_pylist()
            # Twelve hex digits: seven of the start, five of the step.
            numbers = seeds.drop_null().to_numpy()
            starts = (numbers >> 20).astype(np.uint32)
            steps = (numbers & 0xFFFFF).astype(np.uint32) + np.uint32(1)
            made = (
                text
                for at in range(0, len(starts), _VECTORS)
                for text in texts(starts[at : at + _VECTORS], steps[at : at + _VECTORS])
            )
            return pa.array([next(made) if k else None for k in known], pa.string())

        for batch in batches:
            # One argument alone comes as itself.
            batch = batch if isinstance(batch, tuple) else (batch,)
            for at in range(0, len(batch[0]), _ROWS):
                columns = [column(seeds.slice(at, _ROWS)) for seeds in batch]
                yield pa.StructArray.from_arrays(columns, names)

    return vectors
