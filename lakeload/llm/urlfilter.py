"""URL rules by a sort-merge range join.

A host's labels in reverse, each closed by a zero character, make a key under which a host and all its
subdomains form one interval. Urls and the starts of rule intervals are sorted together; a sweep
keeps a stack of the intervals that hold the current key. Intervals are nested or apart, so the
stack is never deeper than a host has labels. Each entry has its rules' paths by length.

Results for odd input: a null url or one without ``://`` has an empty host and path, fits no rule
and gets the default verdict; null ids and repeated rows pass through, one result each; urls are
read whole, whatever their length; of two rules of one length the one with the longer host wins,
then ``block``; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_SCHEMA = "host string, path string, action string"
# Rows of one sorted range, rows sampled for each bound between ranges, and the most ranges there are: a
# range is swept as a stream, so it may be long, and what the driver holds of them is bounded.
RANGE_ROWS, SAMPLED, RANGES = 20_000, 30, 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url)))
    rest = F.coalesce(F.regexp_extract(rest, "^[^?#]*", 0), F.lit(""))
    cut = F.instr(rest, "/")
    host = F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)
    path = F.when(cut > 0, F.substring(rest, cut, F.length(rest))).otherwise(F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a zero character, which is spelled otherwise in a label."""
    plain = F.replace(F.replace(host, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.concat(F.array_join(F.reverse(F.split(plain, "\\.")), "\x00"), F.lit("\x00"))


def _after(key: bytes) -> bytes:
    """The least key behind all that start with ``key``, which ends in a zero character."""
    return key[:-1] + bytes([key[-1] + 1])


class Stack:
    """Rules whose interval holds the current key, outermost first."""

    def __init__(self) -> None:
        self.entries: list[tuple[bytes, int, dict[int, dict[str, str]], str]] = []

    def move(self, key: bytes) -> None:
        while self.entries and not key.startswith(self.entries[-1][0]):
            self.entries.pop()

    def add(self, key: bytes, host: str, path: str, action: str) -> None:
        self.move(key)
        if not self.entries or self.entries[-1][0] != key:
            self.entries.append((key, len(host), {}, host))
        paths = self.entries[-1][2].setdefault(len(path), {})
        if paths.get(path) != "block":
            paths[path] = action

    def judge(self, path: str) -> tuple[str, str] | None:
        """Rule and action of the longest rule whose path starts this one."""
        best = None
        for _, size, paths, host in self.entries:
            for length in sorted((n for n in paths if n <= len(path)), reverse=True):
                action = paths[length].get(path[:length])
                if action is not None:
                    rank = (size + length, size)
                    if best is None or rank > best[0]:
                        best = (rank, host + path[:length], action)
                    break
        return best and best[1:]


def _bounds(keys: DataFrame, rows: int) -> list[tuple[bytes, int]]:
    """Bounds of sorted ranges, from a sample that balances the ranges and changes no result."""
    total = keys.count()
    n = min(RANGES, -(-total // rows))
    if n < 2:
        return []
    share = min(1.0, SAMPLED * n / total)
    sample = keys.sample(share, seed=1).select("key", "tie").collect()
    found = sorted((r.key.encode(), r.tie) for r in sample)
    return sorted({found[i * len(found) // n] for i in range(1, n)}) if found else []


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", rows: int = RANGE_ROWS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` of each url.

    ``rules`` has ``host``, ``path`` and ``action``. Ranges are cut at (key, hash of the row), so a
    host or url that holds a third of all rows is spread over many ranges. A rule goes to each
    range that its interval meets: once for most, and at most as often as a host has labels for
    each bound between two ranges, besides.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    host, path = split_url(F.col("url").cast("string"))
    keyed = pages.select(
        "page_id",
        host.alias("host"),
        path.alias("path"),
        F.xxhash64("page_id", "url").alias("tie"),
    ).withColumn("key", host_key(F.col("host")))
    bounds = _bounds(keyed, rows)

    @F.pandas_udf("long")
    def range_of(key, tie):
        import pandas as pd

        return pd.Series([bisect_right(bounds, (k.encode(), t)) for k, t in zip(key, tie)], dtype="int64")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range that a rule's interval meets."""
        for batch in batches:
            out = [[] for _ in range(5)]
            for h, p, action, key in zip(*(batch.column(i).to_pylist() for i in range(4))):
                low = bisect_right(bounds, (key.encode(), -(1 << 63)))
                high = bisect_left(bounds, (_after(key.encode()), -(1 << 63)))
                for part in range(low, high + 1):
                    for column, value in zip(out, (part, key, h, p, action)):
                        column.append(value)
            types = [pa.int64(), *[pa.string()] * 4]
            arrays = [pa.array(c, t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "key", "host", "path", "action"])

    rule_rows = rules.where("host is not null and path is not null and action is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "action"
    )
    rule_rows = rule_rows.withColumn("key", host_key(F.col("host")))
    starts = rule_rows.mapInArrow(spread, "part long, key string, host string, path string, action string")
    nothing = F.lit(None)
    events = keyed.select(
        range_of("key", "tie").alias("part"), "key", F.lit(1).alias("turn"), "tie",
        "page_id", "host", "path", nothing.cast("string").alias("action"),
    ).unionByName(
        starts.select(
            "part", "key", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("tie"),
            nothing.cast(kind).alias("page_id"), "host", "path", "action",
        )
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, current = Stack(), None
        for batch in batches:
            at, out = [], [[], []]
            columns = [batch.column(n).to_pylist() for n in ("part", "key", "turn", "host", "path", "action")]
            for i, (part, key, turn, h, p, action) in enumerate(zip(*columns)):
                if part != current:
                    stack, current = Stack(), part
                if turn == 0:
                    stack.add(key.encode(), h, p, action)
                    continue
                stack.move(key.encode())
                found = stack.judge(p) or (None, default)
                at.append(i)
                out[0].append(found[0])
                out[1].append(found[1])
            rows = pa.array(at, pa.int64())
            arrays = [batch.column(n).take(rows) for n in ("page_id", "host", "path")]
            arrays += [pa.array(c, pa.string()) for c in out]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "host", "path", "rule", "verdict"])

    n = len(bounds) + 1
    ordered = events.repartition(n, "part").sortWithinPartitions("part", "key", "turn", "tie")
    return ordered.mapInArrow(
        sweep, f"page_id {kind}, host string, path string, rule string, verdict string"
    )
