"""Exact duplicates against plain Python, with and without frequent texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lakeload.llm import exact

from .conftest import ODD


def plain(rows):
    """keep_id, size and digest of each (id, text), and how many rows stay in all."""
    digests = [
        hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest() for _, text in rows
    ]
    groups = defaultdict(list)
    for (i, _), d in zip(rows, digests, strict=True):
        groups[d].append(i)
    least = {d: min(ids, key=lambda i: (i is None, i)) for d, ids in groups.items()}
    return sorted(((i, least[d], len(groups[d]), d) for (i, _), d in zip(rows, digests, strict=True)), key=str), len(groups)


def check(frame, rows, heavy):
    out = exact.judge(frame(rows).repartition(3), heavy).collect()
    want, groups = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == want
    kept = [r for r in out if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("heavy", [1.0, 0.2, exact.HEAVY])
def test_against_plain(frame, heavy):
    pick = random.Random(3)
    texts = ["hot  text", "hot text", "\thot\n text", "warm", "warm ", *(f"text {i}" for i in range(40))]
    rows = [(i % 97, pick.choice(texts[:3] if i % 3 == 0 else texts)) for i in range(300)]
    check(frame, rows, heavy)


def test_odd_input(frame):
    check(frame, [*ODD, (None, ""), (9, " "), (8, "\x0b\x0c\x1c")], exact.HEAVY)
    assert exact.judge(frame([])).collect() == []


def test_summaries_bound_counts():
    pick = random.Random(5)
    stream = [pick.choice("abcdefghij") if pick.random() < 0.5 else str(pick.random()) for _ in range(5000)]
    summary = exact.Summary(9)
    for start in range(0, len(stream), 70):
        counts = Counter(stream[start : start + 70])
        summary.add(list(counts), list(counts.values()))
    true = Counter(stream)
    assert len(summary.counters) <= 9
    assert summary.lost <= len(stream) / 10
    for value, count in true.items():
        assert count - summary.lost <= summary.counters.get(value, 0) <= count


def test_frequent_digests_are_verified(frame):
    rows = [(i, "a" if i % 3 == 0 else "b" if i % 7 == 0 else f"x{i}") for i in range(600)]
    found = exact.frequent(exact.digests_of(frame(rows).repartition(5)), 0.1).collect()
    assert [(r["size"], r.least.doc_id) for r in found] == [(200, 0)]  # "b" has 57, under a tenth


def test_frequent_texts_are_not_shuffled(frame):
    rows = [(i, "hot" if i % 3 == 0 else f"x{i}") for i in range(900)]
    judged = exact.judge(frame(rows).repartition(4))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert judged.where(F.col("group_size") == 300).count() == 300


def test_rows_that_stay(frame):
    rows = [*ODD, *((10 + i, "one two  three four") for i in range(3))]
    docs = frame(rows)
    out = exact.one_of_each(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    kept = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    _, groups = plain(rows)
    assert len(kept) == groups
    assert (4, "one two three four") in kept and (1, None) in kept
    assert exact.one_of_each(docs.limit(0)).collect() == []
