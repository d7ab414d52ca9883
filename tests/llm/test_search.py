"""Ranked search against plain sums."""

import math
import random
import re
from collections import Counter

import pytest

from lakeload.llm import search

from .conftest import ODD

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    size, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        asked, scored = set(terms(text)), []
        for i, c, n in counted:
            m = 10 + 90 * n * size // length
            score = 0
            for t in asked & c.keys():
                w = math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, math.inf if i is None else i, i))
        scored.sort(key=lambda x: x[:2])
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def ranked(spark, frame, docs, items, **how):
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, terms string")
    return sorted((tuple(r) for r in search.rank(frame(docs).repartition(3), asked, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"ahead": 5}, {"ahead": 0, "top": 3}, {"batch": 12, "ahead": 40}])
def test_against_plain_sums(spark, frame, monkeypatch, how):
    monkeypatch.setattr(search, "BUCKET", 16)
    pick = random.Random(11)
    words = [f"w{int(pick.paretovariate(0.7)) % 200}" for _ in range(4000)]
    docs = [(i, " ".join(pick.choices(words, k=pick.randrange(1, 60)))) for i in range(250)]
    docs += [(300 + i, "copy of w7 w8 w9") for i in range(25)]  # ties
    items = [(i, " ".join(pick.choices(words, k=pick.randrange(1, 25)))) for i in range(12)]
    items += [(50, "copy w9"), (50, "another query of one id w1"), (51, docs[3][1])]
    assert ranked(spark, frame, docs, items, **how) == plain(docs, items, how.get("top", 10))


def test_buckets_give_what_reaches_the_threshold(spark, frame):
    """Bounds never lose a document, at thresholds under, at and over its score."""
    import numpy as np
    import pyarrow as pa

    pick = random.Random(2)
    lists = [sorted(pick.sample(range(40), pick.randrange(1, 20))) for _ in range(300)]
    counts = [[pick.randrange(1, 9) for _ in own] for own in lists]
    n = [sum(c) + pick.randrange(50) for c in counts]
    corpus = search.Corpus(300, sum(n), np.array([pick.randrange(1, 9000) for _ in range(40)]))
    impacts = [corpus.impacts(np.array([size] * len(t)), np.array(t), np.array(c)) for size, t, c in zip(n, lists, counts)]
    norms = [float(np.sqrt((x.astype(float) ** 2).sum())) for x in impacts]
    order = sorted(range(300), key=lambda i: -norms[i])
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(order, pa.int64()),
        "n": pa.array([n[i] for i in order], pa.int64()),
        "terms": pa.array([lists[i] for i in order], pa.list_(pa.int32())),
        "counts": pa.array([counts[i] for i in order], pa.list_(pa.int32())),
        "norm": pa.array([norms[i] for i in order]),
    })
    bucket = search.Bucket(batch, corpus)
    for _ in range(40):
        query = np.array(sorted(pick.sample(range(45), pick.randrange(1, 25))))
        true = {i: int(sum(x for t, x in zip(lists[i], impacts[i]) if t in query)) for i in range(300)}
        for threshold in [1, *pick.sample(sorted(true.values()), 8), max(true.values()) + 1]:
            places, scores = bucket.search(query, threshold)
            got = {int(bucket.ids[p]): int(s) for p, s in zip(places, scores)}
            assert all(got[i] == true[i] for i in got)
            assert {i for i, s in true.items() if s >= max(threshold, 1)} <= got.keys()


def test_odd_input(spark, frame):
    items = [(1, "ONE two"), (1, "ONE two"), (2, None), (None, "漢字 é"), (3, ""), (4, "lorem A"), (5, "σ Σ .")]
    assert ranked(spark, frame, ODD, items) == plain(ODD, items)
    assert ranked(spark, frame, ODD, []) == []
    assert ranked(spark, frame, ODD[:1], items) == []
    assert search.rank(frame([]), frame([(1, "a")]).withColumnRenamed("doc_id", "item_id")).collect() == []
