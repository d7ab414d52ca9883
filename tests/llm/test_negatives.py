"""Hard negatives against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakeload.llm import negatives
from lakeload.llm.negatives import Settings

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row string, d0 string"


def plain(rows, positives, count):
    sound = [
        (i, label, [math.floor(256 * x) for x in vector])
        for i, vector, label in rows
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    out, seen = [], []
    for i, label, vector in sound:
        if i is None or i % 10 or (i, label, vector) in seen:
            continue
        seen.append((i, label, vector))
        scored = [(-sum(a * b for a, b in zip(vector, other)), math.inf if j is None else j, j, own) for j, own, other in sound]
        scored.sort(key=lambda x: x[:2])
        own = [x for x in scored if x[3] == label and x[2] != i][:positives]
        for minus, _, j, _ in own:
            fits = [x for x in scored if x[3] != label and 30 * -minus <= 100 * -x[0] <= 90 * -minus]
            out += [(i, j, rank, x[2], -minus, -x[0]) for rank, x in enumerate(fits[:count], 1)]
    return sorted(out, key=str)


def mined(spark, rows, settings):
    df = spark.createDataFrame([(i, v, label, "x", "x", "x") for i, v, label in rows], SCHEMA)
    out = negatives.mine(df.repartition(3), F.col("vec_id") % 10 == 0, settings=settings)
    return sorted((tuple(r) for r in out.collect()), key=str)


SETTINGS = [Settings(), Settings(3, 4, group=20, anchors=3, sample=2), Settings(group=7, anchors=100, sample=3)]


@pytest.mark.parametrize("settings", SETTINGS)
def test_against_plain_loops(spark, settings):
    pick = random.Random(7)

    def component():
        return float(f"{pick.gauss(0, 0.3):.6f}") if pick.random() < 0.9 else 0.0

    rows = [(i, [component() + (0.3 if i % 3 else 0) for _ in range(12)], pick.randrange(4)) for i in range(150)]
    # The table holds floats, so the plain loops get them too.
    rows = [(i, [r for r in spark_floats(v)], label) for i, v, label in rows]
    rows += [(100 + i, rows[5][1], 1 + i % 2) for i in range(200, 240)]  # ties
    assert mined(spark, rows, settings) == plain(rows, settings.positives, settings.negatives)


def spark_floats(values):
    import numpy as np

    return np.array(values, np.float32).astype(float).tolist()


def test_odd_input(spark):
    one, nan, inf = [1.0, 0.5], float("nan"), float("inf")
    rows = [
        (0, one, 1), (0, one, 1), (1, one, 1), (1, one, 1), (2, [0.5, 0.25], 2), (2, [0.5, 0.25], 2), (3, [0.5], 2),
        (4, [], 2), (None, [0.5, 0.3], 2), (None, [1.0, 1.0], 1), (10, None, 1), (20, one, None), (30, [nan, 1.0], 1),
        (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (40, [-1.0, -1.0], 3), (50, [0.0, 0.0], 4), (7, [0.0], 4), (None, None, None),
    ]
    for settings in SETTINGS:
        assert mined(spark, rows, settings) == plain(rows, settings.positives, settings.negatives)
    assert mined(spark, rows[:0], Settings()) == []
    assert mined(spark, [(0, [], 1)], Settings()) == []
