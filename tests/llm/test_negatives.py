"""Hard negatives against a plain version that scores all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourcelight.llm import op12_negatives as op

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("id", T.StringType()), T.StructField("rid", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])


def plain(rows, every=10, k=5, m=5, low=80, high=100):
    """Rows (id, vector, label) that may repeat; scores of all pairs in Python's whole numbers."""
    usable = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(np.float32(x)) >= op.MOST / 256 for x in v):
            continue
        usable[(i, str(label), tuple(math.floor(256 * float(np.float32(x))) for x in v))] = True
    usable = list(usable)
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in usable:
        if a[0] % every:
            continue
        positives = sorted(((-dot(a, b), b[0]) for b in usable if b[1] == a[1] and b[0] != a[0]))[:k]
        for p, positive in positives:
            fits = sorted((-dot(a, b), b[0]) for b in usable if b[1] != a[1] and low * -p <= 100 * dot(a, b) <= high * -p)
            out += [(a[0], positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(fits[:m])]
    return sorted(out)


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame([(i, v, label, "x", "y", 0.5, 1) for i, v, label in rows], SCHEMA).repartition(3)
    found = op.scaled(df)
    return sorted(map(tuple, op.mine(found, found.filter(F.col("id") % every == 0), **more).collect()))


def _vectors(rng, n, width, labels, spread):
    """Vectors around one centre for each label, so that windows fill at different thresholds."""
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[i * 7 % labels]], (i * 7 + (rng.random() < 0.3)) % labels) for i in range(n)]


@pytest.mark.parametrize("width,labels,spread,shards", [(64, 10, 0.2, 1), (64, 10, 1.0, 5), (3, 3, 0.5, 4), (17, 2, 0.01, 2), (1, 4, 0.3, 3)])
def test_against_all_pairs(spark, width, labels, spread, shards):
    rows = _vectors(random.Random(width * 31 + shards), 180, width, labels, spread)
    want = plain(rows)
    assert want and mined(spark, rows, shards=shards) == want
    if width == 64:
        assert mined(spark, rows, shards=shards, n_positives=3, n_negatives=2, low=60, high=90) == plain(rows, k=3, m=2, low=60, high=90)


def test_awkward_rows(spark):
    rng = random.Random(8)
    rows = _vectors(rng, 60, 8, 4, 0.3)
    same = [0.5] * 8
    rows += [(100 + i, same, i % 3) for i in range(40)]  # ties
    rows += [rows[10], rows[10], (110, same, 1), (None, same, 1), (200, None, 1), (210, same, None), (220, [0.1, None], 1), (230, [float("nan")] * 8, 1), (240, [float("inf")] * 8, 0), (250, [3e38] * 8, 0)]
    rows += [(260, [], 1), (270, [0.0] * 8, 2), (280, [-1.0] * 8, 3), (290, [0.7] * 5, 1), (300, [100000.0] * 8, 1), (301, [99999.0] * 8, 2), (302, [100000.0] * 8, 1), (-10, same, 2), (2**40, same, 1), (310, same, 77)]
    rows += [(320, [0.9] * 8, 1), (320, [0.8] * 8, 2), (320, [0.85] * 8, 1)]  # one id, several contents
    want = plain(rows)
    for shards in (1, 7):
        assert mined(spark, rows, shards=shards) == want
    assert mined(spark, []) == [] and mined(spark, [(0, same, 1)]) == [] and mined(spark, [(1, same, 1), (2, same, 2)]) == []


def test_index_prunes_and_loses_nothing():
    rng = np.random.default_rng(5)
    rows = rng.integers(-60, 60, (700, 24)) // rng.integers(1, 30, 24)
    index = op.Index(rows)
    anchors = index.rows[rng.integers(0, 700, 30)] + rng.integers(-2, 3, (30, 24))
    scores = anchors @ index.rows.T
    allowed = rng.random(scores.shape) < 0.8
    for share in (0.95, 0.6, 0.2, -0.5, -np.inf):
        least = np.sqrt((anchors**2).sum(axis=1)) * index.rest[:, 0].max() * share
        a, r, s = index.search(anchors, least, allowed)
        want = set(zip(*np.nonzero(allowed & (scores >= least[:, None])), strict=True))
        assert set(zip(a.tolist(), r.tolist(), strict=True)) == want and len(a) == len(want) and (scores[a, r] == s).all()


def test_great_components_are_exact():
    rows = np.array([[2**27 + 1, 3], [2**27 - 1, 2**27]], np.int64)
    index = op.Index(rows)
    big = rows[:, index.order]
    assert op.exact(big, big) is np.int64
    a, r, s = index.search(big, np.array([1.0, 1.0]), np.ones((2, 2), bool))
    assert sorted(zip(a.tolist(), r.tolist(), s.tolist(), strict=True)) == [(i, j, int(rows[i] @ rows[j])) for i in range(2) for j in range(2)]
