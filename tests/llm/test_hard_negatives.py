"""Hard negatives by bit-planes against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import hard_negatives as H

SCHEMA = "vec_id bigint, label int, embedding array<float>, rank string, positive_id int"


def brute(rows, anchor, positives=5, negatives=10):
    own = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (label, [float(np.float32(x)) for x in v])
        own[i] = min(own.get(i, one), one)
    q = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in own.items()}
    out = []
    for a in filter(anchor, q):
        score = {b: sum(x * y for x, y in zip(q[a][1], q[b][1], strict=False)) for b in q if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if q[b][0] == q[a][0]][:positives]:
            fits = [b for b in order if q[b][0] != q[a][0] and 30 * score[p] <= 100 * score[b] <= 90 * score[p]][:negatives]
            out += [(a, p, r + 1, b, score[p], score[b]) for r, b in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, parts=3):
    return sorted(map(tuple, H.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(parts), F.col("vec_id") % 5 == 0).collect()))


@pytest.mark.parametrize("scale,dim,kinds", [(0.3, 16, 3), (0.002, 8, 2), (30.0, 12, 4), (4e4, 5, 2), (1.0, 1, 2)])
def test_random_vectors(spark, scale, dim, kinds):
    """Of few distinct values too, so that ties abound."""
    rng = np.random.default_rng(int(dim))
    rows = [(int(i), int(rng.integers(kinds)), [float(x) for x in rng.normal(0.2, 1, dim) * scale], "r", 1) for i in range(120)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_odd_rows(spark):
    base = [0.5, 0.25, -0.125]
    rows = [(i, i % 3, [x * (1 + i % 4) for x in base], None, None) for i in range(40)]
    rows += [(50, None, base, "x", 0), (55, 1, None, "x", 0), (60, 1, [0.1, None, 0.2], "x", 0), (65, 1, [float("nan")] * 3, "x", 0), (70, 1, [float("inf"), 0.0, 0.0], "x", 0), (None, 1, base, "x", 0)]
    rows += [(75, 2, [], "x", 0), (80, 0, [0.5], "x", 0), (85, 1, [0.5] * 7, "x", 0), (90, 9, base, "alone", 0), (95, 0, [0.0] * 3, "x", 0), (100, 1, [-1.0, -1.0, 1.0], "x", 0)]
    rows += [(5, 2, base, "again", 0), (6, 0, base, "again", 0), (6, 0, base, "again", 0), (10, 0, [9.0, 9.0, 9.0], "other", 0)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)
    assert mined(spark, []) == []


def test_many_blocks_and_hot_vectors(spark, monkeypatch):
    """Small blocks; one vector and one label on a third of the rows."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    monkeypatch.setattr(H, "BLOCK_ANCHORS", 4)
    rng = np.random.default_rng(3)
    hot = [float(x) for x in rng.normal(0, 0.2, 16)]
    rows = [(int(i), 0 if i % 3 == 0 else int(rng.integers(4)), hot if i % 3 == 1 else [float(x) for x in rng.normal(0, 0.2, 16)], "r", 1) for i in range(200)]
    assert mined(spark, rows, parts=7) == brute(rows, lambda i: i % 5 == 0)


def test_planes_give_the_products():
    rng = np.random.default_rng(8)
    v = rng.integers(-300, 200, (50, 9))
    bits, planes = H.slice_bits(v)
    weights = [-(1 << bits - 1), *(1 << k for k in range(bits - 2, -1, -1))]
    assert (sum(w * np.unpackbits(p, axis=1, count=9).astype(int) for w, p in zip(weights, planes, strict=True)) == v).all()
    seen = []

    class Watch(H.Best):
        def dense(self, partial, alive, up, down):
            seen.append(int(alive.sum()))
            return super().dense(partial, alive, up, down)

        def pairs(self, i, s, up, down):
            seen.append(len(i))
            return super().pairs(i, s, up, down)

    a = rng.integers(-300, 200, (3, 9))
    i, j, s = H.tighten(a, bits, planes, np.ones((3, 50), bool), Watch(2))
    assert (s == (a[i] * v[j]).sum(axis=1)).all() and len(i) >= 6
    assert seen == sorted(seen, reverse=True) and seen[-1] < 150, "planes must drop candidates as they come"


def test_scores_too_large_raise(spark):
    with pytest.raises(Exception, match="63 bits"):
        mined(spark, [(0, 1, [1e12], "r", 1), (1, 1, [1e12], "r", 1)])
