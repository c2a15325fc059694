"""Hard negatives against plain comparison of all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundlake.llm import negatives


def plain(rows, every, low=80, high=100, k=5):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v], label))
    anchors, out = {(i, tuple(q), c) for i, q, c in kept if i % every == 0}, []
    for i, q, c in anchors:
        scored = [(-sum(x * y for x, y in zip(q, p, strict=True)), j, d) for j, p, d in kept if len(p) == len(q)]
        near = sorted((s, j) for s, j, d in scored if d == c and j != i)[:k]
        for s, j in near:
            fits = sorted((t, n) for t, n, d in scored if d != c and low * -s <= 100 * -t <= high * -s)[:k]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n) in enumerate(fits)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(7)
    rows = []
    centres = rng.normal(size=(6, 12))
    for i in range(400):
        v = centres[i % 6] + rng.normal(scale=0.3 + (i % 3), size=12)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v) * (1 + i % 4)], int(rng.integers(0, 4))))
    rows += [(400 + i, rows[i % 7][1], i % 4) for i in range(40)]  # ties
    rows += [(1000 + 10 * i, [float(x) for x in rng.normal(size=5)], i % 2) for i in range(30)]  # another dimension
    rows += [(2000, [0.0] * 12, 1), (2001, [0.0] * 12, 0), (2010, None, 1), (2020, [], 1), (2030, [float("nan")] + [1.0] * 11, 0)]
    rows += [(2040, [float("inf")] + [1.0] * 11, 0), (2050, [None] + [1.0] * 11, 0), (2060, rows[0][1], None), (None, rows[0][1], 0), (2070, [1e-9] * 12, 2)]
    return rows + [rows[10], rows[20], (30, rows[31][1], 3)]


@pytest.mark.parametrize(("rows_a_block", "anchors_a_block", "directions", "low"), [(16_384, 2_048, 16, 80), (50, 7, 3, 80), (100, 2_048, 0, 50), (64, 20, 16, 95)])
def test_mine(spark, monkeypatch, rows_a_block, anchors_a_block, directions, low):
    monkeypatch.setattr(negatives, "ROWS", rows_a_block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors_a_block)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS q", "2 AS number", "3 AS block")
    got = negatives.mine(df.repartition(3), F.col("vec_id") % 10 == 0, directions=directions, low_percent=low)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain(vectors(), 10, low)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 100
    q = np.floor(centres[rng.integers(0, 8, 500)] + rng.normal(scale=4, size=(500, 16)))
    norms = np.sqrt((q * q).sum(axis=1))
    directions = q[:16] / norms[:16, None]
    angles = negatives.angles_to(q, norms, directions)
    left = 0
    for i in range(60):
        low, high = negatives.score_bounds(angles[i], norms[i], angles, norms)
        true = q @ q[i]
        assert (low <= true).all() and (true <= high).all()
        left += (high >= 0.9 * true.max()).mean() / 60
    assert left < 0.5  # clustered rows: most never need a score


def test_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(df, F.col("vec_id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(lone, F.col("vec_id") % 100 == 0).count() == 0
