"""Nearest fill by lower envelopes, percentiles of hot cells."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundlake.operators import surface
from moundlake.operators.quantiles import cell_percentile, on_grid
from tests.conftest import grid_frame


def column_pass(known):
    """Nearest populated row per cell, the upper one of two; -1 without."""
    h, w = known.shape
    out = np.full((h, w), -1)
    for c in range(w):
        rows = np.flatnonzero(known[:, c])
        for r in range(h):
            if len(rows):
                out[r, c] = rows[np.lexsort((rows, np.abs(rows - r)))[0]]
    return out


def plain(known):
    r, c = np.nonzero(known)
    out = np.full(known.shape, -1)
    for i in range(known.shape[0]):
        for j in range(known.shape[1]):
            if len(r):
                k = np.lexsort((c, r, (r - i) ** 2 + (c - j) ** 2))[0]
                out[i, j] = r[k] * known.shape[1] + c[k]
    return out


@pytest.mark.parametrize("share", [0.0, 0.003, 0.02, 0.1, 0.5, 1.0])
def test_lower_envelope_equals_brute_force(share):
    rng = np.random.default_rng(int(share * 1000))
    for h, w in ((1, 1), (1, 30), (23, 1), (19, 40), (40, 33)):
        known = rng.random((h, w)) < share
        nr = column_pass(known)
        at = surface.nearest_in_lines(np.arange(h), np.arange(h + 1) * w, known.ravel(), nr.ravel())
        got = np.where(at >= 0, nr.ravel()[at] * w + at % w, -1).reshape(h, w)
        assert np.array_equal(got, plain(known)), (h, w)


def test_time_is_nearly_linear_in_the_void():
    def seconds(width):
        nr = np.tile(np.abs(np.arange(width) - width // 2) % 97 + 30, 20)
        known = np.zeros(20 * width, bool)
        known[::width] = True
        best = []
        for _ in range(3):
            began = time.perf_counter()
            surface.nearest_in_lines(np.zeros(20, np.int64), np.arange(21) * width, known, nr)
            best.append(time.perf_counter() - began)
        return min(best)

    assert seconds(32_000) < 20 * seconds(4_000)  # 8 times as wide; quadratic work would be 64 times


def test_fill_of_a_wide_void(spark):
    a = np.full((12, 1003), np.nan)
    a[:, 0], a[3, 1001], a[9, 500] = 1.0, 2.0, 3.0
    cells, g = grid_frame(spark, [a, np.full((2, 3), np.nan)])
    got = {(r["survey_id"], r["r"], r["c"]): r["v"] for r in surface.nearest_fill(cells).collect()}
    where = plain(~np.isnan(a))
    assert len(got) == a.size + 6 and all(got[2, r, c] is None for r in range(2) for c in range(3))
    assert all(got[1, r, c] == a.ravel()[where[r, c]] for r in range(12) for c in range(1003))


@pytest.mark.parametrize("weight", [None, "w"])
def test_percentile_of_usual_and_crowded_cells_alike(spark, weight):
    rng = np.random.default_rng(3)
    sizes = {(s, r, c): int(n) for s in (1, 2) for r in range(5) for c, n in enumerate(rng.integers(1, 60, 6))} | {(2, 4, 0): 3000, (2, 4, 1): 101}
    cells = {k: np.round(rng.uniform(90, 91, n), 2) for k, n in sizes.items()}
    weights = {k: rng.integers(1, 4, len(z)) for k, z in cells.items()}
    rows = [(*k, float(z), int(w)) for k in cells for z, w in zip(cells[k], weights[k], strict=True)] + [(1, 0, 0, None, 5), (None, 0, 0, 1.0, 1)]
    df = spark.createDataFrame(rows, "survey_id long, r int, c int, z double, w int")
    for hot in (1, 100, 1 << 18):
        got = {tuple(x)[:3]: x["v"] for x in cell_percentile(df, ["survey_id", "r", "c"], "z", 0.95, "v", weight, hot=hot).collect()}
        want = {k: np.quantile(np.repeat(z, weights[k]) if weight else z, 0.95) for k, z in cells.items()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)
    # cells under the limit take one shuffle of the points: no bucket is summed or joined for them
    plan = cell_percentile(df, ["survey_id", "r", "c"], "z", 0.95, "v", weight)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_heights_on_the_micrometre_grid_are_rounded_alike(spark):
    rng = np.random.default_rng(4)
    values = [*np.round(rng.uniform(-9e3, 9e3, 2000), 6), *rng.uniform(-1, 1, 2000), 0.0000005, 1.0000015, 2.5e-7, 123456789.1234567, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "z double")
    assert df.select(on_grid(F.col("z")).alias("a"), F.round("z", 6).alias("b")).where("NOT (a <=> b)").count() == 0


def test_percentile_of_a_hot_cell_with_continuous_heights(spark):
    rng = np.random.default_rng(2)
    hot = np.round(rng.uniform(100, 130, 30_000), 6)
    rows = [(1, 0, 0, float(z)) for z in hot]
    rest = {(1, i // 100, 1 + i % 100): np.round(rng.uniform(90, 140, 1 + i % 7), 6) for i in range(5_000)}
    rows += [(*k, float(z)) for k, zs in rest.items() for z in zs] + [(2, 0, 0, 7.25)] * 50 + [(2, 0, 1, None)]
    df = spark.createDataFrame(rows, "survey_id long, r int, c int, z double")
    got = {(r["survey_id"], r["r"], r["c"]): r["v"] for r in cell_percentile(df, ["survey_id", "r", "c"], "z", 0.95, "v").collect()}
    assert got.keys() == {(1, 0, 0), (2, 0, 0), *rest}
    assert got[1, 0, 0] == pytest.approx(np.quantile(hot, 0.95), abs=2e-6) and got[2, 0, 0] == 7.25
    assert all(got[k] == pytest.approx(np.quantile(zs, 0.95), abs=2e-6) for k, zs in rest.items())
    # no window sees the hot cell's heights: buckets of a cell, then the heights of one bucket
    per_bucket = df.where("r = 0 and c = 0 and survey_id = 1").groupBy(F.floor(F.col("z") / 0.0625)).count().agg(F.max("count")).first()[0]
    assert per_bucket < 30_000 / 100
