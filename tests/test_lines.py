"""Sliding extremes and stretching of whole lines against plain loops and the window form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundlake.operators import lines, surface
from moundlake.operators import neighbourhood as nb
from tests.conftest import grid_frame


@pytest.mark.parametrize("how", ["min", "max"])
def test_sliding_extremes_of_any_kernel(how):
    rng = np.random.default_rng(3)
    lengths = np.array([1, 7, 40, 1, 23, 90])
    kernels = np.array([1, 3, 8, 60, 23, 200])
    before = np.array([0, 1, 5, 30, 22, 0])
    flat = rng.normal(size=lengths.sum())
    got = lines.sliding_extremes(flat, lengths, before, kernels, how)
    at = 0
    for n, k, b in zip(lengths, kernels, before, strict=True):
        line = flat[at : at + n]
        want = [getattr(np, how)(line[max(0, i - b) : max(0, min(n, i - b + k))]) for i in range(n)]
        assert np.array_equal(got[at : at + n], want), (n, k, b)
        at += n
    assert len(lines.sliding_extremes(flat[:0], lengths[:0], before[:0], kernels[:0], how)) == 0


def rows_of(df):
    return sorted((r["survey_id"], r["r"], r["c"], r["v"]) for r in df.collect())


def test_surveys_of_different_kernels_share_one_opening(spark, monkeypatch):
    monkeypatch.setattr(lines, "BATCH_CELLS", 100)
    rng = np.random.default_rng(8)
    arrays = [np.round(rng.normal(10, 3, s), 3) for s in ((9, 30), (21, 14), (5, 5), (17, 17))]
    arrays[1][3:6, 4:9] = np.nan
    ks = {1: 4, 2: 7, 3: 1, 4: 33}
    cells, g = grid_frame(spark, arrays)
    kernels = spark.createDataFrame(list(ks.items()), "survey_id long, k int")
    want = []
    for s, k in ks.items():
        opened = nb.grey_opening(cells.where(F.col("survey_id") == s), "v", "o", k).select("survey_id", "r", "c", F.col("o").alias("v"))
        want += rows_of(opened)
    assert repr(rows_of(lines.openings(cells, kernels))) == repr(sorted(want, key=lambda x: x[:3]))


def test_result_follows_the_kernel_on_a_slope(spark):
    """A mound of 4 m on a slope of fine cells goes under a kernel of 6 m and stays under one of 2 m."""
    r, c = np.mgrid[0:60, 0:80]
    ground = 100 + 0.02 * c + 0.01 * r
    mound = np.where((np.abs(r - 30) < 8) & (np.abs(c - 40) < 8), 3.0, 0.0)
    cells, _ = grid_frame(spark, [ground + mound, ground + mound])
    g = spark.createDataFrame([(s, 0.0, 0.0, 0.25, 80, 60, "x") for s in (1, 2)], "survey_id long, west double, north double, res double, width int, height int, crs string")
    opened = surface.large_opening(cells, g, F.when(F.col("survey_id") == 1, 2.0).otherwise(6.0))
    top = {r["survey_id"]: r["v"] for r in opened.where("r = 30 and c = 40").collect()}
    assert opened.count() == 2 * 60 * 80 and top[1] > ground[30, 40] + 2.5 and top[2] < ground[30, 40] + 0.2


def test_stretch_leaves_gaps_beside_missing_cells(spark):
    a = np.array([[0.0, 1.0, np.nan], [2.0, 3.0, 4.0]])
    cells, g = grid_frame(spark, [a])
    fine = g.withColumn("width", F.lit(5)).withColumn("height", F.lit(3))
    got = {(r["r"], r["c"]): r["v"] for r in lines.stretch(cells, fine).collect()}
    assert got[0, 2] == 1.0 and got[0, 3] is None and got[1, 4] is None and got[2, 4] == 4.0 and got[1, 1] == 1.5 and got[2, 3] == 3.5
    one = lines.stretch(grid_frame(spark, [np.array([[7.0]])])[0], fine).collect()
    assert len(one) == 15 and all(r["v"] == 7.0 for r in one)
