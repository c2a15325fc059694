"""Raster operators against plain NumPy definitions on small random grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundlake.operators import neighbourhood as nb
from moundlake.operators import segments, surface
from moundlake.operators.quantiles import group_percentile
from tests.conftest import grid_frame, to_arrays

rng = np.random.default_rng(7)


def brute_opening(a, k):
    lo, hi = k // 2, k - 1 - k // 2

    def box(x, before, after, pick):
        h, w = x.shape
        return np.array([[pick(x[max(0, r - before):r + after + 1, max(0, c - before):c + after + 1]) for c in range(w)] for r in range(h)])

    return box(box(a, lo, hi, np.min), hi, lo, np.max)


@pytest.mark.parametrize("k", [3, 4, 9, 17, 20, 35])
def test_grey_opening_equals_numpy(spark, k):
    a, b = rng.integers(0, 50, (23, 41)).astype(float), rng.integers(0, 50, (37, 18)).astype(float)
    cells, _ = grid_frame(spark, [a, b])
    got = to_arrays(nb.grey_opening(cells, "v", "o", k), "o", [a.shape, b.shape])
    assert np.array_equal(got[0], brute_opening(a, k))
    assert np.array_equal(got[1], brute_opening(b, k))


def test_opening_is_idempotent_and_below_input(spark):
    a = rng.random((30, 30))
    cells, _ = grid_frame(spark, [a])
    once = nb.grey_opening(cells, "v", "o", 5).select("survey_id", "r", "c", F.col("o").alias("v"))
    twice = to_arrays(nb.grey_opening(once, "v", "o", 5), "o", [a.shape])[0]
    first = to_arrays(once, "v", [a.shape])[0]
    assert np.array_equal(first, twice) and (first <= a).all()


def test_gradient_equals_numpy(spark):
    a = rng.random((9, 14))
    cells, _ = grid_frame(spark, [a])
    out = nb.gradient(cells, "v", F.lit(0.5))
    gy, gx = np.gradient(a, 0.5, 0.5)
    assert np.allclose(to_arrays(out, "gx", [a.shape])[0], gx)
    assert np.allclose(to_arrays(out, "gy", [a.shape])[0], gy)


def brute_nearest(a):
    known = np.argwhere(~np.isnan(a))
    out = a.copy()
    for r, c in np.argwhere(np.isnan(a)):
        d2 = (known[:, 0] - r) ** 2 + (known[:, 1] - c) ** 2
        best = np.lexsort((known[:, 1], known[:, 0], d2))[0]
        out[r, c] = a[tuple(known[best])]
    return out


def test_nearest_fill_equals_brute_force_with_large_voids(spark):
    sparse = np.where(rng.random((40, 55)) < 0.02, rng.random((40, 55)), np.nan)
    corner = np.full((30, 30), np.nan)
    corner[:4, :3] = rng.random((4, 3))
    one = np.full((6, 9), np.nan)
    one[5, 8] = 3.0
    cells, _ = grid_frame(spark, [sparse, corner, one])
    got = to_arrays(surface.nearest_fill(cells), "v", [sparse.shape, corner.shape, one.shape])
    for a, b in zip(got, (sparse, corner, one), strict=True):
        assert np.array_equal(a, brute_nearest(b))


def test_nearest_fill_of_an_empty_survey_stays_empty(spark):
    cells, _ = grid_frame(spark, [np.full((4, 5), np.nan)])
    assert surface.nearest_fill(cells).where("v is not null").isEmpty()


@pytest.mark.parametrize("axis", ["row", "column"])
def test_dense_cells_fill_the_grid(spark, axis):
    a = np.where(rng.random((7, 5)) < 0.5, 1.0, np.nan)
    cells, g = grid_frame(spark, [a])
    out = nb.dense_cells(cells.where("v is not null"), g, axis)
    assert out.count() == 35
    assert np.array_equal(to_arrays(out, "v", [a.shape])[0], a, equal_nan=True)


def brute_labels(mask):
    h, w = mask.shape
    lab = np.zeros(mask.shape, dtype=int)
    n = 0
    for r in range(h):
        for c in range(w):
            if mask[r, c] and not lab[r, c]:
                n += 1
                stack = [(r, c)]
                lab[r, c] = n
                while stack:
                    y, x = stack.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            p, q = y + dy, x + dx
                            if 0 <= p < h and 0 <= q < w and mask[p, q] and not lab[p, q]:
                                lab[p, q] = n
                                stack.append((p, q))
    return lab


@pytest.mark.parametrize("band", [2_000_000, 200, 30])
def test_components_equal_flood_fill_also_across_bands(spark, monkeypatch, band):
    monkeypatch.setattr(segments, "BAND_CELLS", band)
    masks = [rng.random((33, 47)) < p for p in (0.25, 0.42)]
    spiral = np.zeros((21, 21), dtype=bool)
    for k in range(0, 10, 2):
        spiral[k, k:21 - k] = spiral[20 - k, k:21 - k] = True
        spiral[k:21 - k, 20 - k] = True
        spiral[k + 2:21 - k, k] = True
        if k:
            spiral[k, k - 1] = True
    masks.append(spiral)
    cells, g = grid_frame(spark, [np.where(m, 1.0, np.nan) for m in masks])
    out = segments.label_cells(cells.where("v is not null").select("survey_id", "r", "c"), g)
    got = to_arrays(out, "heap_id", [m.shape for m in masks], 0)
    for a, m in zip(got, masks, strict=True):
        assert np.array_equal(a, brute_labels(m))


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_group_percentile_equals_numpy(spark, q):
    flat = np.concatenate([np.full(400, 100.0), 100 + np.round(rng.random(300), 6)])
    wide = np.round(rng.normal(50, 20, 500), 6)
    rows = [(1, float(v)) for v in flat] + [(2, float(v)) for v in wide] + [(3, 5.5)]
    df = spark.createDataFrame(rows, "survey_id long, v double")
    got = {r["survey_id"]: r["p"] for r in group_percentile(df, ["survey_id"], "v", q, "p").collect()}
    assert got[1] == pytest.approx(np.quantile(flat, q), abs=1e-6)
    assert got[2] == pytest.approx(np.quantile(wide, q), abs=1e-6)
    assert got[3] == 5.5


def test_upsample_keeps_corners_and_interpolates(spark):
    coarse = np.array([[0.0, 10.0], [20.0, 30.0]])
    cells, cg = grid_frame(spark, [coarse])
    fine = cg.withColumn("width", F.lit(11)).withColumn("height", F.lit(5))
    out = to_arrays(surface.upsample(cells, cg, fine), "v", [(5, 11)])[0]
    assert out[0, 0] == 0 and out[4, 10] == 30 and out[2, 5] == 15


def test_points_outside_the_grid_are_dropped(spark):
    g = grid_frame(spark, [np.zeros((10, 10))])[1]
    rows = [(1, 1000.0, 2000.0, 1.0, 2), (1, 1010.0, 2005.0, 1.0, 2), (1, 1005.5, 2005.5, 1.0, 2), (1, 999.9, 2005.0, 1.0, 2)]
    pts = spark.createDataFrame(rows, "survey_id long, x double, y double, z double, classification int")
    assert [(r["r"], r["c"]) for r in surface.bin_points(pts, g).collect()] == [(4, 5)]


def test_coverage_gate_and_fallback_to_automatic(spark):
    """A survey with ground in 4 % of its cells falls through to the automatic base."""
    from moundlake.plans.process import Config, terrain_rasters

    dsm = np.full((50, 50), 100.0)
    dsm[20:30, 20:30] = 105.0
    cells, g = grid_frame(spark, [dsm, dsm])
    few = [(1, 1000.5 + c, 2049.5 - r, 100.0, 2) for r in range(10) for c in range(10)]
    many = [(2, 1000.5 + c, 2049.5 - r, 100.0, 2) for r in range(50) for c in range(50) if not (20 <= r < 30 and 20 <= c < 30)]
    pts = spark.createDataFrame(few + many, "survey_id long, x double, y double, z double, classification int")
    raster, summary = terrain_rasters(cells, pts, g, Config(morpho_kernel_size=15))
    got = {r["survey_id"]: r for r in summary.collect()}
    assert got[1]["method"] == "morphological" and got[1]["confidence"] == 0.9 and got[1]["base"] == 100.0
    assert got[2]["method"] == "ground_classification" and got[2]["base"] == 100.0
    arrays = to_arrays(raster, "v", [(50, 50)] * 2)
    assert (arrays[0] == 100).all() and (arrays[1] == 100).all()


def test_opening_scale_depends_on_the_cell_size_only(spark):
    g = spark.createDataFrame([(1.0,), (0.5,), (0.25,), (0.1,), (2.0,)], "res double")
    got = g.select("res", *surface.opening_scale(g.res, 150.0)).collect()
    assert sorted(map(tuple, got)) == [(0.1, 5, 300), (0.25, 2, 300), (0.5, 1, 300), (1.0, 1, 150), (2.0, 1, 75)]


def test_opening_wider_than_the_raster_is_its_lowest_value(spark):
    a = np.arange(30.0).reshape(5, 6) + 100
    cells, g = grid_frame(spark, [a])
    out = to_arrays(surface.large_opening(cells, g, 50.0), "v", [a.shape])
    assert (out[0] == 100).all()


def test_large_opening_over_mixed_geometries(spark):
    fine = np.full((130, 130), 10.0)
    fine[40:60, 40:60] = 15.0
    coarse = np.full((20, 20), 3.0)
    coarse[5:8, 5:8] = 9.0
    cells, _ = grid_frame(spark, [fine, coarse])
    g = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.2, 130, 130, "x"), (2, 0.0, 0.0, 1.0, 20, 20, "x")],
        "survey_id long, west double, north double, res double, width int, height int, crs string",
    )
    out = to_arrays(surface.large_opening(cells, g, 10.0), "v", [fine.shape, coarse.shape])
    assert (out[0] == 10).all() and (out[1] == 3).all()


def test_every_survey_has_its_own_configuration(spark):
    """Four surveys of one mound in one job: own threshold, own least area, a manual base, and a broken configuration."""
    from moundlake.plans.process import Config, process
    from moundlake.sources.documents import parse_config

    r, c = np.mgrid[0:40, 0:40]
    mound = 100 + np.maximum(0, 9 - 0.7 * np.hypot(r - 20, c - 20))
    pts = [(s, 1000.5 + j, 2039.5 - i, float(round(mound[i, j], 3)), 2 if mound[i, j] == 100 else 1) for s in range(1, 6) for i in range(40) for j in range(40)]
    points = spark.createDataFrame(pts, "survey_id long, x double, y double, z double, classification int")
    _, g = grid_frame(spark, [mound] * 5)
    texts = [(1, None), (2, '{"height_threshold": 2.0}'), (3, '{"min_heap_area": 10000}'), (4, '{"manual_base_elevation": 99.0}'), (5, '{"height_threshold": "x"}')]
    configs = parse_config(spark.createDataFrame(texts, "survey_id long, config string"))
    result = process(points, g, Config(), configs=configs)
    got = {x["survey_id"]: x for x in result.metrics.collect()}
    one = {x["survey_id"]: x for x in process(points.where("survey_id = 1"), g.where("survey_id = 1"), Config()).metrics.collect()}
    assert got[1]["volume_m3"] == one[1]["volume_m3"] and set(got) <= {1, 2, 4}
    assert got[2]["planimetric_area_m2"] < got[1]["planimetric_area_m2"] and got[2]["mean_height_m"] > got[1]["mean_height_m"]
    codes = {x["survey_id"]: x["filter_code"] for x in result.classified.collect()}
    assert codes[3] == "too_small" and 5 not in codes
    base = {x["survey_id"]: (x["base"], x["method"]) for x in result.terrain.collect()}
    assert base[4] == (99.0, "manual") and base[1][1] == "ground_classification" and 5 not in base
    heaps = {x["survey_id"]: x for x in result.heaps().collect()}
    assert heaps.keys() == got.keys() and all(len(x["rings"]) == 1 for x in heaps.values())
