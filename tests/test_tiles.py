"""Tiles with a halo against whole-raster windows; rings by list ranking against traced ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from moundlake.functions import planar
from moundlake.functions.rings import oriented_area
from moundlake.operators import segments, shapes, tiles
from tests.conftest import grid_frame


def rough(shape, seed, share=0.6):
    rng = np.random.default_rng(seed)
    a = rng.random(shape)
    a = (a + np.roll(a, 1, 0) + np.roll(a, 1, 1) + np.roll(a, (1, 1), (0, 1))) / 4
    return np.where(a > np.quantile(a, 1 - share), 0.6 + np.round(rng.random(shape) * 3, 6), 0.1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("tile", "open_k", "close_k"), [(8, 3, 7), (16, 3, 3), (5, 1, 5), (512, 3, 7), (8, 5, 1)])
def test_segment_equals_whole_raster_windows(spark, tile, open_k, close_k):
    arrays = [rough((37, 53), 1), rough((20, 11), 2, 0.85), np.full((9, 9), 2.0), np.zeros((6, 7))]
    arrays[0][3:9, 5:9] = np.nan  # cells without a value count as height 0
    cells, g = grid_frame(spark, arrays, res=0.5)
    labels = segments.label_cells(segments.heap_mask(cells, 0.5, open_k, close_k), g)
    runs = tiles.segment(cells, g, 0.5, open_k, close_k, tile)
    assert rows_of(tiles.run_cells(runs).select("survey_id", "r", "c", "heap_id")) == rows_of(labels.select("survey_id", "r", "c", "heap_id"))
    want = {(r["survey_id"], r["heap_id"]): r.asDict() for r in segments.component_statistics(labels, cells, g).collect()}
    got = {(r["survey_id"], r["heap_id"]): r.asDict() for r in tiles.run_statistics(runs, g).collect()}
    assert want.keys() == got.keys() and len(want) > 1
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == pytest.approx(value, abs=1e-9), (key, name)
    box = got[max(got)]
    rows = [(r["r"], r["c"]) for r in labels.where((F.col("survey_id") == box["survey_id"]) & (F.col("heap_id") == box["heap_id"])).collect()]
    north = g.where(F.col("survey_id") == box["survey_id"]).first()["north"]
    assert box["bbox_max_n"] == north - min(r for r, _ in rows) * 0.5 and box["bbox_min_n"] == north - (max(r for r, _ in rows) + 1) * 0.5


def test_sums_of_squares_are_exact():
    micro = np.array([[9_000_000_000, 1, 123_456_789], [5, 7, 2]])
    got = tiles.run_squares(micro, np.array([0, 1]), np.array([0, 1]), np.array([2, 2]))
    assert [int(g) for g in got] == [9_000_000_000**2 + 1 + 123_456_789**2, 49 + 4]


def test_rings_equal_traced_ones(spark):
    arrays = [rough((30, 41), 5, 0.55), np.full((12, 12), 1.0)]
    cells, g = grid_frame(spark, arrays, res=1.0)
    labels = segments.label_cells(cells.where("v > 0.5").select("survey_id", "r", "c"), g)
    traced = {}
    for r in shapes.outline_segments(labels).collect():
        a, b, k, side = float(r["a"]), float(r["b"]), float(r["line"]), r["side"]
        line = {"s": (a, -k, b, -k), "n": (b, -k, a, -k), "e": (k, -b, k, -a), "w": (k, -a, k, -b)}[side]
        traced.setdefault((r["survey_id"], r["heap_id"]), []).append(line)
    corner = {r["survey_id"]: (r["west"], r["north"]) for r in g.collect()}
    for row in shapes.outlines(labels, g).collect():
        west, north = corner[row["survey_id"]]
        key = (row["survey_id"], row["heap_id"])
        want = planar.trace(np.array(traced[key]))
        ring_set = lambda rings: sorted(sorted(map(tuple, np.round(r, 6).tolist())) for r in rings)
        got = [np.array([[x - west, y - north] for x, y in ring[:-1]]) for ring in row["rings"]]
        assert ring_set(got) == ring_set(want), key
        areas = [planar.signed_area(r) for r in got]
        assert areas == sorted(areas, reverse=True) and all(ring[0] == ring[-1] for ring in row["rings"])


def test_one_long_ring(spark):
    """A comb with thousands of corners is one ring, whole and in order."""
    a = np.full((400, 41), np.nan)
    a[:, 0] = 1
    a[::2, :] = 1
    cells, g = grid_frame(spark, [a])
    labels = cells.where("v = 1").select("survey_id", "r", "c", F.lit(1).cast("long").alias("heap_id"))
    row = shapes.outlines(labels, g).select("rings", oriented_area(F.col("rings")).alias("area")).first()
    ring = np.array(row["rings"][0])
    assert len(row["rings"]) == 1 and len(ring) > 790
    steps = np.abs(np.diff(ring, axis=0))
    assert row["area"] == pytest.approx(np.nansum(a)) and ((steps == 0).sum(axis=1) == 1).all()
