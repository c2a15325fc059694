"""Geometry helpers, assignment and watershed against brute force."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moundlake.functions import planar
from moundlake.functions.rings import oriented_area
from moundlake.operators import compare, shapes, watershed
from moundlake.operators.compare import best_assignment, candidate_pairs, polygon_iou
from moundlake.operators.graph import connected_components
from tests.conftest import grid_frame, to_arrays


def disc(x, y, r, n=64):
    return np.array([[x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)] for k in range(n)])


def box(x1, y1, x2, y2):
    return np.array([[x1, y1], [x2, y1], [x2, y2], [x1, y2]], dtype=float)


def test_overlap_of_boxes_and_identical_discs():
    assert planar.overlap_areas([box(0, 0, 4, 4)], [box(2, 1, 6, 3)]) == pytest.approx((4.0, 20.0))
    assert planar.overlap_areas([box(0, 0, 1, 1)], [box(5, 5, 6, 6)]) == pytest.approx((0.0, 2.0))
    a = [disc(0, 0, 10)]
    common, either = planar.overlap_areas(a, a)
    assert common == pytest.approx(either) == pytest.approx(planar.signed_area(a[0]), rel=1e-6)


def test_overlap_with_a_hole():
    ring = [box(0, 0, 10, 10), box(3, 3, 7, 7)]
    assert planar.overlap_areas(ring, [box(0, 0, 5, 10)]) == pytest.approx((50 - 8, 84 + 50 - 42))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 6), st.integers(1, 6)), min_size=2, max_size=5))
def test_union_of_boxes_equals_cell_count(boxes):
    parts = planar.union([[box(x, y, x + w, y + h)] for x, y, w, h in boxes])
    cells = {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}
    assert planar.area(parts) == pytest.approx(len(cells), abs=1e-4)


def test_bow_tie_is_repaired_into_two_triangles():
    parts = planar.repair([np.array([[0, 0], [10, 10], [10, 0], [0, 10]], dtype=float)])
    assert len(parts) == 2 and planar.area(parts) == pytest.approx(50)


@pytest.mark.parametrize("line,areas", [
    ([[5, -1], [5, 11]], [50, 50]),
    ([[-1, 3], [4, 3], [4, 11]], [28, 72]),
    ([[-1, 2], [11, 2], [11, 8], [-1, 8]], [20, 20, 60]),
])
def test_split_areas_add_up(line, areas):
    parts = planar.split_by_line([box(0, 0, 10, 10)], np.array(line, dtype=float))
    assert sorted(round(planar.area([p])) for p in parts) == areas


def test_split_keeps_a_hole_in_its_part():
    rings = [box(0, 0, 10, 10), box(1, 1, 3, 3)]
    parts = planar.split_by_line(rings, np.array([[5.0, -1], [5, 11]]))
    assert sorted(round(planar.area([p])) for p in parts) == [46, 50]


def test_a_line_that_ends_inside_does_not_cut():
    assert len(planar.split_by_line([box(0, 0, 10, 10)], np.array([[5.0, -1], [5, 5]]))) == 1


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.data())
def test_assignment_is_optimal(n, m, data):
    w = {(i, j): data.draw(st.integers(0, 9)) / 10 for i in range(n) for j in range(m)}
    edges = [(i, j, v) for (i, j), v in w.items() if v > 0]
    got = best_assignment(edges)
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    side = max(n, m)
    best = max(sum(w.get((i, p[i]), 0) for i in range(side)) for p in itertools.permutations(range(side)))
    assert sum(w[e] for e in got) == pytest.approx(best)


def test_connected_components_of_paths_stars_and_loops(spark):
    rows = [(1, k, k + 1) for k in range(300)] + [(2, 0, k) for k in range(1, 200)] + [(2, 500, 500), (3, 9, 8), (3, 8, 7)]
    df = spark.createDataFrame(rows, "survey_id long, a long, b long")
    got = {(r["survey_id"], r["node"]): r["root"] for r in connected_components(df).collect()}
    assert all(got[1, k] == 0 for k in range(301)) and all(got[2, k] == 0 for k in range(200))
    assert got[2, 500] == 500 and got[3, 9] == 7 and len(got) == 301 + 201 + 3


def test_outlines_of_touching_cells_and_holes(spark):
    a = np.full((6, 6), np.nan)
    a[1:5, 1:5] = 1
    a[2, 2] = np.nan           # hole
    a[5, 5] = 1                # touches diagonally
    cells, g = grid_frame(spark, [a], res=0.5)
    labels = cells.where("v is not null").select("survey_id", "r", "c", F.lit(1).cast("long").alias("heap_id"))
    row = shapes.outlines(labels, g).select("rings", oriented_area(F.col("rings")).alias("a")).first()
    assert row["a"] == pytest.approx(16 * 0.25) and len(row["rings"]) == 3
    assert min(p[0] for ring in row["rings"] for p in ring) == 1000.5


def test_polygon_iou_finds_pairs_across_blocks(spark):
    def poly(r):
        return [[[float(x), float(y)] for x, y in np.vstack([r, r[:1]])]]

    a = spark.createDataFrame([(1, 1, poly(box(0, 0, 200, 200))), (1, 2, poly(disc(300, 300, 20)))], "pair_id long, heap_id long, rings array<array<array<double>>>")
    b = spark.createDataFrame([(1, 7, poly(box(100, 100, 300, 300))), (1, 8, poly(disc(300, 300, 10))), (2, 9, poly(box(0, 0, 1, 1)))], "pair_id long, heap_id long, rings array<array<array<double>>>")
    pairs = candidate_pairs(a, b)
    assert pairs.count() == pairs.select("heap_a", "heap_b").distinct().count()
    got = {(r["heap_a"], r["heap_b"]): r["iou"] for r in polygon_iou(pairs).collect()}
    assert got[1, 7] == pytest.approx(10000 / 70000)
    assert got[2, 8] == pytest.approx(0.25, rel=1e-6) and (2, 7) in got and (1, 8) not in got


def brute_flood(h, mask, markers):
    """Flooding from the markers, highest cells first; a cell takes the label of the first flooded neighbour."""
    import heapq

    lab = markers.copy()
    queue, age = [], 0
    for r, c in np.argwhere(markers > 0):
        heapq.heappush(queue, (-h[r, c], age, r, c))
        age += 1
    while queue:
        _, _, r, c = heapq.heappop(queue)
        for dr, dc in ((-1, 0), (0, -1), (0, 1), (1, 0)):
            y, x = r + dr, c + dc
            if 0 <= y < h.shape[0] and 0 <= x < h.shape[1] and mask[y, x] and not lab[y, x]:
                lab[y, x] = lab[r, c]
                heapq.heappush(queue, (-h[y, x], age, y, x))
                age += 1
    return lab


@pytest.mark.parametrize("noise", [0.0, 2.5])
def test_watershed_equals_flooding(spark, noise):
    r, c = np.mgrid[0:40, 0:70]
    local = np.random.default_rng(3)
    h = np.maximum.reduce([9 - 0.11 * ((r - y) ** 2 + (c - x) ** 2) ** 0.75 for y, x in ((14, 15), (22, 34), (16, 53))])
    h = np.round(np.where(h > 0.5, h + noise * local.random(h.shape) + 1e-4 * local.random(h.shape), 0), 6)
    mask = h > 0
    cells, g = grid_frame(spark, [h])
    labels = spark.createDataFrame([(1, int(y), int(x), 4) for y, x in np.argwhere(mask)], "survey_id long, r int, c int, heap_id long")
    labels = labels.union(spark.createDataFrame([(1, 0, 0, 9)], labels.schema)) if not mask[0, 0] else labels
    found = watershed.peaks(labels, cells, g, 8).orderBy("r", "c").collect()
    assert len(found) == 3
    markers = np.zeros(h.shape, dtype=int)
    for k, p in enumerate(found):
        markers[p["r"], p["c"]] = 10 + k
    got = to_arrays(watershed.split_heaps(labels, cells, g, 8), "heap_id", [h.shape], 0)[0]
    got[0, 0] = 0
    assert np.array_equal(got, brute_flood(h, mask, markers))


def test_a_single_top_is_not_split(spark):
    r, c = np.mgrid[0:30, 0:30]
    h = np.maximum(0, 8 - np.hypot(r - 15, c - 15))
    cells, g = grid_frame(spark, [h])
    labels = spark.createDataFrame([(1, int(y), int(x), 1) for y, x in np.argwhere(h > 0)], "survey_id long, r int, c int, heap_id long")
    assert watershed.split_heaps(labels, cells, g, 5).select("heap_id").distinct().count() == 1


def test_polygon_iou_equals_overlay(spark):
    """Rings either way round, holes, parts, shared edges and slanted crossings against the overlay of one pair."""
    rng = np.random.default_rng(4)

    def star(x, y, n, turn=1):
        angle = np.sort(rng.random(n)) * 2 * np.pi
        size = rng.uniform(3, 9, n)
        return np.column_stack([x + size * np.cos(angle), y + size * np.sin(angle)])[::turn]

    shapes_a = [[star(20, 20, 15)], [star(20, 20, 9, -1)], [box(0, 0, 12, 12), box(3, 3, 9, 9)], [box(0, 0, 5, 5), box(8, 0, 13, 5)[::-1]], [box(0, 0, 4, 4)]]
    shapes_b = [[star(22, 18, 12, -1)], [star(15, 22, 20)], [box(5, 5, 20, 20)[::-1], box(6, 6, 7, 7)], [box(4, 1, 9, 4)], [box(4, 0, 8, 4)]]
    rows, want = [], {}
    for i, a in enumerate(shapes_a):
        for j, b in enumerate(shapes_b):
            lists = lambda rings: [[[float(x) + 500_000, float(y) + 5_000_000] for x, y in np.vstack([r, r[:1]])] for r in rings]
            rows.append((1, i, j, lists(a), lists(b)))
            common, either = planar.overlap_areas(a, b)
            if common > 1e-6:
                want[i, j] = common / either
    kinds = "pair_id long, heap_a long, heap_b long, rings_a array<array<array<double>>>, rings_b array<array<array<double>>>"
    got = {(r["heap_a"], r["heap_b"]): r["iou"] for r in polygon_iou(spark.createDataFrame(rows, kinds)).collect()}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


def test_small_comparisons_are_assigned_without_the_loop_and_large_ones_alike(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = {(p, int(a), int(b)): float(rng.integers(1, 1000)) / 1000 for p in range(4) for a, b in rng.integers(0, 12 + 20 * p, (60, 2))}
    edges = spark.createDataFrame([(*k, w) for k, w in rows.items()], "pair_id long, heap_a long, heap_b long, iou double")
    calls, loop = [], compare.connected_components
    monkeypatch.setattr(compare, "connected_components", lambda *a: calls.append(a) or loop(*a))
    whole = {tuple(r) for r in compare.assign(edges, 0.1).collect()}
    assert not calls
    want = {(p, a, b, rows[p, a, b]) for p in range(4) for a, b in best_assignment([(a, b, w) for (q, a, b), w in rows.items() if q == p]) if rows[p, a, b] >= 0.1}
    assert whole == want
    for most in (1, 50):  # all comparisons, or some of them, taken apart
        assert {tuple(r) for r in compare.assign(edges, 0.1, whole_edges=most).collect()} == want
    assert calls
