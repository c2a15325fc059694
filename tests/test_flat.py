"""Geometry of whole batches against the helpers for one polygon."""

import numpy as np
import pyarrow as pa
import pytest

from moundlake.functions import flat, planar


def nested(rings):
    return [[[*map(float, p)] for p in np.vstack([r, r[:1]])] for r in rings]


def polygons(seed, n=400):
    """Random, crossing, holed, degenerate and long polygons on coarse coordinates, so that many corners and edges meet."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        rings = [rng.integers(0, 9, (rng.integers(3, 8), 2)).astype(float) for _ in range(rng.integers(0, 3))]
        if k % 7 == 0:
            x, y = rng.integers(0, 5, 2)
            rings = [np.array([[x, y], [x + 4, y], [x + 4, y + 4], [x, y + 4]], float), np.array([[x + 1, y + 1], [x + 2, y + 1], [x + 2, y + 3], [x + 1, y + 3]], float)]
        if k % 50 == 1:
            turn = np.linspace(0, 2 * np.pi, 150, endpoint=False)
            rings = [np.column_stack([np.cos(turn), np.sin(turn)]) * (3 + (np.arange(150) % 5)[:, None] / 7) + 4]
        out.append(rings)
    return out


def batch(shapes):
    return flat.decode(pa.array([nested(s) for s in shapes], pa.list_(pa.list_(pa.list_(pa.float64())))))


def back(rings, n):
    out = [[] for _ in range(n)]
    for xy, owner, part in zip(np.split(rings.xy, np.cumsum(rings.sizes)[:-1]) if len(rings.sizes) else [], rings.owner, rings.part, strict=True):
        if part == len(out[owner]):
            out[owner].append([])
        out[owner][part].append(xy)
    return out


def areas(parts):
    return sorted(round(planar.area([p]), 5) for p in parts)


@pytest.mark.parametrize("limit", [50, 2_000_000])
def test_repair_and_union(monkeypatch, limit):
    monkeypatch.setattr(flat, "PAIRS", limit)
    shapes = polygons(1)
    rings = batch(shapes)
    got = back(flat.merged(rings, np.zeros(len(rings.owner), dtype=int), len(shapes)), len(shapes))
    for one, parts in zip(shapes, got, strict=True):
        assert areas(parts) == areas(planar.repair(one) if one else [])
    groups = [shapes[i:i + 3] for i in range(0, len(shapes), 3)]
    of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    united = flat.merged(rings._replace(owner=of[rings.owner]), rings.owner, len(groups))
    for group, parts in zip(groups, back(united, len(groups)), strict=True):
        group = [g for g in group if g]
        assert areas(parts) == areas(planar.union(group) if group else [])


@pytest.mark.parametrize("limit", [50, 2_000_000])
def test_split(monkeypatch, limit):
    monkeypatch.setattr(flat, "PAIRS", limit)
    shapes = polygons(2)
    rng = np.random.default_rng(3)
    lines = [rng.integers(-1, 10, (rng.integers(2, 5), 2)).astype(float) for _ in shapes]
    of = np.repeat(np.arange(len(shapes)), [len(line) for line in lines])
    parts, meets = flat.split(batch(shapes), np.vstack(lines), of, len(shapes))
    for one, line, got, met in zip(shapes, lines, back(parts, len(shapes)), meets, strict=True):
        if one:
            assert areas(got) == areas(planar.split_by_line(one, line))
            seg = np.vstack([planar.ring_segments(one), np.hstack([line[:-1], line[1:]])])
            assert met == (len(planar.cut_at_crossings(seg)) > len(seg) or planar.inside(line, one).any())
        else:
            assert not got


def test_simplify_and_nested_lists():
    shapes = polygons(4)
    tolerance = np.arange(len(shapes)) % 5 / 4.0
    rings = batch(shapes)
    simple = flat.simplify(rings, tolerance)
    want = [planar.simplify_ring(r, tolerance[k]) for k, one in enumerate(shapes) for r in one]
    got = np.split(simple.xy, np.cumsum(simple.sizes)[:-1])
    assert len(got) == len(want) and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
    null = np.array([not s for s in shapes])
    assert flat.encode(rings, rings.owner, len(shapes), null).to_pylist() == [nested(s) if s else None for s in shapes]
