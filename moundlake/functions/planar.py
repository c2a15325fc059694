"""Small NumPy helpers for the geometry of one polygon or one pair of polygons.

A polygon is a list of rings under the even-odd rule (holes and further parts are
just more rings). Boundaries are cut at all crossings; a piece belongs to the
result when exactly one of its two sides is inside.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np

Rings = list[np.ndarray]
SNAP = 1e-7   # metres; vertices closer than this are one vertex


def to_rings(nested) -> Rings:
    """Nested lists or Arrow arrays to float arrays without the closing vertex."""
    rings = []
    for ring in nested:
        pts = np.array([[float(p[0]), float(p[1])] for p in ring], dtype=float).reshape(-1, 2)
        if len(pts) > 1 and np.array_equal(pts[0], pts[-1]):
            pts = pts[:-1]
        if len(pts) >= 3:
            rings.append(pts)
    return rings


def closed_lists(rings: Rings, origin: np.ndarray) -> list[list[list[float]]]:
    out = []
    for ring in rings:
        pts = (ring + origin).tolist()
        out.append(pts + [pts[0]])
    return out


def ring_segments(rings: Rings) -> np.ndarray:
    parts = [np.hstack([ring, np.roll(ring, -1, axis=0)]) for ring in rings]
    return np.vstack(parts) if parts else np.zeros((0, 4))


def signed_area(ring: np.ndarray) -> float:
    nxt = np.roll(ring, -1, axis=0)
    return float(np.sum(ring[:, 0] * nxt[:, 1] - nxt[:, 0] * ring[:, 1]) / 2.0)


def inside(points: np.ndarray, rings: Rings) -> np.ndarray:
    """Even-odd test, vectorised over points one ring edge block at a time."""
    seg = ring_segments(rings)
    odd = np.zeros(len(points), dtype=bool)
    if not len(seg):
        return odd
    x1, y1, x2, y2 = seg.T
    for start in range(0, len(points), 512):
        px, py = points[start:start + 512, 0:1], points[start:start + 512, 1:2]
        spans = (y1 <= py) != (y2 <= py)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = x1 + (py - y1) * (x2 - x1) / (y2 - y1)
        odd[start:start + 512] = (np.sum(spans & (cross <= px), axis=1) % 2).astype(bool)
    return odd


def cut_at_crossings(seg: np.ndarray) -> np.ndarray:
    """Pieces of the segments between all crossings and overlaps; each piece once."""
    n = len(seg)
    if n == 0:
        return seg
    p, d = seg[:, :2], seg[:, 2:] - seg[:, :2]
    lo, hi = np.minimum(seg[:, :2], seg[:, 2:]) - SNAP, np.maximum(seg[:, :2], seg[:, 2:]) + SNAP
    length = np.hypot(d[:, 0], d[:, 1])
    cuts: list[list[float]] = [[0.0, 1.0] for _ in range(n)]
    for i in range(n):
        near = np.nonzero(np.all((lo <= hi[i]) & (hi >= lo[i]), axis=1))[0]
        near = near[near > i]
        if not len(near) or length[i] <= SNAP:
            continue
        w = p[near] - p[i]
        cross = d[i, 0] * d[near, 1] - d[i, 1] * d[near, 0]
        off = d[i, 0] * w[:, 1] - d[i, 1] * w[:, 0]
        parallel = np.abs(cross) <= 1e-12 * length[i] * np.maximum(length[near], SNAP)
        for k in np.nonzero(~parallel)[0]:
            j = near[k]
            t = (w[k, 0] * d[j, 1] - w[k, 1] * d[j, 0]) / cross[k]
            s = (w[k, 0] * d[i, 1] - w[k, 1] * d[i, 0]) / cross[k]
            et, es = SNAP / length[i], SNAP / max(length[j], SNAP)
            if -et <= t <= 1 + et and -es <= s <= 1 + es:
                cuts[i].append(t)
                cuts[j].append(s)
        for k in np.nonzero(parallel & (np.abs(off) <= SNAP * length[i]))[0]:
            j = near[k]
            for end in (seg[j, :2], seg[j, 2:]):
                cuts[i].append(float(np.dot(end - p[i], d[i]) / length[i] ** 2))
            for end in (seg[i, :2], seg[i, 2:]):
                cuts[j].append(float(np.dot(end - p[j], d[j]) / max(length[j], SNAP) ** 2))
    pieces = set()
    for i in range(n):
        ts = sorted(t for t in cuts[i] if -1e-9 <= t <= 1 + 1e-9)
        pts = [tuple(np.round((p[i] + t * d[i]) / SNAP).astype(np.int64)) for t in ts]
        for a, b in zip(pts[:-1], pts[1:], strict=True):
            if a != b:
                pieces.add((a, b) if a < b else (b, a))
    if not pieces:
        return np.zeros((0, 4))
    return np.array([[*a, *b] for a, b in sorted(pieces)], dtype=float) * SNAP


def sides(pieces: np.ndarray, test: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the left and the right side of each piece is inside."""
    mid = (pieces[:, :2] + pieces[:, 2:]) / 2.0
    d = pieces[:, 2:] - pieces[:, :2]
    size = np.hypot(d[:, 0], d[:, 1])[:, None]
    normal = np.column_stack([-d[:, 1], d[:, 0]]) / size
    step = np.minimum(size * 1e-3, 1e-4)
    return test(mid + normal * step), test(mid - normal * step)


def boundary(pieces: np.ndarray, test: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Directed boundary pieces with the inside on their left."""
    if not len(pieces):
        return pieces
    left, right = sides(pieces, test)
    forward = pieces[left & ~right]
    backward = pieces[right & ~left][:, [2, 3, 0, 1]]
    return np.vstack([forward, backward])


def trace(directed: np.ndarray) -> Rings:
    """Rings of directed pieces, taking the sharpest left turn at every vertex.

    Outer rings come out counter-clockwise, holes clockwise.
    """
    key = [(tuple(np.round(e[:2] / SNAP).astype(np.int64)), tuple(np.round(e[2:] / SNAP).astype(np.int64))) for e in directed]
    leaving: dict[tuple, list[int]] = defaultdict(list)
    for i, (a, _) in enumerate(key):
        leaving[a].append(i)
    heading = np.arctan2(directed[:, 3] - directed[:, 1], directed[:, 2] - directed[:, 0]) if len(directed) else []
    used = [False] * len(key)
    rings = []
    for start in range(len(key)):
        if used[start]:
            continue
        ring, i = [], start
        while not used[i]:
            used[i] = True
            ring.append(directed[i, :2])
            back = heading[i] + math.pi
            options = [j for j in leaving[key[i][1]] if not used[j] or j == start]
            if not options:
                break
            # the way straight back comes last, also when its angle is not quite 0
            turns = {j: (back - heading[j]) % (2 * math.pi) for j in options}
            i = min(options, key=lambda j: turns[j] if turns[j] > 1e-12 else 2 * math.pi)
        if len(ring) >= 3:
            rings.append(drop_collinear(np.array(ring)))
    return [ring for ring in rings if len(ring) >= 3 and abs(signed_area(ring)) > SNAP]


def drop_collinear(ring: np.ndarray) -> np.ndarray:
    before, after = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
    turn = before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0]
    scale = np.hypot(*before.T) * np.hypot(*after.T)
    return ring[np.abs(turn) > 1e-9 * np.maximum(scale, 1e-12)]


def group_parts(rings: Rings) -> list[Rings]:
    """Outer rings with the holes inside them."""
    outers = [r for r in rings if signed_area(r) > 0]
    parts = [[r] for r in sorted(outers, key=lambda r: -signed_area(r))]
    for hole in (r for r in rings if signed_area(r) <= 0):
        probe = hole[:1] + (hole[1:2] - hole[:1]) * 0.5
        for part in reversed(parts):   # the smallest outer ring that holds it
            if inside(probe, [part[0]])[0] or inside(hole, [part[0]]).any():
                part.append(hole)
                break
    return parts


def repair(rings: Rings) -> list[Rings]:
    """Valid parts of a polygon whose rings may cross, by the even-odd rule."""
    pieces = cut_at_crossings(ring_segments(rings))
    return group_parts(trace(boundary(pieces, lambda q: inside(q, rings))))


def union(polygons: list[Rings]) -> list[Rings]:
    def covered(q: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(q), dtype=bool)
        for rings in polygons:
            hit |= inside(q, rings)
        return hit

    pieces = cut_at_crossings(np.vstack([ring_segments(r) for r in polygons]))
    return group_parts(trace(boundary(pieces, covered)))


def _green(directed: np.ndarray) -> float:
    return float(np.sum(directed[:, 0] * directed[:, 3] - directed[:, 2] * directed[:, 1]) / 2.0) if len(directed) else 0.0


def overlap_areas(a: Rings, b: Rings) -> tuple[float, float]:
    """Areas of intersection and union."""
    pieces = cut_at_crossings(np.vstack([ring_segments(a), ring_segments(b)]))
    both = boundary(pieces, lambda q: inside(q, a) & inside(q, b))
    either = boundary(pieces, lambda q: inside(q, a) | inside(q, b))
    return max(_green(both), 0.0), max(_green(either), 0.0)


def area(parts: list[Rings]) -> float:
    return sum(signed_area(r) for part in parts for r in part)


def split_by_line(rings: Rings, line: np.ndarray) -> list[Rings]:
    """Parts of a polygon cut by a polyline; line ends that dangle inside do not cut."""
    line_seg = np.hstack([line[:-1], line[1:]])
    pieces = cut_at_crossings(np.vstack([ring_segments(rings), line_seg]))
    test = lambda q: inside(q, rings)
    left, right = sides(pieces, test)
    edges = boundary(pieces, test)
    cutters = pieces[left & right]
    while len(cutters):   # drop line pieces with a free end
        ends = np.round(np.vstack([cutters[:, :2], cutters[:, 2:]]) / SNAP).astype(np.int64)
        fixed = {tuple(k) for k in np.round(edges[:, :2] / SNAP).astype(np.int64)}
        degree: dict[tuple, int] = defaultdict(int)
        for k in map(tuple, ends):
            degree[k] += 1
        m = len(cutters)
        keep = np.array([
            all(degree[tuple(ends[k])] > 1 or tuple(ends[k]) in fixed for k in (i, i + m)) for i in range(m)
        ])
        if keep.all():
            break
        cutters = cutters[keep]
    if len(cutters):
        edges = np.vstack([edges, cutters, cutters[:, [2, 3, 0, 1]]])
    return group_parts(trace(edges))


def simplify_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a ring, anchored at its first and its farthest vertex; keeps at least 3."""
    if len(ring) <= 4 or tolerance <= 0:
        return ring
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    path = np.vstack([ring, ring[:1]])
    keep = np.zeros(len(path), dtype=bool)
    keep[[0, far, len(path) - 1]] = True
    stack = [(0, far), (far, len(path) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        a, d = path[i], path[j] - path[i]
        q = path[i + 1:j] - a
        size = math.hypot(d[0], d[1])
        gap = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / size if size > 0 else np.hypot(q[:, 0], q[:, 1])
        k = int(np.argmax(gap))
        if gap[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    out = path[:-1][keep[:-1]]
    return out if len(out) >= 3 else ring
