"""The geometry of ``planar`` for all polygons of an Arrow batch at once.

Rings, segments and pieces of all polygons lie in flat arrays, ascending by the number of their polygon. What
``planar`` does in a loop over one polygon is one NumPy step here, over PAIRS pairs at a time, whatever the polygons' sizes.
Polygons with holes in their result, and boundaries that don't close cleanly, go through ``planar`` one by one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from moundlake.functions import planar
from moundlake.functions.planar import SNAP

PAIRS = 2_000_000


class Flat(NamedTuple):
    """Rings without closing vertex: points, points per ring, polygon (ascending) and part of each ring."""

    xy: np.ndarray
    sizes: np.ndarray
    owner: np.ndarray
    part: np.ndarray

    def take(self, rings: np.ndarray) -> Flat:
        sizes = self.sizes[rings]
        return Flat(self.xy[runs(starts(self.sizes)[rings], sizes)], sizes, self.owner[rings], self.part[rings])


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ...``, ``sizes[k]`` of them, for every k."""
    return np.repeat(first - starts(sizes), sizes) + np.arange(sizes.sum())


def bounds(owner: np.ndarray, count: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(count + 1))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def pairs(of: np.ndarray, first: np.ndarray):
    """Every item with every row of its polygon ``of``, whose rows begin at ``first``."""
    counts = first[of + 1] - first[of]
    ends = np.cumsum(counts)
    at = 0
    while at < len(of):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        yield np.repeat(np.arange(at, stop), counts[at:stop]), runs(first[of[at:stop]], counts[at:stop])
        at = stop


def decode(column: pa.Array) -> Flat:
    """Rings of three vertices at least from nested lists of points."""
    length = lambda a: pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    rings = column.flatten()
    points = rings.flatten()
    sizes, owner = length(rings), np.repeat(np.arange(len(column)), length(column))
    values, at = points.flatten().to_numpy(zero_copy_only=False), starts(length(points))
    xy = np.column_stack([values[at], values[at + 1]]) if len(at) else np.zeros((0, 2))
    first = starts(sizes)
    several = sizes > 1
    closed = several.copy()
    closed[several] = np.all(xy[first[several]] == xy[first[several] + sizes[several] - 1], axis=1)
    open_sizes = sizes - closed
    keep = open_sizes >= 3
    return Flat(xy[runs(first[keep], open_sizes[keep])], open_sizes[keep], owner[keep], np.zeros(keep.sum(), dtype=np.int64))


def encode(rings: Flat, polygon: np.ndarray, count: int, null: np.ndarray) -> pa.Array:
    """Closed rings as nested lists, ``polygon`` the row of each ring; null where told."""
    first = starts(rings.sizes)
    at = runs(first, rings.sizes + 1)
    at[np.cumsum(rings.sizes + 1) - 1] = first
    points = pa.ListArray.from_arrays(np.arange(0, 2 * len(at) + 1, 2, dtype=np.int32), rings.xy[at].ravel())
    lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(rings.sizes + 1)).astype(np.int32), points)
    return pa.ListArray.from_arrays(bounds(polygon, count).astype(np.int32), lists, mask=pa.array(null))


def localise(rings: Flat, count: int) -> tuple[Flat, np.ndarray]:
    """Rings relative to the floor of the first vertex of their polygon, and those corners."""
    corner = np.zeros((count, 2))
    lead = changes(rings.owner)
    corner[rings.owner[lead]] = np.floor(rings.xy[starts(rings.sizes)[lead]])
    return rings._replace(xy=rings.xy - corner[np.repeat(rings.owner, rings.sizes)]), corner


def moved(rings: Flat, corner: np.ndarray) -> Flat:
    return rings._replace(xy=rings.xy + corner[np.repeat(rings.owner, rings.sizes)])


def neighbours(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the point before and after each point of its ring."""
    first = starts(sizes)
    before, after = np.arange(sizes.sum()) - 1, np.arange(sizes.sum()) + 1
    before[first], after[first + sizes - 1] = first + sizes - 1, first
    return before, after


def segments(rings: Flat) -> tuple[np.ndarray, np.ndarray]:
    """Segments and the ring of each."""
    return np.hstack([rings.xy, rings.xy[neighbours(rings.sizes)[1]]]), np.repeat(np.arange(len(rings.sizes)), rings.sizes)


def areas(rings: Flat) -> np.ndarray:
    if not len(rings.sizes):
        return np.zeros(0)
    nxt = rings.xy[neighbours(rings.sizes)[1]]
    return np.add.reduceat(rings.xy[:, 0] * nxt[:, 1] - nxt[:, 0] * rings.xy[:, 1], starts(rings.sizes)) / 2.0


def cut(seg: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """``planar.cut_at_crossings``: pieces as whole multiples of SNAP and their polygons."""
    p, d = seg[:, :2], seg[:, 2:] - seg[:, :2]
    lo, hi = np.minimum(p, seg[:, 2:]) - SNAP, np.maximum(p, seg[:, 2:]) + SNAP
    length = np.hypot(d[:, 0], d[:, 1])
    every = np.arange(len(seg))
    rows, at = [every, every], [np.zeros(len(seg)), np.ones(len(seg))]
    for i, j in pairs(owner, bounds(owner, count)):
        later = j > i
        i, j = i[later], j[later]
        near = (lo[j, 0] <= hi[i, 0]) & (hi[j, 0] >= lo[i, 0]) & (lo[j, 1] <= hi[i, 1]) & (hi[j, 1] >= lo[i, 1]) & (length[i] > SNAP)
        i, j = i[near], j[near]
        w, di, dj = p[j] - p[i], d[i], d[j]
        cross = di[:, 0] * dj[:, 1] - di[:, 1] * dj[:, 0]
        off = di[:, 0] * w[:, 1] - di[:, 1] * w[:, 0]
        parallel = np.abs(cross) <= 1e-12 * length[i] * np.maximum(length[j], SNAP)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, s = (w[:, 0] * dj[:, 1] - w[:, 1] * dj[:, 0]) / cross, -off / cross
        et, es = SNAP / length[i], SNAP / np.maximum(length[j], SNAP)
        met = ~parallel & (t >= -et) & (t <= 1 + et) & (s >= -es) & (s <= 1 + es)
        rows += [i[met], j[met]]
        at += [t[met], s[met]]
        along = parallel & (np.abs(off) <= SNAP * length[i])
        for a, b in ((i[along], j[along]), (j[along], i[along])):
            for end in (seg[b, :2], seg[b, 2:]):
                rows.append(a)
                at.append(np.sum((end - p[a]) * d[a], axis=1) / np.maximum(length[a], SNAP) ** 2)
    row, t = np.concatenate(rows), np.concatenate(at)
    within = (t >= -1e-9) & (t <= 1 + 1e-9)
    row, t = row[within], t[within]
    order = np.lexsort((t, row))
    row, t = row[order], t[order]
    grid = np.round((p[row] + t[:, None] * d[row]) / SNAP).astype(np.int64)
    a, b = grid[:-1], grid[1:]
    live = (row[:-1] == row[1:]) & np.any(a != b, axis=1)
    a, b, of = a[live], b[live], owner[row[:-1][live]]
    swap = ((a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])))[:, None]
    piece = np.hstack([np.where(swap, b, a), np.where(swap, a, b)])
    order = np.lexsort((*piece.T[::-1], of))
    piece, of = piece[order], of[order]
    new = changes(of, *piece.T)
    return piece[new], of[new]


def inside(q: np.ndarray, of: np.ndarray, seg: np.ndarray, first: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Even-odd test against the polygon ``of`` each point; in any of its members, when it has several."""
    hit = np.zeros(len(q), dtype=bool)
    x1, y1, x2, y2 = seg.T
    for i, j in pairs(of, first):
        spans = (y1[j] <= q[i, 1]) != (y2[j] <= q[i, 1])
        i, j = i[spans], j[spans]
        left = x1[j] + (q[i, 1] - y1[j]) * (x2[j] - x1[j]) / (y2[j] - y1[j]) <= q[i, 0]
        i, j = i[left], j[left]
        lead = np.flatnonzero(changes(i, member[j]))
        odd = np.diff(np.append(lead, len(i))) % 2 == 1
        hit[i[lead[odd]]] = True
    return hit


def sides(piece: np.ndarray, of: np.ndarray, seg: np.ndarray, first: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``planar.sides`` of the pieces."""
    xy = piece * SNAP
    mid, d = (xy[:, :2] + xy[:, 2:]) / 2.0, xy[:, 2:] - xy[:, :2]
    size = np.hypot(d[:, 0], d[:, 1])[:, None]
    step = np.column_stack([-d[:, 1], d[:, 0]]) / size * np.minimum(size * 1e-3, 1e-4)
    return inside(mid + step, of, seg, first, member), inside(mid - step, of, seg, first, member)


def directed(piece: np.ndarray, of: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``planar.boundary``: pieces with the inside on their left only."""
    edge = np.vstack([piece[left & ~right], piece[right & ~left][:, [2, 3, 0, 1]]])
    return edge, np.concatenate([of[left & ~right], of[right & ~left]])


def vertices(of: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first and last vertex of each edge."""
    both, ends = np.concatenate([of, of]), np.vstack([edge[:, :2], edge[:, 2:]])
    order = np.lexsort((ends[:, 1], ends[:, 0], both))
    number = np.empty(len(both), dtype=np.int64)
    number[order] = np.cumsum(changes(both[order], *ends[order].T)) - 1
    return number[:len(of)], number[len(of):]


def trace(edge: np.ndarray, of: np.ndarray) -> Flat:
    """``planar.trace`` and ``planar.group_parts``: rings by polygon and part, outer rings first."""
    order = np.argsort(of, kind="stable")
    edge, of = edge[order], of[order]
    n = len(edge)
    if not n:
        return Flat(np.zeros((0, 2)), *[np.zeros(0, dtype=np.int64)] * 3)
    begin, end = vertices(of, edge)
    leaving = np.argsort(begin, kind="stable")
    heading = np.arctan2(edge[:, 3] - edge[:, 1], edge[:, 2] - edge[:, 0])
    follow = np.full(n, -1)
    for i, j in pairs(end, bounds(begin[leaving], max(begin.max(), end.max()) + 1)):
        j = leaving[j]
        turn = (heading[i] + np.pi - heading[j]) % (2 * np.pi)
        turn[turn < 1e-12] = 2 * np.pi
        best = np.lexsort((turn, i))
        best = best[changes(i[best])] if len(best) else best
        follow[i[best]] = j[best]
    # every edge follows one other where boundaries close; other polygons are traced one by one
    loose = np.zeros(of[-1] + 1, dtype=bool)
    loose[of[(follow < 0) | (np.bincount(follow[follow >= 0], minlength=n) != 1)]] = True
    follow[loose[of]] = np.flatnonzero(loose[of])
    low, ahead, to, width = np.arange(n), np.zeros(n, dtype=np.int64), follow, 1
    while True:
        nearer = low <= low[to]
        low, ahead = np.minimum(low, low[to]), np.where(nearer, ahead, ahead[to] + width)
        to, width = to[to], width * 2
        if nearer.all():
            break
    length = np.bincount(low, minlength=n)
    order = np.lexsort(((length[low] - ahead) % length[low], low))
    ring = np.flatnonzero(changes(low[order]))
    sizes = np.diff(np.append(ring, n))
    found = Flat(edge[order, :2] * SNAP, sizes, of[order[ring]], np.zeros(len(ring), dtype=np.int64))
    found = straightened(found.take(np.flatnonzero(sizes >= 3)))
    area = areas(found)
    holed = loose.copy()
    holed[found.owner[area < -SNAP]] = True
    plain = np.flatnonzero((area > SNAP) & ~holed[found.owner])
    plain = plain[np.lexsort((-area[plain], found.owner[plain]))]
    rings = found.take(plain)
    rings = rings._replace(part=np.arange(len(plain)) - np.maximum.accumulate(np.where(changes(rings.owner), np.arange(len(plain)), 0)))
    return one_by_one(rings, edge, of, np.flatnonzero(holed))


def straightened(rings: Flat) -> Flat:
    """``planar.drop_collinear`` of all rings; what is left of three vertices at least."""
    before, after = neighbours(rings.sizes)
    u, v = rings.xy - rings.xy[before], rings.xy[after] - rings.xy
    scale = np.hypot(*u.T) * np.hypot(*v.T)
    keep = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) > 1e-9 * np.maximum(scale, 1e-12)
    number = np.repeat(np.arange(len(rings.sizes)), rings.sizes)[keep]
    left = rings._replace(xy=rings.xy[keep], sizes=np.bincount(number, minlength=len(rings.sizes)))
    return left.take(np.flatnonzero(left.sizes >= 3))


def one_by_one(rings: Flat, edge: np.ndarray, of: np.ndarray, polygons: np.ndarray) -> Flat:
    """``rings`` with those of ``polygons`` from their edges by ``planar``."""
    if not len(polygons):
        return rings
    xy, sizes, owner, part = [rings.xy], list(rings.sizes), list(rings.owner), list(rings.part)
    for k in polygons:
        at = slice(*np.searchsorted(of, [k, k + 1]))
        for number, group in enumerate(planar.group_parts(planar.trace(edge[at] * SNAP))):
            for ring in group:
                xy.append(ring)
                sizes.append(len(ring))
                owner.append(k)
                part.append(number)
    both = Flat(np.vstack(xy), *[np.array(c, dtype=np.int64) for c in (sizes, owner, part)])
    return both.take(np.lexsort((both.part, both.owner)))


def merged(rings: Flat, member: np.ndarray, count: int) -> Flat:
    """Repaired polygons, or unions of the members of each; ``member`` of every ring, ascending in a polygon."""
    seg, ring = segments(rings)
    owner = rings.owner[ring]
    piece, of = cut(seg, owner, count)
    left, right = sides(piece, of, seg, bounds(owner, count), member[ring])
    return trace(*directed(piece, of, left, right))


def split(rings: Flat, line: np.ndarray, line_of: np.ndarray, count: int) -> tuple[Flat, np.ndarray]:
    """``planar.split_by_line`` of every polygon by its line, given as points in order; and whether they meet."""
    seg, ring = segments(rings)
    owner, first = rings.owner[ring], bounds(rings.owner[ring], count)
    member = np.zeros(len(seg), dtype=np.int64)
    same = line_of[:-1] == line_of[1:]
    every = np.vstack([seg, np.hstack([line[:-1], line[1:]])[same]])
    every_of = np.concatenate([owner, line_of[:-1][same]])
    order = np.argsort(every_of, kind="stable")
    every, every_of = every[order], every_of[order]
    piece, of = cut(every, every_of, count)
    meets = np.bincount(of, minlength=count) > np.bincount(every_of, minlength=count)
    meets[line_of[inside(line, line_of, seg, first, member)]] = True
    left, right = sides(piece, of, seg, first, member)
    edge, edge_of = directed(piece, of, left, right)
    cutter, cutter_of = piece[left & right], of[left & right]
    while len(cutter):  # drop line pieces with a free end
        begin, end = vertices(np.concatenate([cutter_of, edge_of]), np.vstack([cutter, edge]))
        k = len(cutter)
        held = np.bincount(np.concatenate([begin[:k], end[:k]]), minlength=max(begin.max(), end.max()) + 1) > 1
        held[begin[k:]] = True
        keep = held[begin[:k]] & held[end[:k]]
        if keep.all():
            break
        cutter, cutter_of = cutter[keep], cutter_of[keep]
    return trace(np.vstack([edge, cutter, cutter[:, [2, 3, 0, 1]]]), np.concatenate([edge_of, cutter_of, cutter_of])), meets


def simplify(rings: Flat, tolerance: np.ndarray) -> Flat:
    """``planar.simplify_ring`` of every ring; all stretches between kept vertices are halved in one step."""
    first, last = starts(rings.sizes), np.cumsum(rings.sizes)
    tolerance = tolerance[rings.owner]
    at = np.repeat(first, rings.sizes)
    long = (rings.sizes > 4) & (tolerance > 0)
    keep = np.repeat(~long, rings.sizes)

    def farthest(size: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of the largest gap of each run, and the gap."""
        number = np.repeat(np.arange(len(size)), size)
        best = np.lexsort((-gap, number))[starts(size)]
        return best - starts(size), gap[best]

    if not long.any():
        return rings
    far = first + farthest(rings.sizes, np.hypot(*(rings.xy - rings.xy[at]).T))[0]
    keep[first] = True
    keep[far[long]] = True
    # stretches from i to j, j one past the last vertex for the first one again
    i, j = np.concatenate([first[long], far[long]]), np.concatenate([far[long], last[long]])
    home, allowed = np.tile(first[long], 2), np.tile(tolerance[long], 2)
    ends = np.tile(last[long], 2)
    while len(i):
        wide = j - i >= 2
        i, j, home, ends, allowed = (c[wide] for c in (i, j, home, ends, allowed))
        if not len(i):
            break
        size = j - i - 1
        inner = runs(i + 1, size)
        a = rings.xy[i]
        d = rings.xy[np.where(j == ends, home, j)] - a
        reach = np.hypot(*d.T)
        q, dd, r = rings.xy[inner] - np.repeat(a, size, axis=0), np.repeat(d, size, axis=0), np.repeat(reach, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(r > 0, np.abs(dd[:, 0] * q[:, 1] - dd[:, 1] * q[:, 0]) / r, np.hypot(*q.T))
        place, most = farthest(size, gap)
        over = most > allowed
        middle = (i + 1 + place)[over]
        keep[middle] = True
        i, j = np.concatenate([i[over], middle]), np.concatenate([middle, j[over]])
        home, ends, allowed = (np.tile(c[over], 2) for c in (home, ends, allowed))
    number = np.repeat(np.arange(len(rings.sizes)), rings.sizes)
    few = np.bincount(number[keep], minlength=len(rings.sizes)) < 3
    keep |= few[number]
    return rings._replace(xy=rings.xy[keep], sizes=np.bincount(number[keep], minlength=len(rings.sizes)))
