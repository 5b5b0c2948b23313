"""Pairs where points lie densely: what the sweep's blocks do once a bin is many spacings of points wide. All results are those of single pairs.

Pivots and points come as leaves of trees by medians. Two leaves with centers D apart have r^2 = f(p) + g(q) - 2 a.b for a pivot p = center + a and
a point q = center + b, f(p) = D^2 + 2 D.a + a^2, g(q) = b^2 - 2 D.b, and a.b is no more than the product of both radii. So (`Leaves`, `under`) a leaf that
an edge of a bin crosses is sorted into strips by g: strips below an edge count whole for a pivot, and only points in strips that are as near to it as
the bound are compared one by one, as every other code here compares them. With leaves of a fixed number of points the work for N points
in a fixed radius grows as N^(4/3), not as N^2.

Sums with angles (`angular`) need every pair. Points around a leaf of pivots are sorted by their distance from its center and taken some at a time as
matrices, so only few edges may part these from some pivots, and only with these edges they are compared.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: Points that a block has at least for this; points of a leaf at most; strips of a leaf.
DENSE, LEAF, STRIPS = 4096, 48, 64
#: Pivots of a leaf at most where angles are wanted, the first with few enough edges near a point; sums of pairs at once there, each pair having one for each multipole's cosine and sine; multipoles up to which these go by powers of the cosine.
PIVOTS, AT_ONCE, POWERS = (64, 32, 16), 1 << 18, 8
#: How much of a disk of the radius leaves that edges cross may cover, edge by edge, for counts, and the part of a pair's looks that must not be at an edge, for angles.
CROSSED, CERTAIN = 6.0, 0.1


class Leaves:
    """Points (id, x, y, z, value, weight) in the order of leaves of a tree by medians, with centers and radii of leaves."""

    def __init__(self, table: np.ndarray, most: int, starts: np.ndarray | None = None):
        """starts: rows from which on a leaf has no point of the rows before."""
        xyz = table[:, 1:4]
        cuts = [0, *([] if starts is None else starts[1:].tolist()), len(table)]
        order, ends, todo = np.arange(len(table)), [], list(zip(cuts[:-1], cuts[1:], strict=True))[::-1]
        while todo:
            a, b = todo.pop()
            if b - a <= most:
                ends.append(b)
                continue
            part = xyz[order[a:b]]
            axis, half = int(np.argmax(part.max(0) - part.min(0))), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], half)]
            todo += [(a + half, b), (a, a + half)]
        self.order, self.ends = order, np.array(ends)
        self.starts = np.append(0, self.ends[:-1])
        self.size = self.ends - self.starts
        self.xyz = np.ascontiguousarray(xyz[order].T)
        self.weight, self.value = table[order, 5], table[order, 4]
        self.field = self.value * self.weight
        self.center = np.add.reduceat(self.xyz, self.starts, 1) / self.size
        self.off = self.xyz - np.repeat(self.center, self.size, 1)
        self.square = (self.off * self.off).sum(0)
        # A little wider, so that rounding puts no point beyond.
        self.radius = np.sqrt(np.maximum.reduceat(self.square, self.starts)) * (1 + 1e-12)
        self.many, self.total = (np.add.reduceat(v, self.starts) for v in (self.weight, self.field))
        self.slack = 1e-13 * (np.abs(self.xyz).max() + 1e-290)

    def __iter__(self) -> Iterator[int]:
        return iter(range(len(self.ends)))

    def at(self, leaf: int) -> slice:
        return slice(self.starts[leaf], self.ends[leaf])


def _ranges(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _edges(squares: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From which edge on distances between low and high may lie below an edge, and from which on they do."""
    edges = np.sqrt(squares)
    return np.searchsorted(edges, low, "left"), np.searchsorted(edges, high, "right")


def crossed(pivots: Leaves, points: Leaves, squares: np.ndarray) -> float:
    """The part of a disk of the greatest edge that is covered by leaves which edges cross, once for each edge."""
    return 4 * float(np.sqrt(squares).sum()) * float(np.median(pivots.radius) + np.median(points.radius)) / float(squares[-1])


def certain(pivots: Leaves, squares: np.ndarray) -> float:
    """The part of looks at a pair that aren't at an edge: one to as many as may part the point from some pivots of a leaf."""
    return 1 / (1 + 4 * float(np.sqrt(squares).sum()) * float(np.median(pivots.radius)) / float(squares[-1]))


def under(pivots: Leaves, leaf: int, points: Leaves, squares: np.ndarray, tally: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By pivot of a leaf and edge: numbers and sums of fields of the points whose squared distance is below the edge's (not above, at the first). tally: counters of points and of cells. among: the leaves of points to look at, all by default."""
    mine, n = pivots.at(leaf), len(squares)
    a, ra = pivots.off[:, mine].T, pivots.radius[leaf]
    p, many = pivots.xyz[:, mine], pivots.size[leaf]
    near = np.arange(len(points.ends)) if among is None else among
    d = pivots.center[:, leaf, None] - points.center[:, near]
    d2 = (d * d).sum(0)
    far, wide = np.sqrt(d2), points.radius[near] + (ra + max(pivots.slack, points.slack) * 8)
    some = np.flatnonzero(far - wide <= np.sqrt(squares[-1]))
    near, d, d2, far, wide = near[some], d[:, some], d2[some], far[some], wide[some]
    first, whole = _edges(squares, far - wide, far + wide)
    # Leaves below an edge as a whole.
    count, sums = (np.repeat(np.cumsum(np.bincount(whole, v[near], n + 1)[:n])[None], many, 0) for v in (points.many, points.total))
    tally[1, :2] += many * len(near)
    mixed = first < whole
    near, d, d2, far, first, whole = near[mixed], d[:, mixed], d2[mixed], far[mixed], first[mixed], whole[mixed]
    if not len(near):
        return count, sums
    size = points.size[near]
    at = _ranges(points.starts[near], size)
    cell = np.repeat(np.arange(len(near)), size)
    g = points.square[at]
    for k in range(3):
        g -= 2 * d[k][cell] * points.off[k, at]
    f = d2 + 2 * (a @ d) + (a * a).sum(1)[:, None]
    begin = np.cumsum(size) - size
    least, most = np.minimum.reduceat(g, begin), np.maximum.reduceat(g, begin)
    step = STRIPS / ((most - least) * (1 + 1e-9) + 1e-300 + 1e-15 * d2)
    strip = np.minimum(((g - least[cell]) * step[cell]).astype(np.int64), STRIPS - 1)
    order = np.argsort(strip.astype(np.uint8), kind="stable")
    order = order[np.argsort(cell[order].astype(np.uint16) if len(near) < 1 << 16 else cell[order], kind="stable")]
    begins = np.append(0, np.cumsum(np.bincount(cell * STRIPS + strip, minlength=len(near) * STRIPS)))
    at = at[order]
    weights, fields = (np.append(0.0, np.cumsum(v[at])) for v in (points.weight, points.field))
    edge, leaf_ = np.nonzero((first <= np.arange(n)[:, None]) & (np.arange(n)[:, None] < whole))
    # Twice the product of both radii, and what rounding may add.
    bound = 2 * ra * points.radius[near] * (1 + 1e-9) + 1e-13 * (d2 + squares[-1]) + 8 * max(pivots.slack, points.slack) * far
    left = squares[edge] - f[:, leaf_] - least[leaf_]
    low = np.clip(np.floor((left - bound[leaf_]) * step[leaf_]), 0, STRIPS).astype(np.int64) + leaf_ * STRIPS
    high = np.clip(np.floor((left + bound[leaf_]) * step[leaf_]) + 1, 0, STRIPS).astype(np.int64) + leaf_ * STRIPS
    low, high, base = begins[low], begins[high], begins[leaf_ * STRIPS]
    starts = np.flatnonzero(np.append(True, edge[1:] != edge[:-1]))
    for out, v in ((count, weights), (sums, fields)):
        out[:, edge[starts]] += np.add.reduceat(v[low] - v[base], starts, 1)
    # Those near an edge, one by one.
    size = (high - low).ravel()
    q = at[_ranges(low.ravel(), size)]
    i = np.repeat(np.repeat(np.arange(many), len(edge)), size)
    e = np.repeat(np.tile(edge, many), size)
    r2 = np.zeros(len(q))
    for k in range(3):
        off = p[k, i] - points.xyz[k, q]
        r2 += off * off
    limit = squares[e]
    inside = np.flatnonzero((r2 < limit) | ((e == 0) & (r2 == limit)))
    tally[0, :2] += len(q), len(inside)
    key = i[inside] * n + e[inside]
    count += np.bincount(key, points.weight[q[inside]], many * n).reshape(many, n)
    sums += np.bincount(key, points.field[q[inside]], many * n).reshape(many, n)
    return count, sums


def around(pivots: Leaves, leaf: int, points: Leaves, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Points that may be within the edges of some pivot of a leaf, by their distance from its center; these distances, and by how much those from a pivot may differ."""
    center, edges, least = pivots.center[:, leaf, None], np.sqrt(squares), 8 * max(pivots.slack, points.slack)
    wide = float(pivots.radius[leaf]) + least

    def far(xyz: np.ndarray) -> np.ndarray:
        off = xyz - center
        return np.sqrt((off * off).sum(0))

    d, more = far(points.center), points.radius + wide
    near = np.flatnonzero((d - more <= edges[-1]) & (d + more >= edges[0]))
    at = _ranges(points.starts[near], points.size[near])
    d = far(points.xyz[:, at])
    keep = np.flatnonzero((d - wide <= edges[-1]) & (d + wide >= edges[0]))
    keep = keep[np.argsort(d[keep])]
    return at[keep], d[keep], wide


def angular(pivots: Leaves, leaf: int, points: Leaves, squares: np.ndarray, axes: tuple[np.ndarray, np.ndarray] | None, most: int, columns: np.ndarray, wanted: slice) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of columns over the points by bin, multipole, column and pivot of a leaf: times cos(m phi) and times sin(m phi); and how many pairs were looked at.

    axes: of each pivot the direction from which angles count and one across it; None: the plane's. wanted: columns that are wanted beyond m = 0.
    """
    mine, n, kinds, powers = pivots.at(leaf), len(squares), range(len(columns))[wanted], most <= POWERS
    p, center = pivots.xyz[:, mine], pivots.center[:, leaf, None]
    a = p - center
    many = p.shape[1]
    at, far, wide = around(pivots, leaf, points, squares)
    # By edge and column: sums over points below the edge, of those that it may part; and over those below it for all pivots, but not surely below the one before.
    rows = 1 + 2 * most
    below, whole = np.zeros((2, n + 1, len(columns), rows * many))
    left = np.concatenate([-2 * a.T, (a * a).sum(0)[:, None], np.ones((many, 1))], 1)
    if axes is not None:
        arms = [np.concatenate([-v.T, (v * a).sum(0)[:, None]], 1) for v in axes]
    every, columns = points.xyz[:, at], columns[:, at]
    b = every - center
    right = np.concatenate([b, np.ones((1, len(at))), (b * b).sum(0)[None]])
    step = max(64, AT_ONCE // (max(8, rows) * many))
    buffers, turns = _buffers(rows, many * step)
    slack = 8 * max(pivots.slack, points.slack)
    ends = np.append(np.arange(step, len(at), step), len(at)) if len(at) else []
    bounds = _edges(squares, far[::step] - wide, far[[e - 1 for e in ends]] + wide)
    for begin, end, first, last in zip(range(0, len(at), step), ends, *bounds, strict=True):
        size, q, there = end - begin, every[:, begin:end], right[:, begin:end]
        r2, off = (v[: many * size].reshape(many, size) for v in buffers)
        both, parted = (v[: rows * many * size].reshape(rows, many, size) for v in turns)
        cosines, sines = both[1 : most + 1], both[most + 1 :]
        # Whether a point may be so near a pivot that matrices are too rough, and what rounding may do to a squared distance elsewhere.
        close, least = far[begin] < 2 * wide, 1e-13 * (far[end - 1] + wide) ** 2 + slack * far[end - 1]
        if close:
            r2[:] = 0.0
            for k in range(3):
                np.subtract(p[k][:, None], q[k], out=off)
                off *= off
                r2 += off
        else:
            np.matmul(left, there, out=r2)
        both[0] = 1.0
        if most:
            c, s = cosines[0], sines[0]
            r = np.sqrt(np.where(r2 > 0, r2, 1.0) if close else r2, out=off)
            if axes is None:
                np.subtract(there[0], a[0][:, None], out=c)
                np.subtract(there[1], a[1][:, None], out=s)
                c /= r
                s /= r
            else:
                np.matmul(arms[0], there[:4], out=c)
                c /= r
                if close:
                    np.clip(c, -1.0, 1.0, out=c)
                np.multiply(c, c, out=s)
                np.subtract(1.0, s, out=s)
                np.maximum(s, 0.0, out=s)
                np.sqrt(s, out=s)
                np.copysign(s, np.matmul(arms[1], there[:4], out=off), out=s)
            if powers and most > 1:
                # Powers of the cosine, and the sine times these.
                for m in range(1, most):
                    np.multiply(cosines[m - 1], c, out=cosines[m])
                np.multiply(cosines[:-1], s, out=sines[1:])
            elif most > 1:
                # cos and sin of m phi from those of (m - 1) phi and (m - 2) phi.
                twice = np.multiply(c, 2.0, out=off)
                for v, before in ((cosines, 1.0), (sines, 0.0)):
                    for m in range(1, most):
                        np.multiply(v[m - 1], twice, out=v[m])
                        v[m] -= v[m - 2] if m > 1 else before
        for k in range(first, min(last + 1, n)):
            sums, some = whole[k], both
            if k < last:
                # The first edge is in no bin.
                sums, some, square = below[k], parted, squares[k] if k else np.nextafter(squares[0], 1.0)
                np.subtract(r2, square, out=off)
                np.less(off, 0.0, out=parted[0], casting="unsafe")
                if not close and np.abs(off, out=off).min() <= least:
                    # By the difference of both points, as everywhere else.
                    i, j = np.nonzero(off <= least)
                    d = p[:, i] - q[:, j]
                    parted[0, i, j] = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < square
                if most:
                    np.multiply(both[1:], parted[0], out=parted[1:])
            some = some.reshape(-1, size)
            for k_, v in enumerate(columns[:, begin:end]):
                if k_ in kinds:
                    sums[k_] += some @ v
                else:
                    sums[k_, :many] += some[:many] @ v
    found = np.diff(below + np.cumsum(whole, 0), axis=0)[: n - 1].reshape(n - 1, len(columns), rows, many)
    found = np.stack([found[:, :, : most + 1], np.concatenate([np.zeros_like(found[:, :, :1]), found[:, :, most + 1 :]], 2)]).swapaxes(2, 3)
    if powers and most > 1:
        found = np.stack([np.einsum("mk,bkcp->bmcp", by, v) for by, v in zip(_chebyshev(most), found, strict=True)])
    # Differences of sums, which rounding may leave at other than 0 where a bin has no point.
    found = found * (found[0, None, :, :1, :1] != 0)
    return found[0], found[1], len(at) * many


@functools.lru_cache(4)
def _buffers(rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept from call to call, as memory that is new each time takes long to come by."""
    return np.empty((2, size)), np.empty((2, rows * size))


@functools.cache
def _chebyshev(most: int) -> tuple[np.ndarray, np.ndarray]:
    """cos(m phi) by powers of cos(phi); sin(m phi) by sin(phi) times them, from the second column on."""
    first, second = np.zeros((2, most + 1, most + 1))
    first[0, 0] = first[1, 1] = second[1, 1] = 1.0
    for m in range(2, most + 1):
        first[m, 1:], second[m, 1:] = 2 * first[m - 1, :-1], 2 * second[m - 1, :-1]
        first[m] -= first[m - 2]
        second[m] -= second[m - 2]
    return first, second
