"""Pairs of shapes found and overlaid block by block, in numpy.

A unit holds the left and the right shapes of one grid cell (or of one part of
a crowded cell). Its pairs whose boxes overlap are found by comparing boxes as
matrices, a bounded number at a time; each pair's area is summed over its
non-vertical edges, read from tables with one row per edge slot, so no pair
carries its edge lists about. Shapes of more than ``SLOTS`` such edges go
through :func:`canopy.functions.overlay_arrow.edge_sums`, as do all edges of
the pairs that share no area, for the contact of their boundaries.

The sums are those of :mod:`canopy.functions.overlay_arrow`, term by term.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from .overlay import AREA_EPS
from .overlay_arrow import _edges, _pair_chunks, edge_dist2, edge_sums
from .stairs import Stairs, pairs as stair_pairs, partners

#: Non-vertical edges up to which a shape is read from slot tables.
SLOTS = 8
#: Boxes compared at once, pairs returned at once, and pairs whose areas are summed at once (these stay in the processor's cache).
TESTS_AT_ONCE, PAIRS_OUT, AREAS_AT_ONCE = 1 << 22, 1 << 20, 1 << 14
#: Edges copied at once where all edges of a pair are needed.
EDGES_AT_ONCE = 1 << 19
#: Units with fewer box tests than this are put together.
SMALL_UNIT = 1 << 12
#: Units with at least this many box tests compare their stairs as matrices of boxes.
BY_BOXES = 1 << 14
#: Partners are summed without their pairs where a unit has so many pairs of stairs, and so many for each row that sorting reads.
CROWDED, WORTH = 1 << 18, 64


class Shapes:
    """The shapes of one side of a batch: boxes, areas, edges by shape, and slot tables of their non-vertical edges."""

    def __init__(self, rows: pa.StructArray | pa.RecordBatch | pa.Table):
        get = lambda c: rows.column(c).combine_chunks() if isinstance(rows, pa.Table) else rows.column(c)
        num = lambda c: np.asarray(get(c).to_numpy(zero_copy_only=False), np.float64)
        self.x0, self.y0, self.x1, self.y1, self.area = (num(c) for c in ("x0", "y0", "x1", "y1", "area"))
        self.own = np.asarray(get("own").to_numpy(zero_copy_only=False), bool)
        edges = get("edges")
        edges = edges.combine_chunks() if isinstance(edges, pa.ChunkedArray) else edges
        start, self.n, cols = _edges(edges)
        total = int(self.n.sum())
        self.first = np.cumsum(self.n) - self.n
        row = np.repeat(np.arange(len(self.n)), self.n)
        at = start[row] + np.arange(total) - self.first[row]
        self.cols = [c[at] for c in cols]
        ax, ay, bx, by = self.cols
        up = np.flatnonzero(ax != bx)
        row = row[up]
        self.count = np.bincount(row, minlength=len(self.n))
        slot = np.arange(len(up)) - (np.cumsum(self.count) - self.count)[row]
        few = (self.count <= SLOTS)[row]
        up, row, slot = up[few], row[few], slot[few]
        slots = int(self.count[self.count <= SLOTS].max(initial=0))
        shape = (slots, len(self.n))
        # an empty slot spans no width
        self.lo, self.hi = np.full(shape, np.inf), np.full(shape, -np.inf)
        self.sign, self.y, self.x, self.slope = (np.zeros(shape) for _ in range(4))
        a, b = ax[up], bx[up]
        self.lo[slot, row], self.hi[slot, row] = np.minimum(a, b), np.maximum(a, b)
        self.sign[slot, row], self.y[slot, row], self.x[slot, row] = np.sign(a - b), ay[up], a
        self.slope[slot, row] = (by[up] - ay[up]) / (b - a)
        self.flat = np.ones(len(self.n), bool)
        self.flat[row[self.slope[slot, row] != 0]] = False

    @cached_property
    def stairs(self) -> Stairs:
        return Stairs(self)

    def edges_of(self, rows: np.ndarray):
        """(count per row, coordinates) of all edges of the given rows."""
        n = self.n[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return n, [c[at] for c in self.cols]


def _slot_areas(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray, na: int, nb: int, flat: bool) -> np.ndarray:
    """Common area of the pairs (i, j), of which no shape has more than ``na`` (``nb``) non-vertical edges."""
    base = np.minimum(a.y0[i], b.y0[j])
    out = np.zeros(len(i))
    right = []
    for m in range(nb):
        right.append((b.lo[m].take(j), b.hi[m].take(j), b.sign[m].take(j), b.y[m].take(j) - base,
                      None if flat else b.x[m].take(j), None if flat else b.slope[m].take(j)))
    for k in range(na):
        alo, ahi, ya = a.lo[k].take(i), a.hi[k].take(i), a.y[k].take(i) - base
        part = np.zeros(len(i))
        if not flat:
            ax, ka = a.x[k].take(i), a.slope[k].take(i)
        for blo, bhi, sb, yb, bx, kb in right:
            lo, hi = np.maximum(alo, blo), np.minimum(ahi, bhi)
            if flat:
                w = hi
                w -= lo
                np.maximum(w, 0.0, out=w)
                w *= np.minimum(ya, yb)
            else:
                w = hi - lo
                some = w > 0
                w, lo, hi = np.where(some, w, 0.0), np.where(some, lo, 0.0), np.where(some, hi, 0.0)
                yal, yah, ybl, ybh = ya + ka * (lo - ax), ya + ka * (hi - ax), yb + kb * (lo - bx), yb + kb * (hi - bx)
                dl, dh = yal - ybl, yah - ybh
                same = dl * dh >= 0
                absd = np.where(same, np.abs(dl + dh) / 2.0, (dl * dl + dh * dh) / np.where(same, 1.0, 2.0 * (np.abs(dl) + np.abs(dh))))
                w = w * ((yal + yah + ybl + ybh) / 4.0 - absd / 2.0)
            w *= sb
            part += w
        part *= a.sign[k].take(i)
        out += part
    return out


def areas(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common area of each pair (i, j), at least 0."""
    out = np.zeros(len(i))
    # pairs by their numbers of edges, so that empty slots are not summed; -1: not in the tables
    kind = (lambda s: np.where(s.count <= SLOTS, np.where(s.flat, s.count, s.count + SLOTS + 1), 2 * SLOTS + 2))
    ka, kb = kind(a).astype(np.int16), kind(b).astype(np.int16)
    code = ka[i] * np.int16(32) + kb[j]
    for c in np.flatnonzero(np.bincount(code, minlength=1)):
        at = np.flatnonzero(code == c)
        p, q = divmod(int(c), 32)
        if max(p, q) == 2 * SLOTS + 2:
            for some in _portions(a, b, i, j, at):
                out[some] = _all_edges(a, b, i[some], j[some])[0]
            continue
        flat = p <= SLOTS and q <= SLOTS
        na, nb = p % (SLOTS + 1), q % (SLOTS + 1)
        for s in range(0, len(at), AREAS_AT_ONCE):
            some = at[s:s + AREAS_AT_ONCE]
            out[some] = _slot_areas(a, b, i[some], j[some], na, nb, flat)
    return np.maximum(out, 0.0)


def _portions(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The pairs ``at`` in portions of about ``EDGES_AT_ONCE`` edges."""
    if len(at):
        portion = np.cumsum(a.n[i[at]] + b.n[j[at]]) // EDGES_AT_ONCE
        yield from np.split(at, np.flatnonzero(np.diff(portion)) + 1)


def _all_edges(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray):
    na, ca = a.edges_of(i)
    nb, cb = b.edges_of(j)
    return edge_sums(na, ca, nb, cb, np.minimum(a.y0[i], b.y0[j]))


def _touching(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the boundaries meet, for the pairs at the positions ``at``."""
    out = [_all_edges(a, b, i[some], j[some])[1] for some in _portions(a, b, i, j, at)]
    return np.concatenate(out) if out else np.zeros(0, bool)


def hits(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray, predicate: str, least: float | None = None):
    """The pairs that fulfil a predicate of :mod:`canopy.functions.overlay` and share more than ``least``: (i, j, area, contact).

    Boundaries are only looked at where the area does not settle it, so ``contact`` is false elsewhere.
    """
    area = areas(a, b, i, j)
    contact = np.zeros(len(i), bool)
    if least is not None:
        # as in SQL, NaN is above every number
        above = ~(area <= least)
        i, j, area, contact = i[above], j[above], area[above], contact[above]
    la, ra = a.area[i], b.area[j]
    positive = ~(area <= AREA_EPS * np.fmin(np.abs(la), np.abs(ra)))
    if predicate in ("intersects", "meets"):
        rest = np.flatnonzero(~positive)
        contact[rest] = _touching(a, b, i, j, rest)
        keep = (positive if predicate == "intersects" else area != 0) | contact
    else:
        whole = la if predicate == "within" else ra
        keep = positive & (whole > 0) & (area >= whole * (1.0 - AREA_EPS))
    if keep.all():
        return i, j, area, contact
    return i[keep], j[keep], area[keep], contact[keep]


def near(a: Shapes, b: Shapes, i: np.ndarray, j: np.ndarray, d: float):
    """(i, j, distance) of the pairs at most ``d`` apart; the boxes of ``a`` are grown by ``d``."""
    area = areas(a, b, i, j)
    far2 = np.where(area <= AREA_EPS * np.fmin(np.abs(a.area[i]), np.abs(b.area[j])), np.inf, 0.0)
    rest = np.flatnonzero(far2)
    for some in _portions(a, b, i, j, rest):
        na, ca = a.edges_of(i[some])
        nb, cb = b.edges_of(j[some])
        far2[some] = edge_dist2(na, ca, nb, cb)
    keep = far2 <= d * d
    return i[keep], j[keep], np.sqrt(far2[keep])


def _boxes_meet(a: Shapes, b: Shapes, left: np.ndarray, right: np.ndarray, x: float, y: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the given rows of one unit whose boxes overlap, kept in the cell (lower corner x, y) of the overlap's lower left corner."""
    left = left[np.argsort(a.x0[left], kind="stable")]
    right = right[np.argsort(b.x0[right], kind="stable")]
    ends = np.maximum.accumulate(b.x1[right])
    starts = b.x0[right]
    step = 256
    for s in range(0, len(left), step):
        l = left[s:s + step]
        lx0, lx1 = a.x0[l], a.x1[l]
        first = int(np.searchsorted(ends, lx0[0], "left"))
        last = int(np.searchsorted(starts, lx1.max(), "right"))
        wide = max(1, TESTS_AT_ONCE // len(l))
        for f in range(first, last, wide):
            r = right[f:min(f + wide, last)]
            meet = lx0[:, None] <= b.x1[r][None, :]
            meet &= b.x0[r][None, :] <= lx1[:, None]
            meet &= a.y0[l][:, None] <= b.y1[r][None, :]
            meet &= b.y0[r][None, :] <= a.y1[l][:, None]
            meet &= (lx0 >= x)[:, None] | (b.x0[r] >= x)[None, :]
            meet &= (a.y0[l] >= y)[:, None] | (b.y0[r] >= y)[None, :]
            per = np.count_nonzero(meet, axis=1)
            at = np.flatnonzero(meet)
            k = np.repeat(np.arange(len(l)), per)
            yield l[k], r[at - k * len(r)]


def unit_pairs(a: Shapes, b: Shapes, left: np.ndarray, right: np.ndarray, x: float, y: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one unit: a pair belongs to the cell's level if one of its shapes does."""
    own = left[a.own[left]]
    if len(own) and len(right):
        yield from _boxes_meet(a, b, own, right, x, y)
    other, mine = left[~a.own[left]], right[b.own[right]]
    if len(other) and len(mine):
        yield from _boxes_meet(a, b, other, mine, x, y)


def small_units_pairs(a: Shapes, b: Shapes, l0: np.ndarray, nl: np.ndarray, r0: np.ndarray, nr: np.ndarray,
                      x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of many small units at once: unit u holds rows l0[u] .. l0[u] + nl[u] of a, and likewise of b."""
    for u, i, j in _pair_chunks(nl, nr, 1 << 20):
        i, j = i - (np.cumsum(nl) - nl)[u] + l0[u], j - (np.cumsum(nr) - nr)[u] + r0[u]
        keep = (a.x0[i] <= b.x1[j]) & (b.x0[j] <= a.x1[i]) & (a.y0[i] <= b.y1[j]) & (b.y0[j] <= a.y1[i]) & (a.own[i] | b.own[j]) \
            & ((a.x0[i] >= x[u]) | (b.x0[j] >= x[u])) & ((a.y0[i] >= y[u]) | (b.y0[j] >= y[u]))
        yield i[keep], j[keep]


def crowded(a: Shapes, b: Shapes, l0, nl, r0, nr, left_code: np.ndarray, right_code: np.ndarray, least: int = CROWDED) -> np.ndarray:
    """The units whose pairs of stairs need not be gone through to sum them by the codes of either side: 0 no, 1 from the left, 2 from the right."""
    out = np.zeros(len(l0), np.int8)
    for u in np.flatnonzero(nl * nr >= least):
        l, r = a.stairs.ok[l0[u]:l0[u] + nl[u]], b.stairs.ok[r0[u]:r0[u] + nr[u]]
        n, m = int(l.sum()), int(r.sum())
        gl, gr = (len(np.unique(c)) for c in (left_code[l0[u]:l0[u] + nl[u]][l], right_code[r0[u]:r0[u] + nr[u]][r]))
        cost = [n + gl * m, m + gr * n]
        if n * m >= least and (min(cost) * WORTH <= n * m or least < CROWDED):
            out[u] = 1 + (cost[1] < cost[0])
    return out


def crowd_totals(a: Shapes, b: Shapes, left: np.ndarray, right: np.ndarray, left_code: np.ndarray, right_code: np.ndarray,
                 x: float, y: float, way: int, with_area: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(left code, right code, number of pairs, area (0 without ``with_area``)) of a unit's pairs of stairs; codes come repeatedly."""
    left, right = left[a.stairs.ok[left]], right[b.stairs.ok[right]]
    # a pair belongs to the cell's level if one of its shapes does
    for l, r in ((left[a.own[left]], right), (left[~a.own[left]], right[b.own[right]])):
        if not len(l) or not len(r):
            continue
        of, to, c, d = (a, b, left_code[l], right_code[r]) if way == 1 else (b, a, right_code[r], left_code[l])
        value, group = np.unique(c, return_inverse=True)
        n, area = partners(of, to, *((l, r) if way == 1 else (r, l)), group, len(value), x, y, with_area)
        g, t = np.nonzero(n)
        yield (value[g], d[t], n[g, t], area[g, t]) if way == 1 else (d[t], value[g], n[g, t], area[g, t])


def found(a: Shapes, b: Shapes, units: tuple, predicate: str, least: float | None = None, distance: float | None = None,
          crowd: np.ndarray | None = None, with_area: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, area, contact) of the pairs of a batch of units that fulfil the predicate and share more than ``least``, or
    (i, j, distance, contact) of those at most ``distance`` apart, about ``PAIRS_OUT`` at a time; of units in ``crowd`` not the pairs of stairs.
    Without ``with_area`` the areas need not be right."""
    l0, nl, r0, nr, x, y = units
    crowd = np.zeros(len(l0), bool) if crowd is None else crowd != 0
    small = (nl * nr < SMALL_UNIT) & ~crowd
    # stairs have a shorter way
    boxes = predicate == "intersects"
    many = crowd | (nl * nr >= BY_BOXES) & boxes
    stair_a, stair_b = ((s.stairs.any if distance is not None else s.stairs.ok) if boxes else np.zeros(len(s.n), bool) for s in (a, b))

    def tried():
        if small.any():
            yield from small_units_pairs(a, b, l0[small], nl[small], r0[small], nr[small], x[small], y[small])
        for u in np.flatnonzero(~small):
            left, right = np.arange(l0[u], l0[u] + nl[u]), np.arange(r0[u], r0[u] + nr[u])
            if many[u]:
                yield from unit_pairs(a, b, left[~stair_a[left]], right, x[u], y[u])
                left, right = left[stair_a[left]], right[~stair_b[right]]
            yield from unit_pairs(a, b, left, right, x[u], y[u])

    def by_boxes():
        for u in np.flatnonzero(many & ~crowd):
            left, right = np.arange(l0[u], l0[u] + nl[u]), np.arange(r0[u], r0[u] + nr[u])
            left, right = left[stair_a[left]], right[stair_b[right]]
            # a pair belongs to the cell's level if one of its shapes does
            for l, r in ((left[a.own[left]], right), (left[~a.own[left]], right[b.own[right]])):
                if len(l) and len(r):
                    yield from stair_pairs(a, b, l, r, x[u], y[u], least, distance, with_area)
    for i, j in _gathered(tried()):
        if distance is not None:
            i, j, value = near(a, b, i, j, distance)
            contact = np.zeros(len(i), bool)
        else:
            i, j, value, contact = hits(a, b, i, j, predicate, least)
        if len(i):
            yield i, j, value, contact
    if boxes:
        for i, j, value in _gathered(by_boxes()):
            yield i, j, value, np.zeros(len(i), bool)


def _gathered(portions: Iterator[tuple]) -> Iterator[tuple]:
    """Portions put together to about ``PAIRS_OUT``."""
    held, size = [], 0
    for p in portions:
        held.append(p)
        size += len(p[0])
        if size >= PAIRS_OUT:
            yield tuple(np.concatenate(v) for v in zip(*held))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(v) for v in zip(*held))
