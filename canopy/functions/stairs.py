"""Pairs of stair shapes in one cell: found and overlaid as boxes, or counted and their areas summed without going through them.

A stair is a closed shape with horizontal and vertical edges whose boundary
climbs in steps from the lower right corner of its box to the upper left one:
a rectangle (one step), an L (two), and so on. It is the union of the boxes from
its lower left corner to its outer corners, and a sum of signed boxes: the outer
corners' less those of the inner corners between them. Two stairs share either
nothing or a stair again, so

- a pair meets just if the signed boxes' number of overlaps is 1 (otherwise 0);
- the common area is the signed sum of the boxes' common areas.

Both are sums over corners of one side that come before corners of the other in
x and y: along an axis, two intervals overlap ``[a0 <= b1] - [a1 < b0]`` times and
over the signed sum of ``max(0, b - a)`` of their ends. So each shape of one side gets
the number of its partners and the area in common with them by sorting corners and
summing what comes before (:class:`_Before`), for all groups of shapes at once: what is compared grows as n^1.5
for n corners, at a few processor steps each, where pairs grow with their product. Sums are exact while they are whole numbers under 2^53,
otherwise they round like any sum of doubles.

A pair is found in the cell of the lower left corner of what it shares, as in the pairwise join; what pairs of stairs
beginning left of the cell or below it share is taken off again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Pairs compared at once (these stay in the processor's cache).
AT_ONCE = 1 << 15
#: Shapes of a tile, and its pairs compared at once, in arrays made once (fresh memory for each step costs more than the step).
TILE, TILE_PAIRS = 64, 15 << 10
#: Outer corners up to which a shape is taken for a stair.
STEPS = 8
#: Blocks of sources along an axis at most, and the comparisons that take as long as a step through a block.
MOST_BLOCKS, STEP_WORTH = 1024, 20_000
#: Numbers in a table of blocks, and in a matrix of weights, at most.
MOST_SUMS, MOST_WEIGHTS = 1 << 22, 1 << 23


class Stairs:
    """Which shapes of a batch are stairs (``any``), and those with their own box (``ok``); lower left corners ``x0``, ``y0``, numbers of
    ``steps`` (0: no stair), and outer corners: ``X`` falls and ``Y`` rises along the slots; -inf: none."""

    def __init__(self, s):
        n = len(s.n)
        row = np.repeat(np.arange(n), s.n)
        ax, ay, bx, by = s.cols
        dx, dy = bx - ax, by - ay
        last = s.first + s.n - 1
        after = np.arange(1, len(row) + 1)
        some = s.n > 0
        after[last[some]] = s.first[some]
        east, west, north, south = (dx > 0) & (dy == 0), (dx < 0) & (dy == 0), (dx == 0) & (dy > 0), (dx == 0) & (dy < 0)
        good = (east | west | north | south) & (bx == ax[after]) & (by == ay[after])
        per = lambda m: np.bincount(row[m], minlength=n)
        steps = per(west)
        self.any = some & (per(good) == s.n) & (per(east) == 1) & (per(south) == 1) & (steps <= STEPS) & (s.area > 0) & np.isfinite(s.area)
        self.x0, self.y0, x1, y1 = (np.zeros(n) for _ in range(4))
        bottom, side = np.flatnonzero(east & self.any[row]), np.flatnonzero(south & self.any[row])
        self.x0[row[bottom]], self.y0[row[bottom]], x1[row[bottom]], y1[row[side]] = ax[bottom], ay[bottom], bx[bottom], ay[side]
        self.ok = self.any & (self.x0 == s.x0) & (self.y0 == s.y0) & (x1 == s.x1) & (y1 == s.y1)
        at = np.flatnonzero(west & self.any[row])
        at = at[np.lexsort((-ax[at], ay[at], row[at]))]
        self.steps = held = np.where(self.any, steps, 0)
        slot = np.arange(len(at)) - (np.cumsum(held) - held)[row[at]]
        self.X, self.Y = (np.full((int(held.max(initial=0)), n), -np.inf) for _ in "XY")
        self.X[slot, row[at]], self.Y[slot, row[at]] = ax[at], ay[at]


class _Corners:
    """The corners of some stairs: whose, where (from the cell's corner x, y), ends along x and y (0 a beginning, 1 an end),
    and how many signed boxes have them."""

    def __init__(self, s, rows: np.ndarray, x: float, y: float):
        X, Y = s.stairs.X[:, rows], s.stairs.Y[:, rows]
        X, Y = (v[:max(1, int(np.isfinite(X).sum(axis=0).max(initial=0)))] for v in (X, Y))
        k, i = np.nonzero(np.isfinite(X))
        ki, ii = np.nonzero(np.isfinite(X[1:]))
        here, n = np.arange(len(rows)), [len(rows)] * 3 + [len(i), len(ii)]
        self.owner = np.concatenate([here, here, here, i, ii])
        self.px = np.concatenate([s.x0[rows], s.x0[rows], s.x1[rows], X[k, i], X[ki + 1, ii]]) - x
        self.py = np.concatenate([s.y0[rows], s.y1[rows], s.y0[rows], Y[k, i], Y[ki, ii]]) - y
        self.end_x = np.repeat([0, 0, 1, 1, 1], n).astype(np.int8)
        self.end_y = np.repeat([0, 1, 0, 1, 1], n).astype(np.int8)
        self.weight = np.repeat([1.0, 1.0, 1.0, 1.0, -1.0], n)
        self.kind = 2 * self.end_x + self.end_y
        self.signed = np.where(self.end_x == self.end_y, self.weight, -self.weight)


class _Before:
    """Some sources in the plane, each with a row of weights: asked for their sums over those that come before targets in x and y.

    Sources are ranked along both axes and cut into ``blocks`` by either rank. Whole blocks are summed in a table; what is
    left of a target's own two blocks is compared as matrices, of all targets in a block at a time.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, targets: int):
        n = len(x)
        # as many blocks as make the matrices cost about what a step through a block does
        blocks = int(max(1, min(MOST_BLOCKS, math.sqrt(n * targets / STEP_WORTH), math.sqrt(MOST_SUMS / weights.shape[1]))))
        self.size = max(1, -(-n // blocks))
        self.blocks = -(-n // self.size)
        by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
        self.xs, self.ys = x[by_x], y[by_y]
        rank = np.empty(n, np.int32)
        rank[by_y] = np.arange(n, dtype=np.int32)
        self.y_of = rank[by_x]
        rank = np.empty(n, np.int32)
        rank[by_x] = np.arange(n, dtype=np.int32)
        self.x_of = rank[by_y]
        self.by_x, self.by_y = weights[by_x], weights[by_y]
        cell = np.arange(n) // self.size * self.blocks + self.y_of // self.size
        shape = (self.blocks, self.blocks, weights.shape[1])
        self.table = np.zeros((self.blocks + 1, self.blocks + 1, weights.shape[1]))
        for c in range(weights.shape[1]):
            self.table[1:, 1:, c] = np.bincount(cell, self.by_x[:, c], self.blocks ** 2).reshape(shape[:2])
        np.cumsum(self.table, axis=0, out=self.table)
        np.cumsum(self.table, axis=1, out=self.table)

    def sums(self, x: np.ndarray, y: np.ndarray, x_side: str = "left", y_side: str = "left") -> np.ndarray:
        """A row of sums for each target; sources at the same place count with side "right", not with "left"."""
        p = np.searchsorted(self.xs, x, x_side).astype(np.int32)
        q = np.searchsorted(self.ys, y, y_side).astype(np.int32)
        bp, bq = p // self.size, q // self.size
        out = self.table[bp, bq]
        # of the target's block along x those before it, whatever their block along y; of its block along y those of earlier blocks along x
        self._rest(out, bp, p, q, self.y_of, self.by_x)
        self._rest(out, bq, q, bp * np.int32(self.size), self.x_of, self.by_y)
        return out

    def _rest(self, out: np.ndarray, block: np.ndarray, before: np.ndarray, limit: np.ndarray, other: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(block.astype(np.uint16), kind="stable")
        ends = np.searchsorted(block[order], np.arange(self.blocks + 1), "left")
        place = np.arange(self.size, dtype=np.int32)
        for k in range(self.blocks):
            begin = k * self.size
            theirs, w = other[begin:begin + self.size], weights[begin:begin + self.size]
            wide = max(1, AT_ONCE // len(w))
            for s in range(ends[k], ends[k + 1], wide):
                at = order[s:min(s + wide, ends[k + 1])]
                use = place[:len(w)] < (before[at] - np.int32(begin))[:, None]
                use &= theirs < limit[at][:, None]
                out[at] += use.astype(np.float64) @ w


def partners(a, b, sources: np.ndarray, targets: np.ndarray, group: np.ndarray, groups: int, x: float, y: float, with_area: bool = True):
    """Of the stairs ``targets`` (rows of b), for each group of the stairs ``sources`` (rows of a): the partners found in the cell with
    the lower left corner (x, y), and the area in common with them (0 without ``with_area``); arrays (groups, targets). ``group`` numbers the sources."""
    count, area = np.zeros((len(targets), groups)), np.zeros((len(targets), groups))
    p, q = _Corners(a, sources, x, y), _Corners(b, targets, x, y)
    # pairs of which both begin left of the cell, or both below it, are found in another
    left, below = ((a.x0[sources] < x, b.x0[targets] < x), (a.y0[sources] < y, b.y0[targets] < y))
    every = np.ones(len(sources), bool), np.ones(len(targets), bool)
    at_once = max(1, MOST_WEIGHTS // (4 * max(1, len(p.owner))))
    for g in range(0, groups, at_once):
        n = min(at_once, groups - g)
        inside = (group >= g) & (group < g + n)
        for sign, (mine, theirs) in ((1, every), (-1, left), (-1, below), (1, (left[0] & below[0], left[1] & below[1]))):
            mine = mine & inside
            if mine.any() and theirs.any():
                _add_met(count[:, g:g + n], p, q, mine[p.owner], theirs[q.owner], group - g, n, sign)
                if with_area:
                    _add_shared(area[:, g:g + n], p, q, mine[p.owner], theirs[q.owner], group - g, n, sign)
    count, area = np.rint(count.T).astype(np.int64), area.T
    # no more than rounding is left where there are no partners
    return count, np.where(count > 0, np.maximum(area, 0.0), 0.0)


def _by_group(columns: list[np.ndarray], group: np.ndarray, groups: int) -> np.ndarray:
    """The columns as a matrix with a set of columns a group, 0 in those of other groups."""
    out = np.zeros((len(group), groups, len(columns)))
    out[np.arange(len(group)), group] = np.stack(columns, axis=1)
    return out.reshape(len(group), -1)


def _add(out: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    for g in range(out.shape[1]):
        out[:, g] += np.bincount(owner, values[:, g], len(out))


def _add_met(out: np.ndarray, p: _Corners, q: _Corners, mine: np.ndarray, theirs: np.ndarray, group: np.ndarray, groups: int, sign: int) -> None:
    """Adds the number of pairs that meet: beginnings before ends or at the same place, ends before beginnings."""
    for kind in range(4):
        i, j = np.flatnonzero(mine & (p.kind == kind)), np.flatnonzero(theirs & (q.kind == 3 - kind))
        side = ["left" if end else "right" for end in divmod(kind, 2)]
        got = _Before(p.px[i], p.py[i], _by_group([p.weight[i]], group[p.owner[i]], groups), len(j)).sums(q.px[j], q.py[j], *side)
        _add(out, q.owner[j], got * (sign * q.signed[j])[:, None])


def _add_shared(out: np.ndarray, p: _Corners, q: _Corners, mine: np.ndarray, theirs: np.ndarray, group: np.ndarray, groups: int, sign: int) -> None:
    """Adds the pairs' common area."""
    i, j = np.flatnonzero(mine), np.flatnonzero(theirs)
    x, y, signed, bx, by = p.px[i], p.py[i], p.signed[i], q.px[j], q.py[j]
    weights = _by_group([signed, signed * x, signed * y, signed * x * y], group[p.owner[i]], groups)
    got = _Before(x, y, weights, len(j)).sums(bx, by).reshape(len(j), groups, 4)
    bx, by = bx[:, None], by[:, None]
    shared = bx * by * got[:, :, 0] - by * got[:, :, 1] - bx * got[:, :, 2] + got[:, :, 3]
    _add(out, q.owner[j], shared * (sign * q.signed[j])[:, None])


def _tiled(s, rows: np.ndarray) -> np.ndarray:
    """The rows in strips along x, each ordered along y, so that ``TILE`` of them in a row lie near each other."""
    by_x = rows[np.argsort(s.x0[rows], kind="stable")]
    strip = max(TILE, math.isqrt(len(rows) * TILE))
    return by_x[np.lexsort((s.y0[by_x], np.arange(len(rows)) // strip))]


def _size(s, rows: np.ndarray) -> float:
    return float(np.mean(s.x1[rows] - s.x0[rows]) + np.mean(s.y1[rows] - s.y0[rows]))


def pairs(a, b, left: np.ndarray, right: np.ndarray, x: float, y: float, least: float | None = None,
          distance: float | None = None, with_area: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the stairs ``left`` and ``right`` in the cell with the lower left corner (x, y), one portion after another: (i, j, common area) of those
    that meet, or share more than ``least``; with ``distance`` (i, j, distance) of those at most so far apart, where boxes of ``a`` are grown by it.
    Without ``with_area`` the areas of those that meet are not taken (NaN).

    A stair is cut into one box a step; boxes are compared as matrices, stairs of equal steps at a time. Of the side with the smaller stairs a tile
    of neighbours is taken at a time, of the other those whose boxes meet the tile's: most of what is compared then meets. A left row's pairs follow each other.
    """
    if not len(left) or not len(right):
        return
    tiles_left = _size(a, left) <= _size(b, right)
    small, large, tiled, others = (a, b, left, right) if tiles_left else (b, a, right, left)
    wide = max(1, TILE_PAIRS // TILE)
    room = np.empty((5, TILE * wide)), np.empty((3, TILE * wide), bool)
    steps = np.unique(large.stairs.steps[others])
    of_steps = [others[large.stairs.steps[others] == q] for q in steps]
    for p in np.unique(small.stairs.steps[tiled]):
        mine = _tiled(small, tiled[small.stairs.steps[tiled] == p])
        for s in range(0, len(mine), TILE):
            tile = mine[s:s + TILE]
            x0, y0, x1, y1 = small.x0[tile].min(), small.y0[tile].min(), small.x1[tile].max(), small.y1[tile].max()
            for q, theirs in zip(steps, of_steps):
                near = theirs[(large.x0[theirs] <= x1) & (large.x1[theirs] >= x0) & (large.y0[theirs] <= y1) & (large.y1[theirs] >= y0)]
                for f in range(0, len(near), wide):
                    rows, cols, n, m = (tile, near[f:f + wide], p, q) if tiles_left else (near[f:f + wide], tile, q, p)
                    keep, value = _matrix(a, b, rows, cols, int(n), int(m), least, distance, with_area, room)
                    if x > x0:
                        keep &= (a.x0[rows] >= x)[:, None] | (b.x0[cols] >= x)
                    if y > y0:
                        keep &= (a.y0[rows] >= y)[:, None] | (b.y0[cols] >= y)
                    at = np.flatnonzero(keep)
                    if len(at):
                        k = np.repeat(np.arange(len(rows)), np.count_nonzero(keep, axis=1))
                        yield rows[k], cols[at - k * len(cols)], np.full(len(at), np.nan) if value is None else value.ravel()[at]


def _meet(a, b, rows: np.ndarray, cols: np.ndarray, p: int, q: int, flags: list) -> np.ndarray:
    """Whether each pair meets: just if the lower left corner of either lies below and left of an outer corner of the other."""
    s, t = a.stairs, b.stairs
    keep, some, met = flags
    corners = [(s.X[k, rows][:, None], s.Y[k, rows][:, None]) for k in range(p)], [(t.X[k, cols], t.Y[k, cols]) for k in range(q)]
    begins = (t.x0[cols], t.y0[cols]), (s.x0[rows][:, None], s.y0[rows][:, None])
    for out, outer, (x0, y0) in zip((keep, some), corners, begins):
        for k, (X, Y) in enumerate(outer):
            one = met if k else out
            np.greater_equal(X, x0, out=one)
            one &= Y >= y0
            if k:
                out |= one
    keep &= some
    return keep


def _matrix(a, b, rows: np.ndarray, cols: np.ndarray, p: int, q: int, least: float | None, distance: float | None, with_area: bool, room: tuple):
    """Whether each pair of rows and columns is asked for (in any cell), and its common area (if asked for) or distance, in ``room``'s arrays."""
    shape = (len(rows), len(cols))
    x0, w, h, low, value = (v[:shape[0] * shape[1]].reshape(shape) for v in room[0])
    flags = [v[:shape[0] * shape[1]].reshape(shape) for v in room[1]]
    if distance is None and least is None and not with_area:
        return _meet(a, b, rows, cols, p, q, flags), None
    keep, met, also = flags
    s, t = a.stairs, b.stairs
    np.maximum(s.x0[rows][:, None], t.x0[cols], out=x0)
    for k in range(p):
        X, Y, y0 = s.X[k, rows][:, None], s.Y[k, rows][:, None], (s.Y[k - 1] if k else s.y0)[rows][:, None]
        for m in range(q):
            first = not k and not m
            part = value if first else w
            np.minimum(X, t.X[m, cols], out=part)
            part -= x0
            np.minimum(Y, t.Y[m, cols], out=h)
            h -= np.maximum(y0, (t.Y[m - 1] if m else t.y0)[cols], out=low)
            if distance is not None:
                np.minimum(part, 0.0, out=part)
                np.minimum(h, 0.0, out=h)
                part *= part
                h *= h
                part += h
                if not first:
                    np.minimum(value, part, out=value)
                continue
            if least is None:
                one = keep if first else met
                np.greater_equal(part, 0.0, out=one)
                one &= np.greater_equal(h, 0.0, out=also)
                if not first:
                    keep |= one
            # two single boxes that meet share no less than nothing
            if p > 1 or q > 1 or least is not None:
                np.maximum(part, 0.0, out=part)
                np.maximum(h, 0.0, out=h)
            part *= h
            if not first:
                value += part
    if distance is None:
        return (keep if least is None else np.greater(value, least, out=keep)), value
    np.less_equal(value, distance * distance, out=keep)
    for lo, hi in (("x0", "x1"), ("y0", "y1")):
        keep &= getattr(a, lo)[rows][:, None] <= getattr(b, hi)[cols]
        keep &= getattr(b, lo)[cols] <= getattr(a, hi)[rows][:, None]
    return keep, np.sqrt(value, out=value)
