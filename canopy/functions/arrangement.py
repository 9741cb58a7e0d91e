"""What a set of shapes covers inside one box, as trapezoids and as boundary chains.

Between consecutive abscissas of vertices and crossings no two edges cross, so
the edges of such a slab can be ordered by height and the covered stretches
read off: the *bands*, trapezoids given by their corners. The covered part of
the box is exactly the union of these trapezoids, whatever rounding went into
the corners; so its boundary always closes, also where crossings had to be
rounded: the lower and upper sides of the bands, and on each abscissa what
only one of the two slabs beside it covers.

A shape covers what its ring winds round (``odd=False``: the union of all
shapes), or an odd number of all edges lies below (``odd=True``: the even-odd
area of all edges together).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .validity import pair_chunks

#: Marks a side of a band that lies on the box and on no edge.
ON_BOX = -1


@dataclass
class Bands:
    """Trapezoids (xa, lo_a, hi_a) - (xb, lo_b, hi_b), and the edges they lie on (or ``ON_BOX``)."""

    xa: np.ndarray
    xb: np.ndarray
    lo_a: np.ndarray
    lo_b: np.ndarray
    hi_a: np.ndarray
    hi_b: np.ndarray
    lo_edge: np.ndarray
    hi_edge: np.ndarray

    def area(self) -> float:
        return float(np.sum((self.xb - self.xa) * ((self.hi_a - self.lo_a) + (self.hi_b - self.lo_b)) / 2))


def _near(*values: np.ndarray) -> float:
    """What rounding may move a computed coordinate by."""
    return 16 * float(np.spacing(max(1.0, *(float(np.abs(v).max(initial=0)) for v in values))))


def _heights(px, py, qx, qy, x):
    """Height of edges p-q at ``x``; the ends' own heights at the ends."""
    y = py + (x - px) * ((qy - py) / (qx - px))
    return np.where(x == px, py, np.where(x == qx, qy, y))


def _passes(px, py, qx, qy, y):
    """Abscissa at which edges p-q pass height ``y`` (NaN for those that don't)."""
    cut = (np.minimum(py, qy) < y) & (np.maximum(py, qy) > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(cut, px + (y - py) * ((qx - px) / (qy - py)), np.nan)


def _abscissas(px, py, qx, qy, box, passes) -> np.ndarray:
    """Where slabs begin and end: ends and crossings of the edges, and where they pass the box's top and bottom."""
    x0, y0, x1, y1 = box
    found = [px, qx, np.array([x0, x1]), *[p[~np.isnan(p)] for p in passes]]
    for i, j in pair_chunks(px, py, qx, qy):
        d1x, d1y, d2x, d2y = qx[i] - px[i], qy[i] - py[i], qx[j] - px[j], qy[j] - py[j]
        den = d1x * d2y - d1y * d2x
        ok = den != 0
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((px[j] - px[i]) * d2y - (py[j] - py[i]) * d2x) / np.where(ok, den, 1.0)
            u = ((px[j] - px[i]) * d1y - (py[j] - py[i]) * d1x) / np.where(ok, den, 1.0)
        hit = ok & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        found.append(px[i][hit] + t[hit] * d1x[hit])
    xs = np.clip(np.concatenate(found), x0, x1)
    near = _near(xs)
    xs[np.abs(xs - x0) <= near], xs[np.abs(xs - x1) <= near] = x0, x1
    return np.unique(xs)


def bands(edges: np.ndarray, shape: np.ndarray, box: tuple[float, float, float, float], odd: bool = False, below: int = 0) -> Bands:
    """The covered part of ``box``.

    ``edges`` (n, 4) are oriented (shells counter-clockwise), ``shape`` tells
    them apart by shape; those that lie below the box must be among them,
    or be counted in ``below`` (with ``odd``).
    """
    x0, y0, x1, y1 = box
    keep = (edges[:, 0] != edges[:, 2]) & (np.minimum(edges[:, 0], edges[:, 2]) < x1) & (np.maximum(edges[:, 0], edges[:, 2]) > x0)
    number = np.flatnonzero(keep)
    e, shape = edges[keep], shape[keep]
    left = e[:, 0] < e[:, 2]
    px, py, qx, qy = np.where(left[:, None], e, e[:, [2, 3, 0, 1]]).T
    passes = [_passes(px, py, qx, qy, y) for y in (y0, y1)]
    xs = _abscissas(px, py, qx, qy, box, passes)
    near = _near(xs, np.array([y0, y1]), py, qy)
    enters = np.where(left, 1, -1)  # a bottom edge runs to the right: above it the shape begins
    first, last = np.searchsorted(xs, np.maximum(px, x0)), np.searchsorted(xs, np.minimum(qx, x1))
    # edges of each slab, slab by slab
    span = np.maximum(last - first, 0)
    edge = np.repeat(np.arange(len(e)), span)
    slab = np.repeat(first, span) + np.arange(len(edge)) - np.repeat(np.cumsum(span) - span, span)
    # heights at both ends of each slab, held to the box: told by where an edge passes its top and bottom, as the
    # boxes above and below do, and not by a height that rounding may have put on the other side
    heights = []
    rises = qy > py
    for x in (xs[slab], xs[slab + 1]) if len(edge) else (np.zeros(0), np.zeros(0)):
        y = np.clip(_heights(px[edge], py[edge], qx[edge], qy[edge], x), y0, y1)
        for pass_at, level, after in ((passes[0][edge], y0, ~rises[edge]), (passes[1][edge], y1, rises[edge])):
            y = np.where((pass_at <= x) & after | (pass_at >= x) & ~after, level, y)  # never true of NaN
        heights.append(y)
    order = np.argsort(slab, kind="stable")
    heights = [y[order] for y in heights]
    edge, bounds = edge[order], np.searchsorted(slab[order], np.arange(len(xs)))
    out: list[tuple] = []
    for s in range(len(xs) - 1):
        xa, xb = xs[s], xs[s + 1]
        k = edge[bounds[s]:bounds[s + 1]]
        ya, yb = (y[bounds[s]:bounds[s + 1]] for y in heights)
        rank = np.lexsort((-enters[k], ya + yb))  # of edges at one height those first above which a shape begins
        k, ya, yb = k[rank], ya[rank], yb[rank]
        if odd:
            after = (np.arange(1, len(k) + 1) + below) % 2
            before = 1 - after
        else:
            by_shape = np.argsort(shape[k], kind="stable")
            step, own = enters[k][by_shape], shape[k][by_shape]
            wind = np.cumsum(step)
            starts = np.flatnonzero(np.diff(own, prepend=own[:1] - 1)) if len(own) else np.zeros(0, np.int64)
            base = np.zeros(len(own), wind.dtype)
            if len(starts):
                base = np.repeat(np.concatenate([[0], wind[starts[1:] - 1]]), np.diff(np.append(starts, len(own))))
            change = np.empty(len(k), np.int64)
            change[by_shape] = (wind - base != 0).astype(np.int64) - (wind - base - step != 0)
            after = np.cumsum(change)
            before = after - change
        opens, shuts = np.flatnonzero((before == 0) & (after > 0)), np.flatnonzero((before > 0) & (after == 0))
        lo_e, hi_e = k[opens], k[shuts]
        ya, yb = np.maximum.accumulate(ya), np.maximum.accumulate(yb)
        lo_a, lo_b, hi_a, hi_b = ya[opens], yb[opens], ya[shuts], yb[shuts]
        if odd and below % 2:  # covered from the bottom on
            lo_e, lo_a, lo_b = np.append(ON_BOX, lo_e), np.append(y0, lo_a), np.append(y0, lo_b)
        if len(lo_e) > len(hi_e):
            hi_e, hi_a, hi_b = np.append(hi_e, ON_BOX), np.append(hi_a, y1), np.append(hi_b, y1)
        if len(lo_e) > 1:  # bands that only rounding parts are one
            gap = (lo_a[1:] - hi_a[:-1] > near) | (lo_b[1:] - hi_b[:-1] > near)
            lo_e, lo_a, lo_b = (v[np.append(True, gap)] for v in (lo_e, lo_a, lo_b))
            hi_e, hi_a, hi_b = (v[np.append(gap, True)] for v in (hi_e, hi_a, hi_b))
        real = (hi_a > lo_a) | (hi_b > lo_b)
        if real.any():
            n = int(real.sum())
            out.append((np.full(n, xa), np.full(n, xb), lo_a[real], lo_b[real], hi_a[real], hi_b[real], lo_e[real], hi_e[real]))
    if not out:
        return Bands(*[np.zeros(0)] * 6, *[np.zeros(0, np.int64)] * 2)
    cols = [np.concatenate(c) for c in zip(*out)]
    for c in (6, 7):
        cols[c] = np.where(cols[c] == ON_BOX, ON_BOX, np.append(number, 0)[cols[c]])
    return Bands(*cols)


def net_cover(line: np.ndarray, lo: np.ndarray, hi: np.ndarray, step: np.ndarray, joined: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, from, to, net): stretches of each line on which the ``step`` of its intervals [lo, hi] don't sum to 0.

    ``joined`` puts neighbouring stretches of one net together; else they are cut at every interval's end.
    """
    order = np.lexsort((np.concatenate([lo, hi]), np.concatenate([line, line])))
    line, pos, step = (np.concatenate(c)[order] for c in ((line, line), (lo, hi), (step, -step)))
    if not len(line):
        return line, pos, pos, step.astype(np.int64)
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (pos[1:] != pos[:-1])
    net = np.cumsum(np.bincount(np.cumsum(new) - 1, step)).round().astype(np.int64)  # a line's steps sum to 0 at its end
    line, pos = line[new], pos[new]
    if joined:
        kept = np.ones(len(net), bool)
        kept[1:] = (net[1:] != net[:-1]) | (line[1:] != line[:-1])
        line, pos, net = line[kept], pos[kept], net[kept]
    found = np.flatnonzero(net[:-1] != 0)
    return line[found], pos[found], pos[found + 1], net[found]


@dataclass
class Outline:
    """Directed boundary of bands, the covered area on the left.

    ``pieces`` (n, 4) lie inside the box, with ``source`` telling which line each is of.
    ``sides`` are stretches of the box's own sides that the area touches: (axis, line, from, to, side),
    axis 0 for an upright line; side 1 if the area lies left of or below the line, else -1. One without length is a point to cut at.
    """

    pieces: np.ndarray
    source: np.ndarray
    sides: list[tuple[int, float, float, float, int]]


def _merged(lo: np.ndarray, hi: np.ndarray) -> list[tuple[float, float]]:
    out: list[list[float]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def line_code(*values: float) -> int:
    """A number for the line of an edge (its ends) or an upright line (its abscissa), the same in every task."""
    return hash(tuple(float(v) for v in values))


def _snapped(pieces: np.ndarray, source: np.ndarray, edges: np.ndarray, box: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Pieces whose ends differ by rounding only end at one point; what collapses or cancels that way is left out.

    Points on the box's sides, which other boxes share, and the edges' own ends stay where they are.
    """
    x0, y0, x1, y1 = box
    pts, at = np.unique(np.concatenate([pieces[:, :2], pieces[:, 2:]]), axis=0, return_inverse=True)
    if not len(pts):
        return pieces, source
    near = 1e-12 * max(1.0, float(np.abs(pts).max()))
    close = np.zeros(len(pts), bool)
    for shift in ((0, 0), (0.5, 0), (0, 0.5), (0.5, 0.5)):  # points nearer than that share a square of one of these grids
        _, where, count = np.unique(np.floor(pts / (4 * near) + shift), axis=0, return_inverse=True, return_counts=True)
        close |= count[where.reshape(-1)] > 1
    if not close.any():
        return pieces, source
    ends = set(map(tuple, np.concatenate([edges[:, :2], edges[:, 2:]]).tolist()))
    own = [(not (x in (x0, x1) or y in (y0, y1) or (x, y) in ends), x, y, k) for k, (x, y) in zip(np.flatnonzero(close).tolist(), pts[close].tolist())]
    known: dict[tuple, list] = {}
    new = np.arange(len(pts))
    for free, x, y, k in sorted(own):
        cx, cy = int(x // near), int(y // near)
        met = [m for i in (-1, 0, 1) for j in (-1, 0, 1) for m in known.get((cx + i, cy + j), ())
               if abs(pts[m, 0] - x) <= near and abs(pts[m, 1] - y) <= near] if free else []
        if met:
            new[k] = met[0]
        else:
            known.setdefault((cx, cy), []).append(k)
    at = new[at.reshape(-1)]
    a, b = at[:len(pieces)], at[len(pieces):]
    low, high, way = np.minimum(a, b), np.maximum(a, b), np.where(a < b, 1, -1)
    _, first, pair = np.unique(np.column_stack([low, high]), axis=0, return_index=True, return_inverse=True)
    net = np.bincount(pair.reshape(-1), np.where(a == b, 0, way)).round().astype(int)
    left = np.repeat(first, np.abs(net))
    turn = (np.repeat(np.sign(net), np.abs(net)) != way[left])
    p, q = np.where(turn, b[left], a[left]), np.where(turn, a[left], b[left])
    return np.concatenate([pts[p], pts[q]], axis=1), source[left]


def outline(b: Bands, edges: np.ndarray, box: tuple[float, float, float, float]) -> Outline:
    x0, y0, x1, y1 = box
    codes: dict[int, int] = {}

    def code(k: int) -> int:
        if k not in codes:
            p, q = tuple(edges[k, :2].tolist()), tuple(edges[k, 2:].tolist())
            codes[k] = line_code(*min(p, q), *max(p, q))
        return codes[k]

    at_low, at_top = (b.lo_a == y0) & (b.lo_b == y0), (b.hi_a == y1) & (b.hi_b == y1)
    sides = [(1, y0, a, z, -1) for a, z in _merged(b.xa[at_low], b.xb[at_low])]
    sides += [(1, y1, a, z, 1) for a, z in _merged(b.xa[at_top], b.xb[at_top])]
    first, last = b.xa == x0, b.xb == x1
    sides += [(0, x0, a, z, -1) for a, z in _merged(b.lo_a[first], b.hi_a[first])]
    sides += [(0, x1, a, z, 1) for a, z in _merged(b.lo_b[last], b.hi_b[last])]
    low, top = ~at_low, ~at_top
    pieces = [np.column_stack([b.xa, b.lo_a, b.xb, b.lo_b])[low], np.column_stack([b.xb, b.hi_b, b.xa, b.hi_a])[top]]
    source = [np.array([code(k) for k in own.tolist()], np.int64) for own in (b.lo_edge[low], b.hi_edge[top])]
    # upright pieces between slabs: covered on the left (1) or on the right (-1) only
    left, right = ~last, ~first
    at = np.concatenate([b.xb[left], b.xa[right]])
    x, lo, hi, side = net_cover(at, np.concatenate([b.lo_b[left], b.lo_a[right]]), np.concatenate([b.hi_b[left], b.hi_a[right]]),
                                np.concatenate([np.ones(left.sum()), -np.ones(right.sum())]), joined=False)
    up = side > 0
    pieces.append(np.column_stack([x, np.where(up, lo, hi), x, np.where(up, hi, lo)]))
    source.append(np.array([line_code(v) for v in x.tolist()], np.int64))
    found, source = _snapped(np.concatenate(pieces), np.concatenate(source), edges, box)
    # stretches of the sides are cut wherever a piece ends on them, so that all that meets at a point is seen there
    ends = np.concatenate([found[:, :2], found[:, 2:]])
    for axis, line, side in ((0, x0, -1), (0, x1, 1), (1, y0, -1), (1, y1, 1)):
        sides += [(axis, line, a, a, side) for a in np.unique(ends[ends[:, axis] == line, 1 - axis]).tolist()]
    return Outline(found, source, sides)


def next_pieces(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(next piece of each or -1, number of its start point, of its end point): at a point where several meet, every
    piece goes on with the one that bounds the same wedge of the area."""
    n = len(pieces)
    _, at = np.unique(np.concatenate([pieces[:, :2], pieces[:, 2:]]), axis=0, return_inverse=True)
    at = at.reshape(-1)
    start, end = at[:n], at[n:]
    outs = np.argsort(start, kind="stable")
    first, past = np.searchsorted(start[outs], end), np.searchsorted(start[outs], end, "right")
    follow = np.full(n, -1, np.int64)
    one = past - first == 1
    follow[one] = outs[first[one]]
    several = np.flatnonzero(past - first > 1)
    if len(several):
        turn = np.arctan2(pieces[:, 3] - pieces[:, 1], pieces[:, 2] - pieces[:, 0])
        ins = several[np.argsort(end[several], kind="stable")]
        cuts = np.flatnonzero(np.diff(end[ins])) + 1
        for own in np.split(ins, cuts):
            ways = outs[first[own[0]]:past[own[0]]]
            # round the point by angle: ways out, and ways back along those in
            back = np.where(turn[own] > 0, turn[own] - np.pi, turn[own] + np.pi)
            events = sorted([(a, 0, w) for a, w in zip(turn[ways].tolist(), ways.tolist())] + [(a, 1, w) for a, w in zip(back.tolist(), own.tolist())])
            out_list, in_list = ([w for _, kind, w in events if kind == wanted] for wanted in (0, 1))
            shift = events[0][1]
            for r, w in enumerate(in_list):
                if out_list:
                    follow[w] = out_list[(r - shift) % len(out_list)]
    return follow, start, end


def chains(o: Outline, box: tuple[float, float, float, float]) -> tuple[list[tuple], list[tuple]]:
    """(closed rings, open chains) of the pieces inside a box: (points (m, 2), sources (m - 1)).

    Points on the box's sides belong to other boxes too: chains end there. Points that lie on one straight line of their
    chain, where nothing else meets, are left out.
    """
    x0, y0, x1, y1 = box
    p = o.pieces
    if not len(p):
        return [], []
    follow, start, end = next_pieces(p)
    inner = (p[:, 2] > x0) & (p[:, 2] < x1) & (p[:, 3] > y0) & (p[:, 3] < y1)
    follow = np.where(inner, follow, -1)
    degree = np.bincount(start, minlength=max(start.max(), end.max()) + 1)
    plain = (degree[end] == 1) & (follow >= 0)
    plain[plain] &= o.source[follow[plain]] == o.source[plain]  # the point between a piece and its next is no corner
    has_before = np.zeros(len(p), bool)
    has_before[follow[follow >= 0]] = True
    used = np.zeros(len(p), bool)
    closed, opened = [], []
    for k in [*np.flatnonzero(~has_before).tolist(), *range(len(p))]:
        if used[k]:
            continue
        path, now = [], k
        while now >= 0 and not used[now]:
            used[now] = True
            path.append(now)
            now = int(follow[now])
        if now >= 0:  # round a ring: begin it at a corner
            corner = next((i for i, m in enumerate(path) if not plain[path[i - 1]]), 0)
            path = path[corner:] + path[:corner]
        own = np.array(path)
        kept = np.append(True, ~plain[own[:-1]])
        pts = np.concatenate([p[own][kept][:, :2], p[own[-1:]][:, 2:]])
        (closed if now >= 0 else opened).append((pts, o.source[own][kept]))
    return closed, opened


def simple_loops(pts: np.ndarray, source: np.ndarray) -> list[np.ndarray]:
    """The simple closed loops (first point repeated) of a closed walk, taken off wherever it comes back to a point; corners only."""
    path: list[tuple] = []
    lines: list[int] = []
    place: dict[tuple, int] = {}
    out = []
    for point, line in zip(map(tuple, pts[:-1].tolist()), source.tolist()):
        if point in place:
            at = place[point]
            out.append((path[at:], lines[at:]))
            for gone in path[at:]:
                del place[gone]
            path, lines = path[:at], lines[:at]
        place[point] = len(path)
        path.append(point)
        lines.append(line)
    out.append((path, lines))
    loops = []
    for own, of in out:
        q, of = np.array(own), np.array(of)
        while len(q) >= 3:
            before, after = np.roll(q, 1, axis=0), np.roll(q, -1, axis=0)
            u, v = q - before, after - q
            straight = (of == np.roll(of, 1)) | ((u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0] == 0) & ((u * v).sum(axis=1) > 0))
            if not straight.any():
                break
            q, of = q[~straight], of[~straight]
        if len(q) >= 3:
            loops.append(np.concatenate([q, q[:1]]))
    return loops
