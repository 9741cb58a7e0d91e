"""Per-pair overlay evaluated on Arrow batches with numpy.

Same sums as :func:`canopy.functions.overlay.edge_pair_terms` (trapezoid
overlap for G12, closed-segment contact for G13), but each candidate pair is
finished inside the task that produced it: the edge pairs of a batch of
candidate rows are laid out as flat index arrays, a bounded number at a time,
evaluated as vectors and summed back per row with ``bincount``. No edge-pair
rows are materialised and no shuffle is needed to regroup them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

PAIR_RESULT = T.StructType([T.StructField("inter_area", T.DoubleType()),
                            T.StructField("edge_contact", T.BooleanType())])


def _edges(arr: pa.Array):
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    off = arr.offsets.to_numpy().astype(np.int64)
    v = arr.values
    cols = [v.field(k).to_numpy(zero_copy_only=False) for k in ("ax", "ay", "bx", "by")]
    # A null edge list (null geometry) behaves as no edges.
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    n = np.diff(off)
    n[~valid] = 0
    return off[:-1], n, cols


def _orient(ax, ay, bx, by, cx, cy):
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _bounds(n: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Per row the least ``lo`` and greatest ``hi`` of its ``n`` values (an empty row gives an empty range)."""
    low, high = np.full(len(n), np.inf), np.full(len(n), -np.inf)
    some = n > 0
    if some.any():
        first = (np.cumsum(n) - n)[some]
        low[some], high[some] = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
    return low, high


def _compact(arr: pa.Array):
    """(row, count per row, coordinates) of all edges, null lists left out."""
    start, n, cols = _edges(arr)
    total = int(n.sum())
    row = np.repeat(np.arange(len(n)), n)
    at = start[row] + np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    return row, n, [c[at] for c in cols]


def _kept(row: np.ndarray, rows: int, cols: list, keep: np.ndarray):
    row = row[keep]
    return np.bincount(row, minlength=rows), [c[keep] for c in cols]


def _pair_chunks(na: np.ndarray, nb: np.ndarray, limit: int):
    """(row, edge of a, edge of b) index arrays of all edge pairs, about ``limit`` pairs at a time.

    A row with more pairs is cut along its first side, so memory stays
    bounded however many edges one shape has.
    """
    step = np.maximum(1, limit // np.maximum(nb, 1))
    cuts = np.where(nb > 0, -(-na // step), 0)
    row = np.repeat(np.arange(len(na)), cuts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    begin = k * step[row]
    length = np.minimum(step[row], na[row] - begin)
    a0, b0 = (np.cumsum(na) - na)[row] + begin, (np.cumsum(nb) - nb)[row]
    size = length * nb[row]
    chunk = np.cumsum(size) // limit
    for c0, c1 in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.diff(chunk, prepend=-1, append=-2)))):
        n = size[c0:c1]
        piece = np.repeat(np.arange(c0, c1), n)
        local = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        r = row[piece]
        yield r, a0[piece] + local // nb[r], b0[piece] + local % nb[r]


def _overlap_terms(a, b, base):
    """Signed trapezoid overlap and contact of edge pairs whose x ranges overlap."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    lo = np.maximum(np.minimum(ax, bx), np.minimum(cx, dx))
    hi = np.minimum(np.maximum(ax, bx), np.maximum(cx, dx))
    w = hi - lo
    with np.errstate(divide="ignore", invalid="ignore"):
        ka = np.where(bx != ax, (by - ay) / np.where(bx != ax, bx - ax, 1.0), 0.0)
        kb = np.where(dx != cx, (dy - cy) / np.where(dx != cx, dx - cx, 1.0), 0.0)
        yal = ay - base + ka * (lo - ax)
        yah = ay - base + ka * (hi - ax)
        ybl = cy - base + kb * (lo - cx)
        ybh = cy - base + kb * (hi - cx)
        dl, dh = yal - ybl, yah - ybh
        same = dl * dh >= 0
        den = 2.0 * (np.abs(dl) + np.abs(dh))
        absd = np.where(same, np.abs(dl + dh) / 2.0, (dl * dl + dh * dh) / np.where(same, 1.0, den))
    term = np.where(w > 0, np.sign(ax - bx) * np.sign(cx - dx) * w * ((yal + yah + ybl + ybh) / 4.0 - absd / 2.0), 0.0)
    return term, _meet(a, b)


def _meet(a, b):
    """Whether the closed segments of edge pairs share a point."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    box = (np.minimum(ay, by) <= np.maximum(cy, dy)) & (np.minimum(cy, dy) <= np.maximum(ay, by)) \
        & (np.minimum(ax, bx) <= np.maximum(cx, dx)) & (np.minimum(cx, dx) <= np.maximum(ax, bx))
    return box & (_orient(ax, ay, bx, by, cx, cy) * _orient(ax, ay, bx, by, dx, dy) <= 0) \
        & (_orient(cx, cy, dx, dy, ax, ay) * _orient(cx, cy, dx, dy, bx, by) <= 0)


# Edge pairs evaluated at once.
PAIRS_AT_ONCE = 1 << 20


def pair_sums(ea_arr: pa.Array, eb_arr: pa.Array, yb: np.ndarray, limit: int = PAIRS_AT_ONCE):
    """Intersection area and boundary contact for each row's two edge lists.

    Edges outside the x range the two shapes share are dropped first: they
    add to neither sum. So a large shape costs a small partner only the edges
    above, below and inside the partner's extent.
    """
    _ra, na, ca = _compact(ea_arr)
    _rb, nb, cb = _compact(eb_arr)
    return edge_sums(na, ca, nb, cb, yb, limit)


def edge_sums(na: np.ndarray, ca: list, nb: np.ndarray, cb: list, yb: np.ndarray, limit: int = PAIRS_AT_ONCE):
    """:func:`pair_sums` of rows given as edge counts and the coordinates of all their edges."""
    rows = len(na)
    ra, rb = np.repeat(np.arange(rows), na), np.repeat(np.arange(rows), nb)
    area, contact = np.zeros(rows), np.zeros(rows)
    alo, ahi = np.minimum(ca[0], ca[2]), np.maximum(ca[0], ca[2])
    blo, bhi = np.minimum(cb[0], cb[2]), np.maximum(cb[0], cb[2])
    (a0, a1), (b0, b1) = _bounds(na, alo, ahi), _bounds(nb, blo, bhi)
    lo, hi = np.maximum(a0, b0), np.minimum(a1, b1)
    na, ca = _kept(ra, rows, ca, (ahi >= lo[ra]) & (alo <= hi[ra]))
    nb, cb = _kept(rb, rows, cb, (bhi >= lo[rb]) & (blo <= hi[rb]))
    for row, ia, ib in _pair_chunks(na, nb, limit):
        lo = np.maximum(np.minimum(ca[0][ia], ca[2][ia]), np.minimum(cb[0][ib], cb[2][ib]))
        hi = np.minimum(np.maximum(ca[0][ia], ca[2][ia]), np.maximum(cb[0][ib], cb[2][ib]))
        keep = lo <= hi
        row, ia, ib = row[keep], ia[keep], ib[keep]
        term, meet = _overlap_terms([c[ia] for c in ca], [c[ib] for c in cb], yb[row])
        area += np.bincount(row, weights=term, minlength=rows)
        contact += np.bincount(row, weights=meet.astype(np.float64), minlength=rows)
    return area, contact > 0


@arrow_udf(PAIR_RESULT)
def _pair_overlay_udf(ea: pa.Array, eb: pa.Array, yb: pa.Array) -> pa.Array:
    area, contact = pair_sums(ea, eb, yb.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(np.maximum(area, 0.0)), pa.array(contact)],
                                      names=["inter_area", "edge_contact"])


# Marked non-deterministic only so the optimizer never duplicates it (a
# filter on its result would otherwise re-run the kernel); it is a pure
# function of its inputs, so task retries recompute the same values.
_pair_overlay_udf = _pair_overlay_udf.asNondeterministic()


def pair_overlay_col(edges_a: Column, edges_b: Column, yb: Column) -> Column:
    """``struct(inter_area, edge_contact)`` for two edge lists and a base line below both."""
    return _pair_overlay_udf(edges_a, edges_b, yb)


def _point_seg_d2(px, py, ax, ay, bx, by):
    """Squared distance from points to segments (vectorised)."""
    dx, dy = bx - ax, by - ay
    ll = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(ll > 0, ((px - ax) * dx + (py - ay) * dy) / np.where(ll > 0, ll, 1.0), 0.0)
    t = np.clip(t, 0.0, 1.0)
    qx, qy = ax + t * dx - px, ay + t * dy - py
    return qx * qx + qy * qy


def pair_min_dist2(ea_arr: pa.Array, eb_arr: pa.Array, limit: int = PAIRS_AT_ONCE) -> np.ndarray:
    """Least squared distance between the boundaries of each row's two edge lists."""
    _ra, na, ca = _compact(ea_arr)
    _rb, nb, cb = _compact(eb_arr)
    return edge_dist2(na, ca, nb, cb, limit)


def edge_dist2(na: np.ndarray, ca: list, nb: np.ndarray, cb: list, limit: int = PAIRS_AT_ONCE) -> np.ndarray:
    """:func:`pair_min_dist2` of rows given as edge counts and the coordinates of all their edges."""
    out = np.full(len(na), np.inf)
    for row, ia, ib in _pair_chunks(na, nb, limit):
        a, b = [c[ia] for c in ca], [c[ib] for c in cb]
        d2 = np.minimum.reduce([_point_seg_d2(a[0], a[1], *b), _point_seg_d2(a[2], a[3], *b),
                                _point_seg_d2(b[0], b[1], *a), _point_seg_d2(b[2], b[3], *a)])
        np.minimum.at(out, row, np.where(_meet(a, b), 0.0, d2))
    return out


@arrow_udf(T.DoubleType())
def _pair_dist2_udf(ea: pa.Array, eb: pa.Array) -> pa.Array:
    return pa.array(pair_min_dist2(ea, eb))


_pair_dist2_udf = _pair_dist2_udf.asNondeterministic()


def boundary_dist2_col(edges_a: Column, edges_b: Column) -> Column:
    """Least squared distance between two shapes' boundaries (0 when they touch or cross)."""
    return _pair_dist2_udf(edges_a, edges_b)
