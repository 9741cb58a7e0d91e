"""WKB <-> rings codec (Arrow-batched UDFs) and header tests as native expressions.

Only polygonal geometry is needed by the overlay queries. Decoding keeps x
and y, so Z and M are dropped on the way in (G09 comes for free); encoding
writes 2D little-endian Polygon, or MultiPolygon when a row has more than
one part.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .geometry import RINGS

_PA_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PA_RING = pa.struct([("part", pa.int32()), ("hole", pa.bool_()), ("pts", pa.list_(_PA_POINT))])
_PA_RINGS = pa.list_(_PA_RING)

# WKB geometry type codes (ISO / OGC simple features).
GEOMETRY_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint",
                  5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


class _Reader:
    __slots__ = ("buf", "pos")

    def __init__(self, buf: bytes):
        self.buf, self.pos = buf, 0

    def header(self):
        order = self.buf[self.pos]
        e = "<" if order == 1 else ">"
        (code,) = struct.unpack_from(e + "I", self.buf, self.pos + 1)
        self.pos += 5
        has_srid = bool(code & 0x20000000)
        dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
        base = code & 0x0FFFFFFF
        if base >= 1000:
            dims = 2 + (base // 1000 in (1, 3)) + (base // 1000 in (2, 3))
            base %= 1000
        if has_srid:
            self.pos += 4
        return e, base, dims

    def uint(self, e):
        (v,) = struct.unpack_from(e + "I", self.buf, self.pos)
        self.pos += 4
        return v

    def coords(self, e, n, dims):
        a = np.frombuffer(self.buf, dtype=np.dtype(e + "f8"), count=n * dims, offset=self.pos)
        self.pos += 8 * n * dims
        a = a.reshape(n, dims)
        return a[:, 0], a[:, 1]


def _read_polygon(r: _Reader, e, dims, part, out):
    for k in range(r.uint(e)):
        n = r.uint(e)
        xs, ys = r.coords(e, n, dims)
        out.append((part, k > 0, xs, ys))


def decode_rings(buf: bytes) -> list:
    """Rings ``(part, hole, xs, ys)`` of a geometry's polygons; points and lines have none."""
    return _rings_at(_Reader(buf))


def _rings_at(r: _Reader) -> list:
    e, base, dims = r.header()
    out: list = []
    if base == 3:
        _read_polygon(r, e, dims, 0, out)
    elif base == 6:
        for p in range(r.uint(e)):
            e2, b2, d2 = r.header()
            if b2 != 3:
                raise ValueError(f"MultiPolygon member of type {b2}")
            _read_polygon(r, e2, d2, p, out)
    elif base == 7:
        for _ in range(r.uint(e)):
            inner = _Reader(r.buf[r.pos:])
            part = 1 + max((ring[0] for ring in out), default=-1)
            out += [(part + p, hole, xs, ys) for p, hole, xs, ys in _rings_at(inner)]
            r.pos += inner.pos
    else:
        _skip(r, e, base, dims)
    return out


def _skip(r: _Reader, e, base: int, dims: int) -> None:
    """Move past a geometry without area."""
    if base == 1:
        r.coords(e, 1, dims)
    elif base == 2:
        r.coords(e, r.uint(e), dims)
    elif base in (4, 5):
        for _ in range(r.uint(e)):
            e2, b2, d2 = r.header()
            _skip(r, e2, b2, d2)
    else:
        raise ValueError(f"unknown geometry type {base}")


def encode_rings(rings: list, z: float | None = None) -> bytes:
    """Little-endian WKB for rings ``(part, hole, xs, ys)``; 2D, or ISO
    ``Polygon Z`` with the constant ``z`` on every vertex when given."""
    parts: dict[int, list] = {}
    for part, _hole, xs, ys in rings:
        parts.setdefault(part, []).append((xs, ys))
    poly_t, multi_t = (3, 6) if z is None else (1003, 1006)

    def poly(rs):
        chunks = [struct.pack("<BII", 1, poly_t, len(rs))]
        for xs, ys in rs:
            cols = [np.asarray(xs, "<f8"), np.asarray(ys, "<f8")]
            if z is not None:
                cols.append(np.full(len(xs), z, "<f8"))
            chunks.append(struct.pack("<I", len(xs)))
            chunks.append(np.column_stack(cols).tobytes())
        return b"".join(chunks)

    if len(parts) <= 1:
        return poly(next(iter(parts.values()), []))
    return b"".join([struct.pack("<BII", 1, multi_t, len(parts))] + [poly(parts[p]) for p in sorted(parts)])


def _rings_to_arrow(rows: list) -> pa.Array:
    """Build the nested rings array from per-row lists (None = null row)."""
    ring_off, pt_off = [0], [0]
    parts, holes, xs, ys, mask = [], [], [], [], []
    for rs in rows:
        mask.append(rs is None)
        for part, hole, x, y in rs or ():
            parts.append(part)
            holes.append(hole)
            xs.append(np.asarray(x, "f8"))
            ys.append(np.asarray(y, "f8"))
            pt_off.append(pt_off[-1] + len(x))
        ring_off.append(ring_off[-1] + (len(rs) if rs else 0))
    cat = (lambda v: np.concatenate(v) if v else np.zeros(0, "f8"))
    pts = pa.StructArray.from_arrays([pa.array(cat(xs)), pa.array(cat(ys))], names=["x", "y"])
    ring = pa.StructArray.from_arrays(
        [pa.array(parts, pa.int32()), pa.array(holes, pa.bool_()),
         pa.ListArray.from_arrays(pa.array(pt_off, pa.int32()), pts)],
        names=["part", "hole", "pts"])
    return pa.ListArray.from_arrays(pa.array(ring_off, pa.int32()), ring, mask=pa.array(mask, pa.bool_()))


def _arrow_rows(arr: pa.Array):
    """Per row: None or a list of (part, hole, xs, ys) with numpy coordinate views."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    ring_off = arr.offsets.to_numpy()
    rings = arr.values
    parts = rings.field("part").to_numpy(zero_copy_only=False)
    holes = rings.field("hole").to_numpy(zero_copy_only=False)
    pts = rings.field("pts")
    pt_off = pts.offsets.to_numpy()
    x = pts.values.field("x").to_numpy(zero_copy_only=False)
    y = pts.values.field("y").to_numpy(zero_copy_only=False)
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(arr)):
        if not valid[i]:
            yield None
            continue
        yield [(int(parts[k]), bool(holes[k]), x[pt_off[k]:pt_off[k + 1]], y[pt_off[k]:pt_off[k + 1]])
               for k in range(ring_off[i], ring_off[i + 1])]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + c)`` for every (s, c), vectorised."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    return np.repeat(np.asarray(starts, np.int64), counts) + (
        np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts))


def encode_batch(arr: pa.Array, z: np.ndarray | None = None) -> pa.Array:
    """Vectorised little-endian WKB for a whole Arrow batch of rings.

    Every byte offset is computed with numpy and headers, point counts and
    coordinates are scattered into one buffer; rows with more than one part
    (MultiPolygon) go through :func:`encode_rings`. ``z``: per-row Z value
    (NaN = 2D).
    """
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    n = len(arr)
    valid = arr.is_valid().to_numpy(zero_copy_only=False)
    ring_off = arr.offsets.to_numpy().astype(np.int64)
    rings = arr.values
    parts = rings.field("part").to_numpy(zero_copy_only=False).astype(np.int64)
    pts = rings.field("pts")
    pt_off = pts.offsets.to_numpy().astype(np.int64)
    xs = pts.values.field("x").to_numpy(zero_copy_only=False)
    ys = pts.values.field("y").to_numpy(zero_copy_only=False)
    r0 = ring_off[0]
    row_nr = np.diff(ring_off)
    row_nr[~valid] = 0
    ring_row = np.repeat(np.arange(n), row_nr)
    ring_idx = _ranges(ring_off[:-1], row_nr)
    # rows with several parts take the general path
    multi = np.zeros(n, bool)
    if len(ring_idx):
        np.logical_or.at(multi, ring_row, parts[ring_idx] != parts[ring_off[:-1][ring_row]])
    zz = np.full(n, np.nan) if z is None else np.asarray(z, float)
    dims = np.where(np.isnan(zz), 2, 3)
    npts = (pt_off[ring_idx + 1] - pt_off[ring_idx]) if len(ring_idx) else np.zeros(0, np.int64)
    psize = 8 * dims[ring_row]
    ring_bytes = 4 + npts * psize
    row_bytes = 9 + np.bincount(ring_row, weights=ring_bytes, minlength=n).astype(np.int64)
    row_bytes[~valid | multi] = 0
    out_off = np.concatenate([[0], np.cumsum(row_bytes)])
    buf = np.zeros(int(out_off[-1]), np.uint8)
    simple = valid & ~multi
    hdr = np.zeros((n, 9), np.uint8)
    hdr[:, 0] = 1
    hdr[:, 1:5] = np.where(dims == 3, 1003, 3).astype("<u4").view(np.uint8).reshape(n, 4)
    hdr[:, 5:9] = row_nr.astype("<u4").view(np.uint8).reshape(n, 4)
    rows = np.nonzero(simple)[0]
    buf[(out_off[rows][:, None] + np.arange(9)).ravel()] = hdr[rows].ravel()
    keep = simple[ring_row]
    if keep.any():
        kr, ki, knp, kb, kps = ring_row[keep], ring_idx[keep], npts[keep], ring_bytes[keep], psize[keep]
        first = np.concatenate([[True], kr[1:] != kr[:-1]])
        csum = np.cumsum(kb) - kb
        start_of_row = np.maximum.accumulate(np.where(first, csum, 0))
        ring_pos = out_off[kr] + 9 + (csum - start_of_row)
        buf[(ring_pos[:, None] + np.arange(4)).ravel()] = knp.astype("<u4").view(np.uint8).ravel()
        pidx = _ranges(pt_off[ki], knp)
        p_ring = np.repeat(np.arange(len(ki)), knp)
        p_local = np.arange(len(pidx)) - np.repeat(np.cumsum(knp) - knp, knp)
        p_size = kps[p_ring]
        pos = ring_pos[p_ring] + 4 + p_local * p_size
        for d, vals in enumerate((xs[pidx], ys[pidx], zz[kr][p_ring])):
            m = p_size > 8 * d
            b = np.ascontiguousarray(vals[m], "<f8").view(np.uint8).reshape(-1, 8)
            buf[((pos[m] + 8 * d)[:, None] + np.arange(8)).ravel()] = b.ravel()
    out = pa.BinaryArray.from_buffers(pa.binary(), n, [pa.py_buffer(np.packbits(valid, bitorder="little")),
                                                       pa.py_buffer(out_off.astype(np.int32)), pa.py_buffer(buf)])
    if multi.any():
        vals = out.to_pylist()
        rows_py = list(_arrow_rows(arr))
        for i in np.nonzero(multi & valid)[0]:
            vals[i] = encode_rings(rows_py[i], None if np.isnan(zz[i]) else float(zz[i]))
        out = pa.array(vals, pa.binary())
    return out


def _u32(buf: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(buf[pos[:, None] + np.arange(4)]).view("<u4").ravel().astype(np.int64)


def _mask(n: int, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[rows] = True
    return out


def decode_batch(wkb: pa.Array) -> pa.Array:
    """Vectorised decode of a batch of little-endian Polygon / Polygon Z WKB.

    Ring headers are read for all rows at once, one ring level at a time;
    coordinates are gathered with index arrays. Other rows (big-endian, EWKB,
    MultiPolygon, M) go through the per-row decoder, only they.
    """
    wkb = wkb.combine_chunks() if isinstance(wkb, pa.ChunkedArray) else wkb
    n = len(wkb)
    valid = wkb.is_valid().to_numpy(zero_copy_only=False)
    if n == 0 or not valid.any():
        return _rings_to_arrow([None] * n)
    odt = np.int64 if pa.types.is_large_binary(wkb.type) else np.int32
    off = np.frombuffer(wkb.buffers()[1], odt)[wkb.offset: wkb.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(wkb.buffers()[2], np.uint8)
    rows = np.nonzero(valid)[0]
    start, size = off[rows], off[rows + 1] - off[rows]
    plain = size >= 9
    plain[plain] &= buf[start[plain]] == 1
    plain[plain] &= np.isin(_u32(buf, start[plain] + 1), (3, 1003))
    if not plain.all():
        rest = rows[~plain]
        fast = decode_batch(pa.array([b if k else None for b, k in zip(wkb.to_pylist(), _mask(n, rows[plain]))], wkb.type))
        slow = _rings_to_arrow([decode_rings(wkb[int(k)].as_py()) for k in rest])
        pick = np.arange(n)
        pick[rest] = n + np.arange(len(rest))
        return pa.concat_arrays([fast, slow]).take(pa.array(pick))
    typ = _u32(buf, start + 1)
    psize = np.where(typ == 1003, 24, 16)
    nr = _u32(buf, start + 5)
    pos = start + 9
    ring_row, ring_k, ring_start, ring_np, ring_ps = [], [], [], [], []
    for k in range(int(nr.max()) if len(nr) else 0):
        live = nr > k
        p = pos[live]
        npts = _u32(buf, p)
        ring_row.append(rows[live]); ring_k.append(np.full(len(p), k)); ring_start.append(p + 4)
        ring_np.append(npts); ring_ps.append(psize[live])
        pos[live] = p + 4 + npts * psize[live]
    if ring_row:
        rr, rk, rs, rn, rp = (np.concatenate(v) for v in (ring_row, ring_k, ring_start, ring_np, ring_ps))
        order = np.lexsort((rk, rr))
        rr, rk, rs, rn, rp = rr[order], rk[order], rs[order], rn[order], rp[order]
    else:
        rr = rk = rs = rn = rp = np.zeros(0, np.int64)
    # coordinates: x at point start, y 8 bytes later
    p_ring = np.repeat(np.arange(len(rs)), rn)
    p_local = np.arange(int(rn.sum())) - np.repeat(np.cumsum(rn) - rn, rn)
    p_pos = rs[p_ring] + p_local * rp[p_ring]
    xs = np.ascontiguousarray(buf[p_pos[:, None] + np.arange(8)]).view("<f8").ravel()
    ys = np.ascontiguousarray(buf[(p_pos + 8)[:, None] + np.arange(8)]).view("<f8").ravel()
    per_row = np.bincount(rr, minlength=n) if len(rr) else np.zeros(n, np.int64)
    ring_off = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
    pt_off = np.concatenate([[0], np.cumsum(rn)]).astype(np.int32)
    pts = pa.StructArray.from_arrays([pa.array(xs), pa.array(ys)], names=["x", "y"])
    ring = pa.StructArray.from_arrays(
        [pa.array(np.zeros(len(rr), np.int32)), pa.array(rk > 0), pa.ListArray.from_arrays(pa.array(pt_off), pts)],
        names=["part", "hole", "pts"])
    return pa.ListArray.from_arrays(pa.array(ring_off), ring, mask=pa.array(~valid))


@arrow_udf(RINGS)
def _wkb_to_rings(wkb: pa.Array) -> pa.Array:
    return decode_batch(wkb)


@arrow_udf(T.BinaryType())
def _rings_to_wkb(rings: pa.Array) -> pa.Array:
    return encode_batch(rings)


@arrow_udf(T.BinaryType())
def _rings_z_to_wkb(rings: pa.Array, z: pa.Array) -> pa.Array:
    return encode_batch(rings, z.to_numpy(zero_copy_only=False).astype(float))


# Pure functions, marked non-deterministic only so the optimizer never runs
# them twice (a filter and a projection on the same result would otherwise
# each evaluate the UDF); retried tasks recompute identical values.
_wkb_to_rings = _wkb_to_rings.asNondeterministic()
_rings_to_wkb = _rings_to_wkb.asNondeterministic()
_rings_z_to_wkb = _rings_z_to_wkb.asNondeterministic()


def rings_from_wkb(wkb: Column | str) -> Column:
    """WKB (any byte order, Z/M allowed, EWKB SRID allowed) -> 2D rings."""
    return _wkb_to_rings(F.col(wkb) if isinstance(wkb, str) else wkb)


def wkb_from_rings(rings: Column | str, z: Column | None = None) -> Column:
    """Rings -> little-endian WKB (``st_asbinary`` of the shape); with ``z``
    (a double column, NULL = 2D) writes ``Polygon Z`` for those rows."""
    r = F.col(rings) if isinstance(rings, str) else rings
    return _rings_to_wkb(r) if z is None else _rings_z_to_wkb(r, z)


def force_2d(wkb: Column | str) -> Column:
    """Rewrite a polygonal WKB in two dimensions."""
    return wkb_from_rings(rings_from_wkb(wkb))


# ---- header tests, native expressions (no Python) -------------------------

def _byte(wkb: Column, pos: int) -> Column:
    return F.conv(F.hex(F.substring(wkb, pos, 1)), 16, 10).cast("long")


def type_code(wkb: Column | str) -> Column:
    """Raw uint32 geometry type code from the WKB header, either byte order."""
    w = F.col(wkb) if isinstance(wkb, str) else wkb
    b = [_byte(w, p) for p in (2, 3, 4, 5)]
    le = b[0] + b[1] * 256 + b[2] * 65536 + b[3] * 16777216
    be = b[3] + b[2] * 256 + b[1] * 65536 + b[0] * 16777216
    return F.when(_byte(w, 1) == 1, le).otherwise(be)


def geom_type(wkb: Column | str) -> Column:
    """Geometry type name (Polygon, MultiPolygon, ...) from the header."""
    code = type_code(wkb)
    base = F.pmod(F.pmod(code, F.lit(268435456)), F.lit(1000))   # drop EWKB flags, ISO dims
    expr = None
    for k, name in GEOMETRY_TYPES.items():
        expr = F.when(base == k, F.lit(name)) if expr is None else expr.when(base == k, F.lit(name))
    return expr


def has_z(wkb: Column | str) -> Column:
    """The header declares a Z coordinate (EWKB flag or ISO 1xxx/3xxx)."""
    code = type_code(wkb)
    iso = F.floor(F.pmod(code, F.lit(268435456)) / 1000)
    return (F.floor(code / 2147483648) % 2 == 1) | iso.isin(1, 3)
