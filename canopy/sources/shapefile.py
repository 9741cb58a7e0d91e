"""ESRI Shapefile as a Spark Python Data Source (``format("shapefile")``).

Partitions are record ranges: the ``.shx`` index gives every record's offset
and the ``.dbf`` has fixed-width rows, so each task seeks straight to its
slice of both files. Attributes come from the ``.dbf`` decoded with the
``.cpg`` encoding (ISO-8859-1 when absent); geometry is emitted as 2D WKB
(polygons: rings grouped into shells and their holes); the CRS is guessed
from the ``.prj`` text into an ``srid`` column (NULL when unknown).
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .layer_columns import BATCH_ROWS, layer_schema, record_batch

RECORDS_PER_PARTITION = 50_000


def _sidecar(shp: str, ext: str) -> str | None:
    base = shp[:-4]
    for e in (ext, ext.upper()):
        if os.path.exists(base + e):
            return base + e
    return None


def read_dbf_header(path: str):
    with open(path, "rb") as f:
        head = f.read(32)
        n, hlen, rlen = struct.unpack("<IHH", head[4:12])
        fields = []
        while True:
            d = f.read(32)
            if not d or d[0] == 0x0D:
                break
            name = d[:11].split(b"\x00")[0].decode("ascii", "replace")
            fields.append((name, chr(d[11]), d[16], d[17]))
    return n, hlen, rlen, fields


def _spark_type(ftype: str, length: int, decimals: int):
    if ftype == "N":
        return LongType() if decimals == 0 and length < 19 else DoubleType()
    if ftype in ("F", "O"):
        return DoubleType()
    if ftype == "L":
        return BooleanType()
    return StringType()


def srid_from_prj(text: str | None) -> int | None:
    """EPSG code from ``.prj`` WKT: an explicit authority, else by name."""
    if not text:
        return None
    m = re.findall(r'AUTHORITY\["EPSG",\s*"?(\d+)"?\]', text)
    if m:
        return int(m[-1])
    t = text.upper()
    if "POLYCONIC" in t and "SIRGAS" in t:
        return 5880
    if t.startswith("GEOGCS") and "SIRGAS" in t:
        return 4674
    if t.startswith("GEOGCS") and ("WGS_1984" in t or "WGS 84" in t):
        return 4326
    return None


def _ring_area2(x, y):
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]))


def _inside(px, py, x, y):
    cross = (y[:-1] > py) != (y[1:] > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        xi = x[:-1] + (py - y[:-1]) * (x[1:] - x[:-1]) / np.where(y[1:] != y[:-1], y[1:] - y[:-1], 1.0)
    return bool(np.count_nonzero(cross & (px < xi)) % 2)


def polygon_wkb(parts: np.ndarray, xy: np.ndarray) -> bytes:
    """Shapefile rings (shells clockwise, holes counter-clockwise) -> WKB."""
    bounds = list(parts) + [len(xy)]
    shells, holes = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        r = xy[a:b]
        (shells if _ring_area2(r[:, 0], r[:, 1]) <= 0 else holes).append(r)
    polys = [[s] for s in shells]
    for h in holes:
        for p in polys:
            if _inside(h[0, 0], h[0, 1], p[0][:, 0], p[0][:, 1]):
                p.append(h)
                break
        else:
            polys.append([h])     # orphan hole: keep it as a shell
    enc = []
    for rings in polys:
        chunk = [struct.pack("<BII", 1, 3, len(rings))]
        for r in rings:
            chunk.append(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes())
        enc.append(b"".join(chunk))
    if len(enc) == 1:
        return enc[0]
    return struct.pack("<BII", 1, 6, len(enc)) + b"".join(enc)


def shape_wkb(content: bytes) -> bytes | None:
    (stype,) = struct.unpack_from("<i", content, 0)
    if stype == 0:
        return None
    if stype in (5, 15, 25):
        nparts, npts = struct.unpack_from("<ii", content, 36)
        parts = np.frombuffer(content, "<i4", nparts, 44)
        xy = np.frombuffer(content, "<f8", 2 * npts, 44 + 4 * nparts).reshape(npts, 2)
        return polygon_wkb(parts, xy)
    if stype in (1, 11, 21):
        x, y = struct.unpack_from("<dd", content, 4)
        return struct.pack("<BIdd", 1, 1, x, y)
    raise ValueError(f"unsupported shape type {stype}")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, encoding: str | None):
        self.path, self.schema, self.encoding = path, schema, encoding

    def partitions(self):
        shx = _sidecar(self.path, ".shx")
        n = (os.path.getsize(shx) - 100) // 8
        return [_Range(self.path, a, min(a + RECORDS_PER_PARTITION, n))
                for a in range(0, max(n, 1), RECORDS_PER_PARTITION)] or [_Range(self.path, 0, 0)]

    def read(self, partition: _Range):
        shp = partition.path
        dbf = _sidecar(shp, ".dbf")
        cpg = _sidecar(shp, ".cpg")
        enc = self.encoding or (open(cpg).read().strip() if cpg else "latin-1")
        prj = _sidecar(shp, ".prj")
        srid = srid_from_prj(open(prj, encoding="latin-1").read() if prj else None)
        n, hlen, rlen, fields = read_dbf_header(dbf)
        with open(_sidecar(shp, ".shx"), "rb") as fx:
            fx.seek(100 + 8 * partition.start)
            idx = fx.read(8 * (partition.stop - partition.start))
        with open(shp, "rb") as fs, open(dbf, "rb") as fd:
            fd.seek(hlen + rlen * partition.start)
            rows = []
            for k in range(partition.stop - partition.start):
                off, length = struct.unpack_from(">ii", idx, 8 * k)
                fs.seek(2 * off + 8)
                geom = shape_wkb(fs.read(2 * length))
                rec = fd.read(rlen)
                if rec[:1] == b"*":
                    continue
                vals, pos = [], 1
                for (name, ftype, flen, dec) in fields:
                    raw = rec[pos:pos + flen]
                    pos += flen
                    vals.append(_convert(raw, ftype, dec, enc))
                rows.append((*vals, geom, srid, os.path.basename(shp)[:-4]))
                if len(rows) == BATCH_ROWS:
                    yield record_batch(self.schema, [list(c) for c in zip(*rows)])
                    rows = []
            if rows:
                yield record_batch(self.schema, [list(c) for c in zip(*rows)])


def _convert(raw: bytes, ftype: str, dec: int, enc: str):
    txt = raw.decode(enc, "replace").strip()
    if ftype in ("N", "F", "O"):
        if not txt or txt.startswith("*"):
            return None
        return int(txt) if (ftype == "N" and dec == 0 and "." not in txt) else float(txt)
    if ftype == "L":
        return None if txt in ("", "?") else txt.upper() in ("T", "Y")
    return txt if txt else None


class ShapefileDataSource(DataSource):
    """``spark.read.format("shapefile").load("/path/layer.shp")``.

    Options: ``encoding`` (overrides the ``.cpg``).
    """

    @classmethod
    def name(cls):
        return "shapefile"

    def _path(self) -> str:
        p = self.options.get("path")
        if not p or not p.lower().endswith(".shp"):
            raise ValueError("shapefile source needs the path of one .shp file")
        return p

    def schema(self):
        _n, _h, _r, fields = read_dbf_header(_sidecar(self._path(), ".dbf"))
        cols = [StructField(f[0], _spark_type(f[1], f[2], f[3])) for f in fields]
        return layer_schema(cols)

    def reader(self, schema: StructType):
        return ShapefileReader(self._path(), schema, self.options.get("encoding"))
