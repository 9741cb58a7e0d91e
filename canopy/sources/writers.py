"""Shapefiles, GeoPackages and archives written by tasks, one file a group of rows.

The preparation flows read files that others bring; these writers make such
files from a layer, for hand-over and for the queries that check the sources.
Every group of rows must fit a task (a file holds one group whole), and the
target folder must be one that driver and executors share as a mount. A file
is written under a name of its own and then renamed, so a retried task leaves
the same file.
"""

from __future__ import annotations

import io
import os
import sqlite3
import struct
import uuid
import zipfile
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from ..functions.wkb import decode_rings, encode_rings

# The projection file's text and the shape type of polygons.
PRJ_5880 = ('PROJCS["SIRGAS 2000 / Brazil Polyconic",GEOGCS["SIRGAS 2000",DATUM["Sistema_de_Referencia_Geocentrico_para_las_AmericaS_2000",'
            'SPHEROID["GRS 1980",6378137,298.257222101]]],PROJECTION["Polyconic"],AUTHORITY["EPSG","5880"]]')
POLYGON = 5


def local_path(path: str) -> str:
    u = urlparse(path)
    return unquote(u.path) if u.scheme in ("", "file") else path


def _shape_record(wkb: bytes | None) -> bytes:
    """A polygon record: shells clockwise, holes counter-clockwise; null shape for no geometry."""
    rings = decode_rings(wkb) if wkb is not None else []
    if not rings:
        return struct.pack("<i", 0)
    xy = []
    for _part, hole, xs, ys in rings:
        turn = float(np.sum(xs[:-1] * ys[1:] - xs[1:] * ys[:-1]))
        xy.append(np.column_stack([xs, ys])[::-1] if (turn > 0) != hole else np.column_stack([xs, ys]))
    points = np.concatenate(xy)
    starts = np.cumsum([0, *(len(r) for r in xy[:-1])])
    box = [*points.min(axis=0), *points.max(axis=0)]
    return struct.pack("<i4d2i", POLYGON, *box, len(xy), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()


def shapefile_parts(rows: pd.DataFrame, text_width: int = 64) -> dict[str, bytes]:
    """The files of one shapefile by extension; numbers as N(18), anything else as text of at most ``text_width`` bytes."""
    records = [_shape_record(g) for g in rows["geometry"]]
    shp, shx, at = io.BytesIO(), io.BytesIO(), 50
    for k, r in enumerate(records, 1):
        shp.write(struct.pack(">2i", k, len(r) // 2) + r)
        shx.write(struct.pack(">2i", at, len(r) // 2))
        at += 4 + len(r) // 2

    def with_header(body: bytes) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<2i8d", 1000, POLYGON, *[0.0] * 8) + body

    cols = [c for c in rows.columns if c != "geometry"]
    numeric = {c: pd.api.types.is_integer_dtype(rows[c]) for c in cols}
    width = {c: 18 if numeric[c] else text_width for c in cols}
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(cols), 1 + sum(width.values()))
    for c in cols:
        head += c.encode("ascii")[:10].ljust(11, b"\0") + (b"N" if numeric[c] else b"C") + bytes(4) + bytes([width[c], 0]) + bytes(14)
    dbf = [head + b"\x0d"]
    for values in rows[cols].itertuples(index=False, name=None):
        dbf.append(b" " + b"".join((str(v).encode().rjust(width[c]) if numeric[c] else ("" if v is None else str(v)).encode()[:width[c]].ljust(width[c]))
                                   for c, v in zip(cols, values)))
    return {".shp": with_header(shp.getvalue()), ".shx": with_header(shx.getvalue()), ".dbf": b"".join(dbf) + b"\x1a",
            ".cpg": b"UTF-8", ".prj": PRJ_5880.encode()}


def _geopackage(path: str, layer: str, rows: pd.DataFrame, srid: int) -> None:
    cols = [c for c in rows.columns if c != "geometry"]
    kinds = {c: "INTEGER" if pd.api.types.is_integer_dtype(rows[c]) else "TEXT" for c in cols}
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, srs_id INT)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INT)")
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?)", (layer, srid))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', ?)", (layer, srid))
        db.execute(f'CREATE TABLE "{layer}" (fid INTEGER PRIMARY KEY, {", ".join(f"{chr(34)}{c}{chr(34)} {kinds[c]}" for c in cols)}, geom BLOB)')
        head = b"GP" + bytes([0, 1]) + struct.pack("<i", srid)
        db.executemany(f'INSERT INTO "{layer}" VALUES (NULL, {", ".join("?" * len(cols))}, ?)',
                       [(*(v.item() if hasattr(v, "item") else v for v in r[:-1]), None if r[-1] is None else head + encode_rings(decode_rings(r[-1])))
                        for r in rows[[*cols, "geometry"]].itertuples(index=False, name=None)])
    db.close()


def write_files(layer: DataFrame, group: Column, folder: str, kind: str, srid: int = 5880) -> list[str]:
    """Write ``layer`` (WKB ``geometry`` and attributes) as one file per value of ``group``; the files' names.

    ``kind``: "zip" (archives that hold one shapefile), "shp" or "gpkg". The
    value of ``group`` is the file's and the layer's name.
    """
    target = local_path(folder)
    os.makedirs(target, exist_ok=True)

    def put(name: str, data: bytes) -> None:
        part = os.path.join(target, f".{uuid.uuid4().hex}")
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, os.path.join(target, name))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name = key[0]
        rows = rows.drop(columns=["_file"])
        if kind == "gpkg":
            part = os.path.join(target, f".{uuid.uuid4().hex}")
            _geopackage(part, name, rows, srid)
            os.replace(part, os.path.join(target, f"{name}.gpkg"))
        elif kind == "zip":
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for ext, data in shapefile_parts(rows).items():
                    z.writestr(name + ext, data)
            put(f"{name}.zip", out.getvalue())
        else:
            for ext, data in shapefile_parts(rows).items():
                put(name + ext, data)
        return pd.DataFrame({"name": [name]})

    return sorted(r.name for r in layer.withColumn("_file", group).groupBy("_file").applyInPandas(one, "name string").collect())
