"""Shapefile / GeoPackage / zip writers for tests, standard library only."""
import sqlite3
import struct

SIRGAS_POLYCONIC_PRJ = ('PROJCS["SIRGAS 2000 / Brazil Polyconic",GEOGCS["SIRGAS 2000",DATUM["Sistema_de_Referencia_'
                        'Geocentrico_para_las_AmericaS_2000",SPHEROID["GRS 1980",6378137,298.257222101]]],'
                        'PROJECTION["Polyconic"],AUTHORITY["EPSG","5880"]]')


def _poly_content(rings):
    """rings: list of closed point lists; shells clockwise, holes counter-clockwise (shapefile order)."""
    pts = [p for r in rings for p in r]
    parts, k = [], 0
    for r in rings:
        parts.append(k)
        k += len(r)
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    body = struct.pack("<i4d2i", 5, min(xs), min(ys), max(xs), max(ys), len(parts), len(pts))
    body += struct.pack(f"<{len(parts)}i", *parts)
    body += b"".join(struct.pack("<2d", *p) for p in pts)
    return body


def write_shapefile(base, records, fields, encoding="UTF-8", prj=SIRGAS_POLYCONIC_PRJ):
    """records: list of (rings or None, [field values]); fields: list of (name, type, length, decimals)."""
    contents = [struct.pack("<i", 0) if r is None else _poly_content(r) for r, _ in records]
    shp, shx = bytearray(), bytearray()
    off = 50
    for n, c in enumerate(contents, 1):
        shp += struct.pack(">2i", n, len(c) // 2) + c
        shx += struct.pack(">2i", off, len(c) // 2)
        off += 4 + len(c) // 2

    def header(total_len):
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, total_len // 2) + struct.pack("<2i4d4d", 1000, 5, 0, 0, 0, 0,
                                                                                   0, 0, 0, 0)
    with open(base + ".shp", "wb") as f:
        f.write(header(100 + len(shp)) + shp)
    with open(base + ".shx", "wb") as f:
        f.write(header(100 + len(shx)) + shx)
    rlen = 1 + sum(fl[2] for fl in fields)
    hlen = 32 + 32 * len(fields) + 1
    with open(base + ".dbf", "wb") as f:
        f.write(struct.pack("<4BIHH20x", 3, 124, 1, 1, len(records), hlen, rlen))
        for name, ftype, flen, dec in fields:
            f.write(name.encode("ascii").ljust(11, b"\x00") + ftype.encode() + b"\x00" * 4
                    + bytes([flen, dec]) + b"\x00" * 14)
        f.write(b"\x0d")
        for _r, vals in records:
            f.write(b" ")
            for (name, ftype, flen, dec), v in zip(fields, vals):
                txt = "" if v is None else (f"{v:.{dec}f}" if ftype in "NF" and dec else str(v))
                raw = txt.encode(encoding)
                f.write(raw.rjust(flen) if ftype in "NF" else raw.ljust(flen))
        f.write(b"\x1a")
    with open(base + ".cpg", "w") as f:
        f.write(encoding)
    if prj:
        with open(base + ".prj", "w") as f:
            f.write(prj)


def wkb_polygon(rings):
    out = struct.pack("<BII", 1, 3, len(rings))
    for r in rings:
        out += struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    return out


def write_gpkg(path, layers, srs_id=5880):
    """layers: {name: [(id, name_text, rings)]}"""
    c = sqlite3.connect(path)
    c.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT, identifier TEXT, srs_id INT)")
    c.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, "
              "srs_id INT, z INT, m INT)")
    for name, rows in layers.items():
        c.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, ?)", (name, name, srs_id))
        c.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (name, srs_id))
        c.execute(f'CREATE TABLE "{name}" (fid INTEGER PRIMARY KEY, nome TEXT, geom BLOB)')
        for fid, text, rings in rows:
            blob = None
            if rings is not None:
                xs = [p[0] for r in rings for p in r]
                ys = [p[1] for r in rings for p in r]
                blob = (b"GP" + bytes([0, 0b00000011]) + struct.pack("<i", srs_id)
                        + struct.pack("<4d", min(xs), max(xs), min(ys), max(ys)) + wkb_polygon(rings))
            c.execute(f'INSERT INTO "{name}" VALUES (?, ?, ?)', (fid, text, blob))
    c.commit()
    c.close()
