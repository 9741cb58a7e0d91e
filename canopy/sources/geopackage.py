"""GeoPackage layers as a Spark Python Data Source (``format("gpkg")``).

A GeoPackage is an SQLite file; tasks open it read-only with the standard
``sqlite3`` module. The driver reads only metadata (layer list, geometry
column, SRS id, rowid bounds) and splits each layer into rowid ranges, one
partition each. Geometry blobs lose their GeoPackage header and are emitted
as plain WKB.
"""

from __future__ import annotations

import sqlite3
import struct

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .layer_columns import BATCH_ROWS, layer_schema, record_batch

ROWS_PER_PARTITION = 50_000
# Partitions of one layer at most; sparse row ids make ranges wider, not more.
MAX_PARTITIONS = 10_000

# envelope size in bytes by the header's envelope indicator
_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def list_layers(path: str) -> list[str]:
    """Feature tables of a GeoPackage (``gpkg_contents``)."""
    with _connect(path) as c:
        return [r[0] for r in c.execute(
            "SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]


def layer_info(path: str, layer: str):
    with _connect(path) as c:
        gcol, srs = c.execute("SELECT column_name, srs_id FROM gpkg_geometry_columns WHERE table_name = ?",
                              (layer,)).fetchone()
        cols = [(r[1], (r[2] or "").upper()) for r in c.execute(f'PRAGMA table_info("{layer}")')]
        lo, hi, n = c.execute(f'SELECT min(rowid), max(rowid), count(*) FROM "{layer}"').fetchone()
    return gcol, srs, cols, lo, hi, n


def gpkg_to_wkb(blob: bytes | None) -> bytes | None:
    """Strip the GeoPackage binary header (magic, version, flags, srs id, envelope)."""
    if blob is None:
        return None
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry blob")
    flags = blob[3]
    env = _ENVELOPE.get((flags >> 1) & 0x07, 0)
    return bytes(blob[8 + env:])


def _spark_type(decl: str):
    if "INT" in decl:
        return LongType()
    if any(k in decl for k in ("REAL", "DOUBLE", "FLOAT", "NUMERIC")):
        return DoubleType()
    if "BOOL" in decl:
        return BooleanType()
    if "BLOB" in decl:
        return BinaryType()
    return StringType()


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class GeoPackageReader(DataSourceReader):
    def __init__(self, path: str, layer: str, schema: StructType):
        self.path, self.layer, self.schema = path, layer, schema
        self.gcol, self.srs, self.cols, self.lo, self.hi, self.n = layer_info(path, layer)

    def partitions(self):
        if self.lo is None:
            return [_Rows(1, 0)]
        parts = min(MAX_PARTITIONS, -(-self.n // ROWS_PER_PARTITION))
        step = -(-(self.hi - self.lo + 1) // parts)
        return [_Rows(a, min(a + step - 1, self.hi)) for a in range(self.lo, self.hi + 1, step)]

    def read(self, partition: _Rows):
        names = [n for n, _t in self.cols]
        sel = ", ".join(f'"{n}"' for n in names)
        gi = names.index(self.gcol)
        with _connect(self.path) as c:
            q = f'SELECT {sel} FROM "{self.layer}" WHERE rowid BETWEEN ? AND ? ORDER BY rowid'
            cursor = c.execute(q, (partition.lo, partition.hi))
            while rows := cursor.fetchmany(BATCH_ROWS):
                cols = [list(v) for v in zip(*rows)]
                geom = [gpkg_to_wkb(b) for b in cols.pop(gi)]
                yield record_batch(self.schema, [*cols, geom, [self.srs] * len(rows), [self.layer] * len(rows)])


class GeoPackageDataSource(DataSource):
    """``spark.read.format("gpkg").option("layer", name).load(path)``."""

    @classmethod
    def name(cls):
        return "gpkg"

    def _target(self):
        path = self.options.get("path")
        layer = self.options.get("layer")
        if layer is None:
            layers = list_layers(path)
            if len(layers) != 1:
                raise ValueError(f"choose a layer with option('layer', ...): {layers}")
            layer = layers[0]
        return path, layer

    def schema(self):
        path, layer = self._target()
        gcol, _srs, cols, *_range = layer_info(path, layer)
        fields = [StructField(n, _spark_type(t)) for n, t in cols if n != gcol]
        return layer_schema(fields)

    def reader(self, schema: StructType):
        path, layer = self._target()
        return GeoPackageReader(path, layer, schema)
