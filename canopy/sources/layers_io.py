"""Layer files and tables: S04-S12, L02.

* S04 ``convert_to_parquet``: every Shapefile / GeoPackage layer under a
  folder becomes one Parquet dataset named after the file (Shapefile) or the
  layer (GeoPackage); geometry stays WKB, ``srid`` is a column and the CRS is
  also written as a GeoParquet-style ``_geo.json`` next to the data (Spark
  cannot set Parquet footer keys). Two inputs with the same name raise
  instead of silently overwriting each other (documented deviation).
* S05 ``read_layer``: Parquet layer plus its CRS (``srid`` column, the side
  file, or a GeoParquet footer read from one file's metadata).
* S06/S07/L02: catalog tables, one table per layer, split by a key with
  ``partitionBy`` (one table with a partition per value; NULL keys are kept
  in Spark's default partition rather than lost).
* S08 schemas, S09 geometry columns, S10 column types.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wkb import geom_type
from .geopackage import GeoPackageDataSource, _Rows, layer_info, list_layers
from .shapefile import ShapefileDataSource, _Range, _sidecar, srid_from_prj

GEO_SIDE_FILE = "_geo.json"
#: Layers converted at the same time.
LAYERS_AT_ONCE = 8


def register_sources(spark: SparkSession) -> None:
    """Make ``format("shapefile")`` and ``format("gpkg")`` available."""
    spark.dataSource.register(ShapefileDataSource)
    spark.dataSource.register(GeoPackageDataSource)


def find_layers(source_dir: str) -> list[tuple[str, str, str | None]]:
    """(name, path, gpkg layer) for every .shp and every GeoPackage layer under a folder.

    A directory walk on the driver: file metadata only, no data.
    """
    found = []
    for root, _dirs, files in os.walk(source_dir):
        for f in sorted(files):
            p = os.path.join(root, f)
            if f.endswith(".shp"):
                found.append((f[:-4], p, None))
            elif f.endswith(".gpkg"):
                found.extend((layer, p, layer) for layer in list_layers(p))
    return found


def read_source(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    register_sources(spark)
    if path.endswith(".shp"):
        return spark.read.format("shapefile").load(path)
    return spark.read.format("gpkg").option("layer", layer).load(path) if layer else \
        spark.read.format("gpkg").load(path)


def _source(path: str, layer: str | None):
    options = {"path": path} if layer is None else {"path": path, "layer": layer}
    return (ShapefileDataSource if path.endswith(".shp") else GeoPackageDataSource)(options)


def read_sources(spark: SparkSession, found: list[tuple[str, str, str | None]]) -> list[DataFrame]:
    """The layers that :func:`find_layers` names, as one DataFrame for each schema among them.

    Tasks read the files' headers and deal out their record ranges, so neither the plan nor what reaches the driver (the
    distinct schemas) grows with the number of files. The folder must be one that executors share as a mount.
    """
    tasks = max(1, min(len(found), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = spark.createDataFrame(found, "name string, path string, layer string").repartition(tasks)

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for path, layer in zip(files["path"], files["layer"]):
                source = _source(path, layer)
                schema = source.schema()
                parts = [(p.lo, p.hi) if isinstance(p, _Rows) else (p.start, p.stop) for p in source.reader(schema).partitions()]
                yield pd.DataFrame({"path": path, "layer": layer, "schema": schema.json(), "first": [p[0] for p in parts], "last": [p[1] for p in parts]})

    dealt = files.mapInPandas(ranges, "path string, layer string, schema string, first long, last long")

    def reader(schema: T.StructType):
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    source = _source(r["path"], r["layer"])
                    part = _Range(r["path"], r["first"], r["last"]) if r["layer"] is None else _Rows(r["first"], r["last"])
                    yield from source.reader(schema).read(part)
        return read

    kinds = sorted(r[0] for r in dealt.select("schema").distinct().collect())
    out = []
    for kind in kinds:
        schema = T.StructType.fromJson(json.loads(kind))
        mine = dealt.where(F.col("schema") == kind).select("path", "layer", "first", "last").repartition(tasks, "path", "first")
        out.append(mine.mapInArrow(reader(schema), schema))
    return out


def read_layers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Name and CRS of every row of layers written by :func:`convert_to_parquet`, in one scan whatever their other columns."""
    return spark.read.schema("_layer string, srid int").parquet(*paths)


def write_layer(df: DataFrame, path: str, srid: int | None = None, geometry: str = "geometry") -> None:
    """Write a layer as Parquet (overwrite) with its CRS side file."""
    if srid is not None and "srid" not in df.columns:
        df = df.withColumn("srid", F.lit(int(srid)))
    df.write.mode("overwrite").parquet(path)
    meta = {"version": "1.0.0", "primary_column": geometry,
            "columns": {geometry: {"encoding": "WKB", "crs": None if srid is None else f"EPSG:{srid}"}}}
    if _is_local(path):
        with open(os.path.join(_strip(path), GEO_SIDE_FILE), "w") as f:
            json.dump(meta, f)


def convert_to_parquet(spark: SparkSession, source_dir: str, output_dir: str) -> list[str]:
    """One Parquet layer per Shapefile / GeoPackage layer; returns the names written."""
    layers = find_layers(source_dir)
    names = [n for n, _p, _l in layers]
    dup = sorted({n for n in names if names.count(n) > 1})
    if dup:
        raise ValueError(f"two inputs would write the same layer: {dup}")
    register_sources(spark)

    def convert(found: tuple[str, str, str | None]) -> None:
        name, path, layer = found
        write_layer(read_source(spark, path, layer), os.path.join(output_dir, f"{name}.parquet"), source_srid(path, layer))

    # the layers' schemas differ, so each is a scan and a write of its own; several run at a time
    with ThreadPoolExecutor(LAYERS_AT_ONCE) as pool:
        list(pool.map(convert, layers))
    return names


def source_srid(path: str, layer: str | None) -> int | None:
    """The CRS that a source file's header names."""
    if layer is not None:
        return layer_info(path, layer)[1]
    prj = _sidecar(path, ".prj")
    if not prj:
        return None
    with open(prj, encoding="latin-1") as f:
        return srid_from_prj(f.read())


def _is_local(path: str) -> bool:
    return path.startswith("/") or path.startswith("file:")


def _strip(path: str) -> str:
    return path[5:] if path.startswith("file:") else path


def layer_srid(spark: SparkSession, path: str, df: DataFrame | None = None) -> int | None:
    """The layer's CRS: side file, else GeoParquet footer of one file, else None."""
    if _is_local(path):
        side = os.path.join(_strip(path), GEO_SIDE_FILE)
        if os.path.exists(side):
            meta = json.load(open(side))
        else:
            meta = None
            import pyarrow.parquet as pq
            p = _strip(path)
            files = [os.path.join(p, f) for f in sorted(os.listdir(p)) if f.endswith(".parquet")] \
                if os.path.isdir(p) else [p]
            if files:
                kv = pq.read_metadata(files[0]).metadata or {}
                if b"geo" in kv:
                    meta = json.loads(kv[b"geo"])
        if meta:
            col = meta["columns"][meta["primary_column"]]
            crs = col.get("crs")
            if isinstance(crs, str) and crs.upper().startswith("EPSG:"):
                return int(crs.split(":")[1])
            if isinstance(crs, dict):
                ident = crs.get("id", {})
                if ident.get("authority") == "EPSG":
                    return int(ident["code"])
            if crs is None and "crs" not in col:
                return 4326     # GeoParquet default when the key is absent
    return None


def read_layer(spark: SparkSession, path: str, srid: int | None = None) -> DataFrame:
    """Read a Parquet layer; ``srid`` column from the data, the CRS metadata, or the argument."""
    df = spark.read.parquet(path)
    if "srid" in df.columns:
        return df
    found = layer_srid(spark, path) if srid is None else srid
    if found is None:
        raise ValueError(f"layer {path} has no CRS; pass srid=")
    return df.withColumn("srid", F.lit(int(found)))


def create_schemas(spark: SparkSession, names: list[str]) -> list[tuple[str, str]]:
    """CREATE SCHEMA IF NOT EXISTS for each name; errors are reported, not raised."""
    out = []
    for n in names:
        try:
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{n}`")
            out.append((n, "ok"))
        except Exception as e:  # reported per schema, as the source step does
            out.append((n, f"error: {e}"))
    return out


def export_table(df: DataFrame, table: str, schema: str | None = None) -> None:
    """Replace a catalog table with the layer."""
    name = f"`{schema}`.`{table}`" if schema else f"`{table}`"
    df.write.mode("overwrite").saveAsTable(name)


def export_partitioned(df: DataFrame, column: str, path: str | None = None, table: str | None = None) -> None:
    """One dataset split by ``column`` (a directory per value).

    Queries filtering on ``column`` then read only the matching directories.
    Rows with a NULL key are kept (in Spark's default partition). Rows are
    brought together by key only as far as their size allows: Spark rebalances
    the partitions, so a hot key is written by several tasks and small keys
    share one.
    """
    w = df.hint("rebalance", column).write.mode("overwrite").partitionBy(column)
    if table:
        w.saveAsTable(table)
    else:
        w.parquet(path)


def geometry_columns(df: DataFrame, table: str, srid: int | None = None) -> DataFrame:
    """Table, geometry column, SRID and geometry type(s), one row per binary column."""
    spark = df.sparkSession
    out = None
    for f in df.schema.fields:
        if f.dataType.simpleString() != "binary":
            continue
        srid_col = F.max("srid") if "srid" in df.columns else F.lit(srid).cast("int")
        row = df.agg(F.lit(table).alias("f_table_name"), F.lit(f.name).alias("f_geometry_column"),
                     srid_col.alias("srid"),
                     F.array_join(F.array_sort(F.collect_set(geom_type(f.name))), ",").alias("type"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        return spark.createDataFrame([], "f_table_name string, f_geometry_column string, srid int, type string")
    return out


def column_types(df: DataFrame, column: str | None = None) -> DataFrame:
    """(column_name, data_type) from the schema (metadata, no scan)."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if column in (None, f.name)]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string")
