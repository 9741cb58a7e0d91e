"""Sources and sinks (S01-S10, L02) on files written by the tests."""
import os
import tempfile
import zipfile

import pytest
from pyspark.sql import functions as F

from canopy.functions.geometry import with_shape
from canopy.functions.wkb import rings_from_wkb
from canopy.sources import layers_io as IO
from canopy.sources.archives import extract_archives
from filefixtures import write_gpkg, write_shapefile

SQ_CW = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]          # shell, clockwise
HOLE_CCW = [(3, 3), (7, 3), (7, 7), (3, 7), (3, 3)]           # hole, counter-clockwise
SQ2_CW = [(20, 0), (20, 4), (24, 4), (24, 0), (20, 0)]
FIELDS = [("ID", "N", 10, 0), ("NM_MUN", "C", 30, 0), ("VAL", "N", 12, 3)]
RECORDS = [([SQ_CW, HOLE_CCW], [1, "Feijó", 1.5]), ([SQ2_CW], [2, "Rio Branco", None]), (None, [3, "Sem forma", 2.0])]


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="canopy-src-")


def _areas(df):
    shaped = with_shape(df.withColumn("rings", rings_from_wkb("geometry")), "rings")
    return {r[0]: r[1] for r in shaped.select(df.columns[0], "area").collect()}


def test_shapefile_source(spark, workdir):
    base = os.path.join(workdir, "municipios")
    write_shapefile(base, RECORDS, FIELDS)
    IO.register_sources(spark)
    df = spark.read.format("shapefile").load(base + ".shp")
    assert df.columns == ["ID", "NM_MUN", "VAL", "geometry", "srid", "_layer"]
    rows = sorted(df.collect(), key=lambda r: r["ID"])
    assert [(r["ID"], r["NM_MUN"], r["VAL"], r["srid"]) for r in rows] == [
        (1, "Feijó", 1.5, 5880), (2, "Rio Branco", None, 5880), (3, "Sem forma", 2.0, 5880)]
    assert rows[2]["geometry"] is None
    assert _areas(df) == {1: 84.0, 2: 16.0, 3: None}


def test_geopackage_source_two_layers(spark, workdir):
    path = os.path.join(workdir, "areas.gpkg")
    write_gpkg(path, {"biomas": [(1, "Amazônia", [[(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)]])],
                      "estados": [(1, "AC", [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]]), (2, "AM", None)]})
    assert IO.list_layers(path) == ["biomas", "estados"]
    IO.register_sources(spark)
    with pytest.raises(Exception):
        spark.read.format("gpkg").load(path).collect()     # two layers: the layer must be named
    est = spark.read.format("gpkg").option("layer", "estados").load(path)
    assert [(r["fid"], r["nome"], r["srid"], r["_layer"]) for r in est.orderBy("fid").collect()] == [
        (1, "AC", 5880, "estados"), (2, "AM", 5880, "estados")]
    assert _areas(est) == {1: 4.0, 2: None}


def test_zip_extract_and_convert(spark, workdir):
    raw, out, pq = (os.path.join(workdir, d) for d in ("raw", "extracted", "output"))
    os.makedirs(raw)
    staging = os.path.join(workdir, "staging")
    os.makedirs(staging)
    write_shapefile(os.path.join(staging, "limites"), RECORDS, FIELDS)
    with zipfile.ZipFile(os.path.join(raw, "limites.zip"), "w") as z:
        for f in os.listdir(staging):
            z.write(os.path.join(staging, f), f)
    write_gpkg(os.path.join(staging, "areas.gpkg"), {"biomas": [(1, "Pampa", [[(0, 0), (5, 0), (5, 5), (0, 0)]])]})
    with zipfile.ZipFile(os.path.join(raw, "areas.zip"), "w") as z:
        z.write(os.path.join(staging, "areas.gpkg"), "areas.gpkg")
    with open(os.path.join(raw, "broken.zip"), "wb") as f:
        f.write(b"not a zip")
    with open(os.path.join(raw, "notes.txt"), "w") as f:
        f.write("ignored")
    status = extract_archives(spark, raw, out).collect()
    by = {}
    for r in status:
        by.setdefault(os.path.basename(r["path"]), []).append(r["status"])
    assert by["broken.zip"] == ["bad_archive"]
    assert set(by["limites.zip"]) == {"ok"} and len(by["limites.zip"]) == 5
    assert by["areas.zip"] == ["ok"] and "notes.txt" not in by
    assert os.path.exists(os.path.join(out, "limites", "limites.shp"))
    missing = extract_archives(spark, os.path.join(workdir, "nope"), out).collect()
    assert [r["status"] for r in missing] == ["error"]

    names = IO.convert_to_parquet(spark, out, pq)
    assert sorted(names) == ["biomas", "limites"]
    lim = IO.read_layer(spark, os.path.join(pq, "limites.parquet"))
    assert lim.count() == 3 and lim.select("srid").distinct().collect()[0][0] == 5880
    assert IO.layer_srid(spark, os.path.join(pq, "limites.parquet")) == 5880
    bio = spark.read.parquet(os.path.join(pq, "biomas.parquet")).drop("srid")
    assert bio.count() == 1
    bare = os.path.join(workdir, "no_crs.parquet")
    bio.write.parquet(bare)
    with pytest.raises(ValueError):
        IO.read_layer(spark, bare)
    assert IO.read_layer(spark, bare, srid=4674).first()["srid"] == 4674


def test_duplicate_layer_names_raise(spark, workdir):
    for sub in ("a", "b"):
        os.makedirs(os.path.join(workdir, sub))
        write_shapefile(os.path.join(workdir, sub, "same"), RECORDS[:1], FIELDS)
    with pytest.raises(ValueError):
        IO.convert_to_parquet(spark, workdir, os.path.join(workdir, "out"))


def test_partitioned_export_keeps_null_keys_and_prunes(spark, workdir):
    df = spark.createDataFrame([(1, "AC"), (2, "AM"), (3, None), (4, "AC")], "id long, UF string")
    path = os.path.join(workdir, "alerts_by_uf")
    IO.export_partitioned(df, "UF", path=path)
    back = spark.read.parquet(path)
    assert back.count() == 4
    ac = back.where(F.col("UF") == "AC")
    assert sorted(r["id"] for r in ac.collect()) == [1, 4]
    plan = ac._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "UF" in plan


def test_catalog_helpers(spark, workdir):
    res = IO.create_schemas(spark, ["ibge", "inpe"])
    assert res == [("ibge", "ok"), ("inpe", "ok")]
    df = spark.createDataFrame([(1, bytearray(b"\x01\x03\x00\x00\x00\x00\x00\x00\x00"), 5880)],
                               "id long, geometry binary, srid int")
    IO.export_table(df, "estados_br", "ibge")
    assert spark.table("ibge.estados_br").count() == 1
    gc = IO.geometry_columns(spark.table("ibge.estados_br"), "estados_br").collect()
    assert [(r["f_table_name"], r["f_geometry_column"], r["srid"], r["type"]) for r in gc] == [
        ("estados_br", "geometry", 5880, "Polygon")]
    ct = IO.column_types(df, "srid").collect()
    assert [(r[0], r[1]) for r in ct] == [("srid", "int")]
