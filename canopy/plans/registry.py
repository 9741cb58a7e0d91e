"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each entry builds its layers from the driver tables of ``sf_dir`` (whole
tables, no sampling) and runs one operator or report. Areas are exact
(integer coordinates), and ratios and means are taken from exact m2 sums,
so Spark and the oracle agree bit for bit without rounding.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import area, drop_empty
from ..operators.relational import concat_layers
from ..functions.scalars import replace_values, size_band, table_name
from ..functions import projection as P
from ..functions.wkb import rings_from_wkb, wkb_from_rings
from ..functions.geometry import with_shape
from ..operators.relational import unique_values, value_counts
from ..operators.spatial_join import grid_layout, plan_grid, spatial_join
from . import alerts as qa
from . import quality as qq
from . import embargo as qe
from . import layers as L
from . import yearly as qy
from ..session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def _alerts(spark, sf):
    return L.prepared(L.alerts(spark, sf))


def _parcels(spark, sf):
    return L.prepared(L.parcels(spark, sf))


def _prodes(spark, sf):
    return L.prepared(L.prodes(spark, sf))


def _embargo(spark, sf):
    return L.prepared(L.embargo(spark, sf))


def _municipalities(spark, sf):
    return L.prepared(L.municipalities(spark, sf))


def priority_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Five biome layers stacked (U01), label fixed (D05), empties dropped."""
    stacked = concat_layers(L.priority_biomes(spark, sf))
    return L.prepared(drop_empty(replace_values(stacked, "Import_bio")))


def _q11(spark, sf):
    from ..functions.wkb import wkb_from_rings
    # only rural-registry parcels need their WKB (grouped on and returned)
    car = L.parcels(spark, sf).where(F.col("desc_subclass") == L.CAR_LABEL)
    car = L.prepared(car.withColumn("geometry", wkb_from_rings(F.col("rings"))))
    out = qy.car_in_municipality(_prodes(spark, sf), _municipalities(spark, sf), car)
    # The parcel WKB is grouped on and returned by the report; the oracle has
    # no WKB writer, so it is left out of the compared columns.
    return out.drop("geom_malha")


def _raw(spark, sf):
    return L.parcels_raw(spark, sf)


def _wkb_parcels(spark, sf):
    """Parcels through the general path: WKB written, read back, shape columns
    built from the decoded rings with array expressions."""
    p = L.parcels(spark, sf).select("id", "desc_subclass", wkb_from_rings(F.col("rings")).alias("geometry"))
    return with_shape(p.withColumn("rings", rings_from_wkb("geometry")), "rings").drop("geometry")


def _g10(spark, sf):
    c = L.read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.lit(-74.0) + (F.col("c_custkey") % 4000) / 100.0).alias("lon"),
        (F.lit(-34.0) + (F.col("c_custkey") * 7 % 3900) / 100.0).alias("lat"))
    x, y = P.polyconic_xy(F.col("lon"), F.col("lat"))
    return c.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def _j01(spark, sf):
    return spatial_join(_alerts(spark, sf), _parcels(spark, sf).withColumnRenamed("id", "parcel_id"),
                        left_id="id", right_id="parcel_id", left_cols=[], right_cols=[], kernel="blocks")


def _j02(spark, sf):
    """Embargoes lying within a state (before reprojection), state columns added."""
    st = L.prepared(L.states(spark, sf)).withColumnRenamed("id", "state_id")
    return spatial_join(_embargo(spark, sf), st, left_id="objectid", right_id="state_id",
                        predicate="within", left_cols=[], right_cols=["uf"], with_area=False, kernel="blocks")


def _j03(spark, sf):
    return spatial_join(_alerts(spark, sf), _embargo(spark, sf), left_id="id", right_id="objectid",
                        how="left", left_cols=[], right_cols=[], with_area=False, kernel="blocks")


def _j04(spark, sf):
    pr = _prodes(spark, sf)
    mun = _municipalities(spark, sf).where(F.col("NM_MUN") == L.FEIJO).withColumnRenamed("id", "mun_id")
    car = _parcels(spark, sf).where(F.col("desc_subclass") == L.CAR_LABEL).withColumnRenamed("id", "id_malha")
    a = spatial_join(pr, mun, left_id="id", right_id="mun_id", left_cols=[], right_cols=[], with_area=False, kernel="blocks")
    # only polygons that meet the municipality can be in the result; the grid's statistics are those of all
    near = pr.join(a, "id", "left_semi")
    b = spatial_join(near, car, left_id="id", right_id="id_malha", left_cols=[], right_cols=[], with_area=False, kernel="blocks",
                     plan=plan_grid(pr, car, left_keep=[], right_keep=[]))
    return a.join(b, "id")


def _g12(spark, sf):
    """Intersection area of yearly polygons with municipalities (small x large shapes)."""
    return spatial_join(_prodes(spark, sf), _municipalities(spark, sf).withColumnRenamed("id", "mun_id"),
                        left_id="id", right_id="mun_id", left_cols=[], right_cols=[], kernel="blocks")


def _g13(spark, sf):
    pri = priority_layer(spark, sf).withColumnRenamed("id", "priority_id")
    return spatial_join(_embargo(spark, sf), pri, left_id="objectid", right_id="priority_id",
                        left_cols=[], right_cols=[], with_area=False, kernel="blocks")


def _l01(spark, sf):
    g = grid_layout(_parcels(spark, sf), 1024.0)
    return g.groupBy("lvl", "cx", "cy").agg(F.count("*").alias("n"))


# Parcels in one file of the queries that write files first.
FILE_ROWS = 500


def _parcel_files(spark, sf, folder, kind):
    """Sound parcels as files of at most ``FILE_ROWS`` rows, written by tasks into the shared folder."""
    from ..sources.writers import write_files
    p = L.parcels(spark, sf)
    p = p.select("id", "desc_subclass", F.col("sigla_uf").alias("source"), wkb_from_rings(F.col("rings")).alias("geometry"))
    return write_files(p, F.concat(F.lit("parcels_"), F.floor(F.col("id") / FILE_ROWS).cast("string")), folder, kind)


def _s01(spark, sf):
    """Archives written by tasks, extracted one by one; a status row per entry."""
    from ..sources.archives import extract_archives
    folder = scratch_path(spark, "zips")
    _parcel_files(spark, sf, folder, "zip")
    done = extract_archives(spark, folder, scratch_path(spark, "unzipped"))
    return done.select("entry", "status")


def _read_files(spark, folder):
    from functools import reduce

    from ..sources.layers_io import find_layers, read_sources
    from ..sources.writers import local_path
    layers = read_sources(spark, find_layers(local_path(folder)))
    read = reduce(DataFrame.unionByName, layers).withColumn("rings", rings_from_wkb("geometry"))
    return read.select(*[c for c in ("id", "ID") if c in read.columns][:1], "desc_subclass" if "desc_subclass" in read.columns else "desc_subcl",
                       "source", "srid", "_layer", area(F.col("rings")).alias("area")).toDF("id", "desc_subclass", "source", "srid", "layer", "area")


def _s02(spark, sf):
    """Shapefiles (with an attribute named ``source``) read back."""
    folder = scratch_path(spark, "shp")
    _parcel_files(spark, sf, folder, "shp")
    return _read_files(spark, folder)


def _s03(spark, sf):
    """GeoPackages read back."""
    folder = scratch_path(spark, "gpkg")
    _parcel_files(spark, sf, folder, "gpkg")
    return _read_files(spark, folder)


def _s04(spark, sf):
    """Every layer under a folder as Parquet, then read by name; rows and CRS of each."""
    from ..sources.layers_io import convert_to_parquet, read_layers
    from ..sources.writers import local_path
    folder, out = scratch_path(spark, "gpkg"), scratch_path(spark, "layers")
    _parcel_files(spark, sf, folder, "gpkg")
    names = convert_to_parquet(spark, local_path(folder), local_path(out))
    layers = read_layers(spark, [f"{local_path(out)}/{n}.parquet" for n in names]).withColumnRenamed("_layer", "layer")
    return layers.groupBy("layer", "srid").agg(F.count("*").alias("rows"))


def _s05(spark, sf):
    """A layer written as Parquet with its CRS, read back."""
    from ..sources.layers_io import read_layer, write_layer
    path = scratch_path(spark, "layer")
    write_layer(_raw(spark, sf), path, srid=5880)
    read = read_layer(spark, path).withColumn("rings", rings_from_wkb("geometry"))
    return read.select("id", "desc_subclass", "sigla_uf", "srid", area(F.col("rings")).alias("area"))


def _s06(spark, sf):
    """Alerts as a catalog table, read back by name."""
    from ..sources.layers_io import export_table
    table = f"canopy_alerts_{uuid.uuid4().hex}"
    export_table(L.alerts(spark, sf).select("id", "UF", "CLASSNAME"), table)
    return spark.table(table)


def _s08(spark, sf):
    """One schema for each state that has alerts (at most 5 names)."""
    from ..sources.layers_io import create_schemas
    names = [r[0] for r in L.alerts(spark, sf).select(F.lower(F.concat(F.lit("canopy_"), "UF"))).distinct().collect()]
    return spark.createDataFrame(create_schemas(spark, sorted(names)), "name string, status string")


def _s09(spark, sf):
    """The geometry column of the parcels as a source file brings them."""
    from ..sources.layers_io import geometry_columns
    return geometry_columns(_raw(spark, sf), "parcels", srid=5880)


def _s10(spark, sf):
    """Column names and types of the alerts."""
    from ..sources.layers_io import column_types
    return column_types(L.alerts(spark, sf).select("id", "UF", "CLASSNAME", "VIEW_DATE"))


def _d04(spark, sf):
    """Bands of areas that lie on every boundary, between them and outside."""
    p = L.read_table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), size_band((F.col("p_partkey") % 2400) / F.lit(2.0)).alias("band"))


def _d11(spark, sf):
    """The table name of each state's alerts."""
    return L.alerts(spark, sf).select(table_name("alerts", F.col("UF")).alias("table_name")).distinct()


def _g10r(spark, sf):
    """G10 on a layer: embargo areas read as degrees, projected; the left and lower ends of their boxes."""
    e = L.embargo(spark, sf).select("objectid", F.transform("rings", lambda r: F.struct(
        r["part"].alias("part"), r["hole"].alias("hole"), F.transform(r["pts"], lambda p: F.struct(
            (F.lit(-60.0) + p["x"] / 4000.0).alias("x"), (F.lit(-20.0) + p["y"] / 4000.0).alias("y"))).alias("pts"))).alias("rings"))
    done = with_shape(P.reproject(e, 4674), "rings")
    return done.select("objectid", "srid", F.round("x0", 2).alias("x0"), F.round("y0", 2).alias("y0"))


def _g12l(spark, sf):
    """G12 with shapes of 10,002 vertices, cut into pieces first."""
    return spatial_join(_alerts(spark, sf), L.combs(spark, sf).withColumnRenamed("id", "comb_id"),
                        left_id="id", right_id="comb_id", left_cols=[], right_cols=[], max_edges=256, kernel="blocks")


def _g01l(spark, sf):
    """G01/G02 of shapes of 100,002 vertices, each spread over tasks."""
    from ..functions.validity import reason_text
    from ..operators.large_shapes import with_validity
    told = with_validity(L.long_combs(spark, sf))
    return told.select("id", F.col("validity.valid").alias("is_valid"), reason_text(F.col("validity")).alias("reason"))


def _g03l(spark, sf):
    """G03 of the same shapes: area after repair."""
    from ..operators.large_shapes import repaired
    return repaired(L.long_combs(spark, sf)).select("id", area(F.col("rings")).alias("area"))


def _vague_ids(df):
    """Ids that repeat (50 values) and some that are NULL."""
    return df.withColumn("objectid", F.when(F.col("objectid") % 7 != 0, F.col("objectid") % 50))


def _j01d(spark, sf):
    """J01 with every left row twice under ids that repeat or are NULL: each pair of rows counts."""
    e = _embargo(spark, sf)
    return spatial_join(_vague_ids(e.unionByName(e)), priority_layer(spark, sf).withColumnRenamed("id", "priority_id"),
                        left_id="objectid", right_id="priority_id", left_cols=[], right_cols=[], kernel="blocks")


def _j03d(spark, sf):
    """J03 with ids that repeat or are NULL: every left row keeps its own partners, or none."""
    return spatial_join(_vague_ids(_embargo(spark, sf)), priority_layer(spark, sf).withColumnRenamed("id", "priority_id"),
                        left_id="objectid", right_id="priority_id", how="left", left_cols=[], right_cols=[], with_area=False, kernel="blocks")


def _x02n(spark, sf):
    """X02 with a NULL key and cells that are cut again and again."""
    from ..operators.dissolve import dissolve_area
    p = priority_layer(spark, sf)
    band = F.when(F.col("id") % 3 == 1, "most").when(F.col("id") % 3 == 2, "rest")
    return dissolve_area(p.withColumn("band", band), "band", max_cell_edges=60)


def _l02(spark, sf):
    """Alerts split by state on write; a state filter reads one partition."""
    from ..sources.layers_io import export_partitioned
    path = scratch_path(spark, "alerts-by-uf")
    export_partitioned(L.alerts(spark, sf).select("id", "UF", "CLASSNAME"), "UF", path=path)
    return spark.read.parquet(path).where(F.col("UF") == "AC").select("id", "UF", "CLASSNAME")


def _x01(spark, sf):
    from ..operators.proximity import within_distance_join
    return within_distance_join(_embargo(spark, sf), priority_layer(spark, sf).withColumnRenamed("id", "priority_id"),
                                250.0, left_id="objectid", right_id="priority_id")


def _x02(spark, sf):
    from ..operators.dissolve import dissolve_area
    return dissolve_area(priority_layer(spark, sf), "Import_bio")


def _x02o(spark, sf):
    """X02's outline: area, perimeter, corners, shells less holes, and whether all polygons are valid (G01), per key."""
    from ..functions.validity import is_valid
    from ..operators.outline import dissolve_outline
    found = dissolve_outline(priority_layer(spark, sf), "Import_bio").withColumn("ok", is_valid("rings"))
    sides = F.expr("aggregate(rings, 0D, (s, r) -> s + aggregate(sequence(0, size(r.pts) - 2), 0D, (t, i) -> t +"
                   " sqrt(pow(r.pts[i + 1].x - r.pts[i].x, 2) + pow(r.pts[i + 1].y - r.pts[i].y, 2))))")
    corners = F.aggregate("rings", F.lit(0).cast("long"), lambda n, r: n + F.size(r["pts"]) - 1)
    euler = F.aggregate("rings", F.lit(0).cast("long"), lambda n, r: n + F.when(r["hole"], -1).otherwise(1))
    return found.groupBy("Import_bio").agg(F.sum("area").alias("union_area"), F.sum(sides).alias("perimeter"), F.sum(corners).alias("corners"),
                                           F.sum(euler).alias("shells_less_holes"), F.bool_and("ok").alias("all_valid"))


def _x03(spark, sf):
    from ..operators.describe import describe_layer
    return describe_layer(_parcels(spark, sf), ["area", "x0", "y0", "x1", "y1"]).withColumn("stddev", F.round("stddev", 3))


def _stacked(spark, sf):
    return concat_layers(L.priority_biomes(spark, sf))


QUERIES: dict[str, Query] = {
    "Q01": lambda s, sf: qa.area_by_subclass(_alerts(s, sf), _parcels(s, sf)),
    "Q02": lambda s, sf: qa.area_by_subclass_class(_alerts(s, sf), _parcels(s, sf)),
    "Q03": lambda s, sf: qa.add_year_month(L.prepared(L.alerts(s, sf))).select("id", "UF", "CLASSNAME", "VIEW_DATE", "ano", "mes"),
    "Q04": lambda s, sf: qa.area_by_subclass_year(_alerts(s, sf), _parcels(s, sf)),
    "Q05": lambda s, sf: qa.monthly_area(_alerts(s, sf), view=None),
    "Q06": lambda s, sf: qa.month_over_month(qa.monthly_area(_alerts(s, sf))),
    "Q07": lambda s, sf: qa.moving_average_3(qa.monthly_area(_alerts(s, sf), keep_m2=True)),
    "Q08": lambda s, sf: qy.by_subclass(_prodes(s, sf), _parcels(s, sf)),
    "Q09": lambda s, sf: qy.over_10km2(_prodes(s, sf), _parcels(s, sf)),
    "Q10": lambda s, sf: qy.percent_of_total(_prodes(s, sf), _parcels(s, sf)),
    "Q11": _q11,
    "Q12": lambda s, sf: qe.by_subclass(_embargo(s, sf), _parcels(s, sf)),
    "Q13": lambda s, sf: qe.add_year(L.embargo(s, sf)).select("objectid", "dat_embarg", "ano"),
    "Q14": lambda s, sf: qe.count_by_year(L.embargo(s, sf).select("objectid", "dat_embarg")),
    "Q15": lambda s, sf: qe.by_subclass_year(_embargo(s, sf), _parcels(s, sf)),
    "Q16": lambda s, sf: qe.percent_embargoed(_alerts(s, sf), _embargo(s, sf)),
    "Q17": lambda s, sf: qe.temporal_pattern(_alerts(s, sf), _embargo(s, sf)),
    "Q18": lambda s, sf: qe.by_priority(_embargo(s, sf), priority_layer(s, sf)),
    # geometry quality on the broken parcels layer (WKB in)
    "G01": lambda s, sf: qq.is_valid_report(_raw(s, sf)),
    "G02": lambda s, sf: qq.reason_report(_raw(s, sf)),
    "G03": lambda s, sf: qq.repaired_area(_raw(s, sf)),
    "G01L": _g01l,
    "G03L": _g03l,
    "G04": lambda s, sf: qq.validate_counts(_raw(s, sf)),
    "G05": lambda s, sf: qq.repair_preview(_raw(s, sf)),
    "G06": lambda s, sf: qq.geometry_types(_raw(s, sf)),
    "G07": lambda s, sf: qq.any_z(_raw(s, sf)),
    "G08": lambda s, sf: qq.non_empty_ids(_raw(s, sf)),
    "G09": lambda s, sf: qq.force_2d_report(_raw(s, sf)),
    "G10": _g10,
    "G10R": _g10r,
    "G11": lambda s, sf: _wkb_parcels(s, sf).select("id", "area"),
    "G12": _g12,
    "G12L": _g12l,
    "G13": _g13,
    # joins and layout
    "J01": _j01,
    "J01D": _j01d,
    "J02": _j02,
    "J03": _j03,
    "J03D": _j03d,
    "J04": _j04,
    "L01": _l01,
    # described in prose only
    "X01": _x01,
    "X02": _x02,
    "X02N": _x02n,
    "X02O": _x02o,
    "X03": _x03,
    # files
    "S01": _s01,
    "S02": _s02,
    "S03": _s03,
    "S04": _s04,
    "S05": _s05,
    "S06": _s06,
    "S08": _s08,
    "S09": _s09,
    "S10": _s10,
    "L02": _l02,
    # layer preparation
    "D04": _d04,
    "D11": _d11,
    "U01": lambda s, sf: _stacked(s, sf).select("id", "Import_bio"),
    "D05": lambda s, sf: replace_values(_stacked(s, sf), "Import_bio").select("id", "Import_bio"),
    "A07": lambda s, sf: unique_values(replace_values(_stacked(s, sf), "Import_bio"), "Import_bio"),
    "A06": lambda s, sf: value_counts(replace_values(_stacked(s, sf), "Import_bio"), "Import_bio"),
}
