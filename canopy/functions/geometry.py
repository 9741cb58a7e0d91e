"""Geometry as columns: rings -> oriented edges, bounding box, area.

A polygon or multipolygon is held as

``rings``: ARRAY<STRUCT<part INT, hole BOOLEAN, pts ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>

(closed rings, first point repeated last, as in WKB). Everything here is a
native Catalyst expression (higher-order functions over small arrays), so
no Python worker is involved when a layer is prepared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("hole", T.BooleanType()),
    T.StructField("pts", T.ArrayType(POINT)),
])
RINGS = T.ArrayType(RING)
EDGE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("ax", "ay", "bx", "by")])
EDGES = T.ArrayType(EDGE)

# Columns a prepared shape layer carries next to its attributes.
SHAPE_COLUMNS = ("edges", "x0", "y0", "x1", "y1", "area")

# m2 -> km2, m2 -> ha, ratio -> percent.
M2_PER_KM2 = 1_000_000.0
M2_PER_HA = 10_000.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(pts: list[Column], part: int | Column = 0, hole: bool | Column = False) -> Column:
    """One closed ring from a list of point columns (closing point added)."""
    return F.struct(F.lit(part).cast("int").alias("part") if not isinstance(part, Column) else part.alias("part"),
                    F.lit(hole).alias("hole") if not isinstance(hole, Column) else hole.alias("hole"),
                    F.array(*pts, pts[0]).alias("pts"))


def _ring_area2(pts: Column) -> Column:
    """Twice the signed area of a closed ring, relative to its first vertex.

    Shifting to the first vertex keeps large projected coordinates (false
    northing 10,000,000) from cancelling; integer inputs stay exact.
    """
    x0, y0 = pts[0]["x"], pts[0]["y"]
    idx = F.sequence(F.lit(0), F.size(pts) - 2)
    return F.when(F.size(pts) >= 2, F.aggregate(
        idx, F.lit(0.0),
        lambda acc, i: acc + ((pts[i]["x"] - x0) * (pts[i + 1]["y"] - y0)
                              - (pts[i + 1]["x"] - x0) * (pts[i]["y"] - y0)))).otherwise(F.lit(0.0))


def oriented_rings(rings: Column) -> Column:
    """Shells counter-clockwise, holes clockwise (reverse where needed)."""
    return F.transform(rings, lambda r: F.struct(
        r["part"].alias("part"), r["hole"].alias("hole"),
        F.when((_ring_area2(r["pts"]) > 0) == r["hole"], F.reverse(r["pts"]))
         .otherwise(r["pts"]).alias("pts")))


def edges_of(rings: Column) -> Column:
    """All edges of all rings, oriented (shell CCW, hole CW), vertical ones included."""
    def ring_edges(r):
        pts = r["pts"]
        return F.when(F.size(pts) >= 2, F.transform(
            F.sequence(F.lit(0), F.size(pts) - 2),
            lambda i: F.struct(pts[i]["x"].alias("ax"), pts[i]["y"].alias("ay"),
                               pts[i + 1]["x"].alias("bx"), pts[i + 1]["y"].alias("by")))
        ).otherwise(F.array().cast(EDGES))
    return F.flatten(F.transform(oriented_rings(rings), ring_edges))


def _held(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once: named outright inside a lambda it would be computed for every element."""
    return F.transform(F.array(value), f)[0]


def area_of_edges(edges: Column, x0: Column, y0: Column) -> Column:
    """Shoelace over oriented edges, shifted to (x0, y0): holes subtract, parts add."""
    return _held(F.struct(edges.alias("edges"), x0.alias("x0"), y0.alias("y0")), lambda s: F.aggregate(s["edges"], F.lit(0.0), lambda acc, e: acc + (
        (e["ax"] - s["x0"]) * (e["by"] - s["y0"]) - (e["bx"] - s["x0"]) * (e["ay"] - s["y0"]))) / 2.0)


def with_shape(df: DataFrame, rings: str = "rings", drop_rings: bool = True) -> DataFrame:
    """Add ``edges``, the box ``x0..y1`` and ``area`` from a rings column.

    Null geometry gives null everywhere; an empty geometry gives no edges, a
    null box and area 0 (as PostGIS reports for an empty polygon).
    """
    e = edges_of(F.col(rings))
    out = df.withColumn("edges", e)
    xs = F.transform("edges", lambda s: s["ax"])
    ys = F.transform("edges", lambda s: s["ay"])
    out = (out.withColumn("x0", F.array_min(xs)).withColumn("y0", F.array_min(ys))
              .withColumn("x1", F.array_max(xs)).withColumn("y1", F.array_max(ys)))
    out = out.withColumn("area", area_of_edges(F.col("edges"), F.coalesce("x0", F.lit(0.0)),
                                               F.coalesce("y0", F.lit(0.0))))
    if drop_rings:
        out = out.drop(rings)
    return out


def area(rings: Column) -> Column:
    """G11 as a plain column expression over a rings column."""
    def of(e: Column) -> Column:
        least = (lambda k: F.coalesce(F.array_min(F.transform(e, lambda s: s[k])), F.lit(0.0)))
        return area_of_edges(e, least("ax"), least("ay"))
    return _held(edges_of(rings), of)


def km2(c: Column) -> Column:
    return c / M2_PER_KM2


def hectares(c: Column) -> Column:
    return c / M2_PER_HA


def percent(num: Column, den: Column) -> Column:
    """num / den * 100 with a zero denominator giving NULL (Spark is ANSI: x/0 raises)."""
    return num / F.nullif(den, F.lit(0.0)) * 100.0


def is_empty(rings: Column) -> Column:
    """True for a geometry with no points; NULL for null geometry."""
    return F.aggregate(rings, F.lit(0), lambda acc, r: acc + F.size(r["pts"])) == 0


def drop_empty(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Keep non-empty rows; null geometry is kept (it is not empty)."""
    return df.filter(~F.coalesce(is_empty(F.col(rings)), F.lit(False)))
