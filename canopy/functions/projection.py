"""Reprojection of geographic coordinates to EPSG:5880 as native expressions.

EPSG:5880 (SIRGAS 2000 / Brazil Polyconic): American polyconic projection on
the GRS80 ellipsoid, latitude of origin 0, central meridian -54, false
easting 5,000,000 m, false northing 10,000,000 m. Forward formulas from
Snyder (1987), *Map Projections: A Working Manual*, for the ellipsoidal
polyconic. WGS84 (EPSG:4326) is taken as SIRGAS 2000 (EPSG:4674); other
source CRSs raise. The projection is not equal-area: areas measured in it are
planar, as in the source reports.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# EPSG:5880 parameters (GRS80 ellipsoid, polyconic origin).
A = 6378137.0
INV_F = 298.257222101
LAT0 = 0.0
LON0 = -54.0
FALSE_EASTING = 5000000.0
FALSE_NORTHING = 10000000.0

TARGET_SRID = 5880
GEOGRAPHIC_SRIDS = (4674, 4326)

_F = 1.0 / INV_F
_E2 = 2 * _F - _F * _F


def _meridian_arc(phi: Column) -> Column:
    e2 = _E2
    e4, e6 = e2 * e2, e2 * e2 * e2
    return A * ((1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
                - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
                + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
                - (35 * e6 / 3072) * F.sin(6 * phi))


def polyconic_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in EPSG:5880 metres for longitude/latitude in degrees."""
    phi = F.radians(lat)
    lam = F.radians(lon - LON0)
    m0 = 0.0  # meridian arc at the latitude of origin (0)
    m = _meridian_arc(phi)
    sin_phi = F.sin(phi)
    n = A / F.sqrt(1 - _E2 * sin_phi * sin_phi)
    # ANSI mode: guard the equator (phi = 0), where the formula's limit is used.
    cot = F.cos(phi) / F.nullif(sin_phi, F.lit(0.0))
    e = lam * sin_phi
    x = F.when(phi == 0, F.lit(A) * lam).otherwise(n * cot * F.sin(e))
    y = F.when(phi == 0, F.lit(-m0)).otherwise(m - m0 + n * cot * (1 - F.cos(e)))
    return x + FALSE_EASTING, y + FALSE_NORTHING


def reproject_rings(rings: Column) -> Column:
    """Apply :func:`polyconic_xy` to every vertex of a rings column."""
    def pt(p):
        x, y = polyconic_xy(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))
    return F.transform(rings, lambda r: F.struct(r["part"].alias("part"), r["hole"].alias("hole"),
                                                 F.transform(r["pts"], pt).alias("pts")))


def reproject(df: DataFrame, srid: int, rings: str = "rings") -> DataFrame:
    """``reproject_to_sirgas``: raise without a CRS, pass 5880 through, project 4674/4326.

    The layer's CRS is a property of the layer (one value), so it is checked
    on the driver, not per row; the output carries ``srid = 5880``.
    """
    if srid is None:
        raise ValueError("layer has no CRS")
    if srid == TARGET_SRID:
        return df.withColumn("srid", F.lit(TARGET_SRID))
    if srid not in GEOGRAPHIC_SRIDS:
        raise ValueError(f"unsupported source CRS EPSG:{srid}")
    return df.withColumn(rings, reproject_rings(F.col(rings))).withColumn("srid", F.lit(TARGET_SRID))


def polyconic_sql(lon: str, lat: str) -> tuple[str, str]:
    """The same formulas as SQL text (used by the DuckDB oracle)."""
    e2 = _E2
    e4, e6 = e2 * e2, e2 * e2 * e2
    phi = f"radians({lat})"
    lam = f"radians({lon} - ({LON0}))"
    m = (f"({A} * (({1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256!r}) * {phi}"
         f" - ({3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024!r}) * sin(2 * {phi})"
         f" + ({15 * e4 / 256 + 45 * e6 / 1024!r}) * sin(4 * {phi})"
         f" - ({35 * e6 / 3072!r}) * sin(6 * {phi})))")
    n = f"({A} / sqrt(1 - {e2!r} * sin({phi}) * sin({phi})))"
    cot = f"(cos({phi}) / NULLIF(sin({phi}), 0))"
    e = f"({lam} * sin({phi}))"
    x = f"(CASE WHEN {phi} = 0 THEN {A} * {lam} ELSE {n} * {cot} * sin({e}) END + {FALSE_EASTING})"
    y = f"(CASE WHEN {phi} = 0 THEN 0 ELSE {m} + {n} * {cot} * (1 - cos({e})) END + {FALSE_NORTHING})"
    return x, y


assert math.isclose(_E2, 0.00669438002290, rel_tol=1e-9)
