"""Layer preparation and quality checks as registered reports.

Each function takes the raw layer (WKB ``geometry`` column, as read from a
GeoParquet file) and returns a DataFrame; the same steps compose into the
layer preparation flows of :mod:`canopy.plans.ingest`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import validity as V
from ..functions import wkb as W
from ..functions.geometry import area, drop_empty
from ..operators.spatial_join import spread


def decoded(raw: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Add 2D ``rings`` decoded from the WKB column (Z and M dropped).

    The per-geometry helpers that follow run in Python workers, so a layer
    arriving in fewer partitions than the cluster has cores is spread first.
    """
    return spread(raw).withColumn("rings", W.rings_from_wkb(geometry))


def is_valid_report(raw: DataFrame) -> DataFrame:
    """Id and validity (NULL for null geometry)."""
    return decoded(raw).select("id", V.is_valid("rings").alias("is_valid"))


def reason_report(raw: DataFrame) -> DataFrame:
    """Id and reason of every invalid row."""
    return V.invalid_reasons(decoded(raw), "id")


def repaired_area(raw: DataFrame) -> DataFrame:
    """Area after repair of every row (valid rows unchanged, null stays null)."""
    fixed = decoded(raw).withColumn("_fixed", V.make_valid("rings"))
    return fixed.select("id", area(F.col("_fixed")).alias("area"))


def validate_counts(raw: DataFrame) -> DataFrame:
    """Invalid before, invalid after, rows kept."""
    _clean, counts = V.validate_layer(decoded(raw))
    return counts


def repair_preview(raw: DataFrame) -> DataFrame:
    """Per invalid row: valid before, valid after repair, reason."""
    return V.repair_preview(decoded(raw), "id")


def geometry_types(raw: DataFrame) -> DataFrame:
    """Distinct geometry types (from the WKB header, no decoding)."""
    return raw.select(W.geom_type("geometry").alias("geom_type")).distinct()


def any_z(raw: DataFrame) -> DataFrame:
    """Does any geometry carry Z."""
    return raw.agg(F.bool_or(W.has_z("geometry")).alias("has_z"))


def non_empty_ids(raw: DataFrame) -> DataFrame:
    """Rows left after dropping empty geometry (null geometry is kept)."""
    return drop_empty(decoded(raw)).select("id")


def force_2d_report(raw: DataFrame) -> DataFrame:
    """Z flag before and after writing the WKB in two dimensions, and the vertices read back from it."""
    flat = raw.select("id", "geometry", W.force_2d("geometry").alias("_flat"))
    points = F.aggregate(W.rings_from_wkb("_flat"), F.lit(0), lambda n, r: n + F.size(r["pts"]))
    return flat.select("id", W.has_z("geometry").alias("has_z_before"), W.has_z("_flat").alias("has_z_after"), points.alias("points"))
