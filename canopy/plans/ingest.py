"""Layer preparation flows, each one lazy plan per layer.

* embargo areas: drop null geometry, repair invalid shapes, drop what stays
  invalid (G04) -> keep shapes lying within a state (J02, before
  reprojection, both layers in the same CRS) -> reproject to EPSG:5880 (G10)
  -> write (S06/S04).
* priority areas: stack the biome layers (U01) -> fix the label (D05) ->
  drop empty shapes (G08) -> 2D (G09, by decoding) -> reproject (G10) ->
  write, split by a key (S07).
* other layers: reproject -> write split by a key (S07/L02).

Input layers carry WKB ``geometry``; the flows decode it once into
``rings`` and derive the shape columns (edges, box, area) used by the
reports, writing them with the layer so no report repeats the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import drop_empty, with_shape
from ..functions.projection import reproject
from ..functions.scalars import replace_values
from ..functions.validity import validate_layer
from ..functions.wkb import rings_from_wkb, wkb_from_rings
from ..operators.relational import concat_layers
from ..operators.spatial_join import spatial_join, spread


def _decoded(df: DataFrame) -> DataFrame:
    return spread(df).withColumn("rings", rings_from_wkb("geometry"))


def _finish(df: DataFrame) -> DataFrame:
    """Re-encode the (repaired, reprojected) rings and add the shape columns."""
    out = df.withColumn("geometry", wkb_from_rings(F.col("rings")))
    return with_shape(out, "rings", drop_rings=True)


def prepare_embargo(embargo: DataFrame, states: DataFrame, srid: int, id_col: str = "objectid",
                    state_id: str = "state_id", states_srid: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Embargo flow; returns ``(layer, validation_counts)``.

    ``states`` is a raw states layer (WKB ``geometry`` plus attributes) in the
    same CRS as ``embargo`` (``srid``); its columns are added to each embargo
    lying within a state (a shape within k states appears k times). The join
    runs before reprojection, so a states layer in another CRS
    (``states_srid``) raises instead of joining mismatched coordinates.
    """
    if states_srid is not None and states_srid != srid:
        raise ValueError(f"within-join across CRSs: embargo EPSG:{srid}, states EPSG:{states_srid}")
    clean, counts = validate_layer(_decoded(embargo))
    shaped = with_shape(clean, "rings", drop_rings=False)
    st = with_shape(_decoded(states).drop("geometry"), "rings")
    st_cols = [c for c in st.columns if c not in ("edges", "x0", "y0", "x1", "y1", "area", state_id)]
    inside = spatial_join(shaped.drop("geometry"), st, left_id=id_col, right_id=state_id, predicate="within",
                          right_cols=st_cols, left_cols=[c for c in shaped.columns if c not in (
                              "edges", "x0", "y0", "x1", "y1", "area", id_col, "geometry")], with_area=False)
    return _finish(reproject(inside, srid)), counts


def prepare_priority(biomes: list[DataFrame], srid: int, label: str = "Import_bio") -> DataFrame:
    """Priority-area flow: stack, relabel, drop empties, 2D, reproject."""
    stacked = replace_values(concat_layers(biomes, [srid] * len(biomes)), label)
    return _finish(reproject(drop_empty(_decoded(stacked)), srid))


def prepare_layer(df: DataFrame, srid: int) -> DataFrame:
    """Any other layer: decode, reproject, add the shape columns."""
    return _finish(reproject(_decoded(df), srid))
