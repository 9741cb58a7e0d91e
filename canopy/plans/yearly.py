"""Yearly deforestation (PRODES-style) analyses Q08-Q11."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import hectares, km2
from ..functions.scalars import size_band
from ..operators.relational import asc_pg, desc_pg
from ..operators.spatial_join import pair_count, plan_grid, spatial_join
from .layers import CAR_LABEL, FEIJO

AREA = "area_total_desmatada"


def by_subclass(prodes: DataFrame, parcels: DataFrame, ordered: bool = True) -> DataFrame:
    """Q08: per land tenure class, number of (polygon, parcel) pairs and area km2, smallest first."""
    pairs = spatial_join(prodes.withColumn("_named", F.col("id").isNotNull()), parcels.withColumnRenamed("id", "parcel_id"),
                         left_id="id", right_id="parcel_id", left_cols=["_named"], right_cols=["desc_subclass"],
                         kernel="blocks", totals_by=["desc_subclass", "_named"])
    out = pairs.groupBy("desc_subclass").agg(pair_count("_named").alias("num_eventos_desmatamento"),
                                             km2(F.sum("inter_area")).alias(AREA),
                                             F.sum("inter_area").alias("_m2"))
    return out.drop("_m2").orderBy(asc_pg(AREA)) if ordered else out


def over_10km2(prodes: DataFrame, parcels: DataFrame) -> DataFrame:
    """Q09: classes of Q08 above 10 km2 (strict), no order."""
    return by_subclass(prodes, parcels, ordered=False).where(F.col(AREA) > 10).drop("_m2")


def percent_of_total(prodes: DataFrame, parcels: DataFrame) -> DataFrame:
    """Q10: share of each kept class; the filter runs before the window, so
    the denominator is the total of the kept classes only.

    The window has no key and so runs in one task, over one row per class.
    """
    kept = by_subclass(prodes, parcels, ordered=False).where(F.col(AREA) > 10)
    # share from the exact m2 sums (same value as km2 / sum(km2), without
    # the summation-order dependence of the rounded km2 values)
    total = F.sum("_m2").over(Window.partitionBy())
    return (kept.select("desc_subclass", AREA, (F.col("_m2") / total * 100).alias("perc_total"))
            .orderBy(desc_pg("perc_total")))


def car_in_municipality(prodes: DataFrame, municipalities: DataFrame, parcels: DataFrame,
                        name: str = FEIJO, subclass: str = CAR_LABEL, geom: str | None = "geometry"
                        ) -> DataFrame:
    """Q11 (J04, J05): deforested ha per rural-registry parcel of polygons that
    meet the named municipality, with a size band; largest first.

    The municipality only filters (the area is not clipped to it), and each
    matching municipality counts once more, as in a three-way join. That
    multiplicity is pre-aggregated per polygon before the second join.
    ``geom``: WKB column of ``parcels`` to group and return with the id.
    """
    muni = municipalities.where(F.col("NM_MUN") == name).withColumnRenamed("id", "mun_id")
    hits = spatial_join(prodes, muni, left_id="id", right_id="mun_id", left_cols=[], right_cols=[],
                        with_area=False, kernel="blocks")
    weights = hits.groupBy("id").agg(F.count("*").alias("_n_mun"))
    d = prodes.join(weights, "id")
    car = parcels.where(F.col("desc_subclass") == subclass).withColumnRenamed("id", "id_malha")
    rcols = [geom] if geom else []
    # Grid statistics from the unfiltered polygons: valid for any subset of
    # them, and it avoids running the first join again just for statistics.
    plan = plan_grid(prodes, car)
    pairs = spatial_join(d, car, left_id="id", right_id="id_malha", left_cols=["_n_mun"], right_cols=rcols,
                         plan=plan, kernel="blocks")
    keys = ["id_malha"] + ([F.col(geom).alias("geom_malha")] if geom else [])
    out = (pairs.groupBy(*keys)
           .agg(hectares(F.sum(F.col("inter_area") * F.col("_n_mun"))).alias("area_desmatada_ha")))
    return (out.withColumn("classificacao_desmatamento", size_band(F.col("area_desmatada_ha")))
               .orderBy(desc_pg("area_desmatada_ha")))
