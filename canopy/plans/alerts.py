"""Alert (DETER-style) analyses Q01-Q07.

Inputs are prepared shape layers (see :mod:`canopy.plans.layers`):
``alerts`` (id, UF, CLASSNAME, VIEW_DATE, shape) and ``parcels`` (id,
desc_subclass, sigla_uf, shape).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import km2, percent
from ..functions.scalars import year_month
from ..operators.relational import asc_pg, desc_pg
from ..operators.spatial_join import spatial_join

AREA_KM2 = "area_desmatada_km2"


def _alert_parcel_pairs(alerts: DataFrame, parcels: DataFrame, alert_cols: list[str]) -> DataFrame:
    """J01 alerts x parcels: the exact areas of intersecting pairs, summed per task by class and ``alert_cols``."""
    return spatial_join(alerts, parcels.withColumnRenamed("id", "parcel_id"),
                        left_id="id", right_id="parcel_id", kernel="blocks",
                        left_cols=alert_cols, right_cols=["desc_subclass"], totals_by=["desc_subclass", *alert_cols])


def area_by_subclass(alerts: DataFrame, parcels: DataFrame) -> DataFrame:
    """Q01: intersection area per land tenure class, km2, largest first."""
    return (_alert_parcel_pairs(alerts, parcels, [])
            .groupBy("desc_subclass").agg(km2(F.sum("inter_area")).alias(AREA_KM2))
            .orderBy(desc_pg(AREA_KM2)))


def area_by_subclass_class(alerts: DataFrame, parcels: DataFrame) -> DataFrame:
    """Q02: as Q01, per land tenure class and alert class."""
    return (_alert_parcel_pairs(alerts, parcels, ["CLASSNAME"])
            .groupBy("desc_subclass", "CLASSNAME").agg(km2(F.sum("inter_area")).alias(AREA_KM2))
            .orderBy(desc_pg(AREA_KM2)))


def add_year_month(alerts: DataFrame) -> DataFrame:
    """Q03: integer ``ano`` and ``mes`` from ``VIEW_DATE``."""
    return year_month(alerts, "VIEW_DATE")


def area_by_subclass_year(alerts: DataFrame, parcels: DataFrame) -> DataFrame:
    """Q04: as Q01, per land tenure class and alert year."""
    a = add_year_month(alerts)
    return (_alert_parcel_pairs(a, parcels, ["ano"])
            .groupBy("desc_subclass", "ano").agg(km2(F.sum("inter_area")).alias(AREA_KM2))
            .orderBy(desc_pg(AREA_KM2)))


def monthly_area(alerts: DataFrame, view: str | None = "desmatamento_por_mes",
                 keep_m2: bool = False) -> DataFrame:
    """Q05: whole alert area per (ano, mes), km2; kept as a cached temp view.

    The result has at most 12 rows per year, so caching it is bounded.
    ``keep_m2`` also keeps the m2 sum, from which Q06/Q07 derive their
    ratios and means without re-rounding km2 values.
    """
    out = (add_year_month(alerts).groupBy("ano", "mes")
           .agg(km2(F.sum("area")).alias("area_desmatada"), F.sum("area").alias("area_m2")))
    if not keep_m2:
        out = out.drop("area_m2")
    if view:
        out = out.cache()
        out.createOrReplaceTempView(view)
    return out


def _by_year() -> Window:
    return Window.partitionBy("ano").orderBy("mes")


def month_over_month(monthly: DataFrame) -> DataFrame:
    """Q06: previous month of the same year (by row) and percent change."""
    prev = F.lag("area_desmatada", 1).over(_by_year())
    return (monthly.select("ano", "mes", "area_desmatada", prev.alias("desmatamento_anterior"))
            .withColumn("variacao_percentual",
                        percent(F.col("area_desmatada") - F.col("desmatamento_anterior"),
                                F.col("desmatamento_anterior")))
            .orderBy(asc_pg("ano"), asc_pg("mes")))


def moving_average_3(monthly: DataFrame) -> DataFrame:
    """Q07: mean of the current and two preceding rows within the year."""
    w = _by_year().rowsBetween(-2, Window.currentRow)
    src = "area_m2" if "area_m2" in monthly.columns else "area_desmatada"
    mean = F.avg(src).over(w)
    if src == "area_m2":
        mean = km2(mean)
    return (monthly.select("ano", "mes", "area_desmatada", mean.alias("media_movel_3meses"))
            .orderBy(asc_pg("ano"), asc_pg("mes")))
