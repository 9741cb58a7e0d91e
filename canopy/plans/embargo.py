"""Embargo analyses Q12-Q18."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import M2_PER_KM2, km2, percent
from ..functions.scalars import dmy_text_year
from ..operators.relational import asc_pg, desc_pg
from ..operators.spatial_join import pair_count, spatial_join

AREA = "area_total_intersecao_km2"
MIN_PAIR_M2 = 10000.0


def add_year(embargo: DataFrame) -> DataFrame:
    """Q13: ``ano`` from the text date ``dat_embarg``."""
    return embargo.withColumn("ano", dmy_text_year(F.col("dat_embarg")))


def count_by_year(embargo: DataFrame) -> DataFrame:
    """Q14: embargoes per year, the NULL year included, ascending (NULL last)."""
    return add_year(embargo).groupBy("ano").agg(F.count("*").alias("count")).orderBy(asc_pg("ano"))


def _embargo_parcel_pairs(embargo: DataFrame, parcels: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs with more than 1 ha in common, counted and their areas summed per task by class and ``cols``."""
    return spatial_join(embargo.withColumn("_named", F.col("objectid").isNotNull()), parcels.withColumnRenamed("id", "parcel_id"),
                        left_id="objectid", right_id="parcel_id", left_cols=["_named", *cols], right_cols=["desc_subclass"],
                        kernel="blocks", totals_by=["desc_subclass", "_named", *cols], least_area=MIN_PAIR_M2)


def by_subclass(embargo: DataFrame, parcels: DataFrame) -> DataFrame:
    """Q12: pairs with more than 1 ha in common; per class, pair count and area km2."""
    return (_embargo_parcel_pairs(embargo, parcels, [])
            .groupBy("desc_subclass")
            .agg(pair_count("_named").alias("qtd_areas_embargadas"), km2(F.sum("inter_area")).alias(AREA))
            .orderBy(desc_pg(AREA)))


def by_subclass_year(embargo: DataFrame, parcels: DataFrame) -> DataFrame:
    """Q15: Q12 per class and embargo year."""
    return (_embargo_parcel_pairs(add_year(embargo), parcels, ["ano"])
            .groupBy("desc_subclass", "ano")
            .agg(pair_count("_named").alias("qtd_areas_embargadas"), km2(F.sum("inter_area")).alias(AREA))
            .orderBy(desc_pg(AREA)))


def percent_embargoed(alerts: DataFrame, embargo: DataFrame) -> DataFrame:
    """Q16: over (alert, embargo) pairs sharing more than 1 ha,
    sum(shared area) / sum(alert area) * 100. An alert meeting k embargoes
    counts k times in the denominator; NULL when no pair qualifies."""
    pairs = spatial_join(alerts.withColumn("alert_area", F.col("area")), embargo,
                         left_id="id", right_id="objectid", left_cols=["alert_area"], right_cols=[],
                         kernel="blocks", totals_by=["alert_area"], least_area=MIN_PAIR_M2)
    return pairs.agg(percent(F.sum("inter_area"), F.sum(F.col("alert_area") * F.col("n_pairs"))).alias("perc_desmat_embargado"))


def temporal_pattern(alerts: DataFrame, embargo: DataFrame) -> DataFrame:
    """Q17 (J03): alerts LEFT JOIN embargoes on intersects, per embargo year:
    rows (pairs, plus one per unmatched alert) and distinct embargoes."""
    joined = spatial_join(alerts, add_year(embargo), left_id="id", right_id="objectid",
                          how="left", left_cols=[], right_cols=["ano"], kernel="blocks", totals_by=["objectid", "ano"])
    return (joined.groupBy("ano")
            .agg(pair_count().alias("num_eventos_desmatamento"),
                 F.countDistinct("objectid").alias("num_areas_embargadas"))
            .orderBy(asc_pg("ano")))


def by_priority(embargo: DataFrame, priority: DataFrame) -> DataFrame:
    """Q18: per priority class, distinct embargoes and the sum of the *whole*
    embargo area over intersecting pairs (neither clipped nor deduplicated)."""
    pairs = spatial_join(embargo.withColumn("embargo_area", F.col("area")),
                         priority.withColumnRenamed("id", "priority_id"),
                         left_id="objectid", right_id="priority_id", left_cols=["embargo_area"],
                         right_cols=["Import_bio"], kernel="blocks", totals_by=["objectid", "embargo_area", "Import_bio"])
    return (pairs.groupBy("Import_bio")
            .agg(F.countDistinct("objectid").alias("num_areas_embargadas"),
                 (F.sum(F.col("embargo_area") * F.col("n_pairs")) / M2_PER_KM2).alias("total_area_embargadas_km2")))
