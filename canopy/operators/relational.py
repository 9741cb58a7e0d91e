"""Relational helpers the layer preparation uses: stacking (U01), frequency
tables (A06, A07), mask counts (A08), PostgreSQL-style ordering (O01, O02)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concat_layers(layers: list[DataFrame], srids: list[int | None] | None = None) -> DataFrame:
    """Bag union by column name; columns missing on one side become null.

    An empty list raises ``ValueError``, as the stacking step it re-expresses
    does. ``srids`` gives the layers' CRSs, which must be one and the same. An
    ``srid`` column is checked too, when its rows are read: the first row that
    differs from the layer's declared CRS fails the query.
    """
    if not layers:
        raise ValueError("The list of layers is empty.")
    if srids is not None:
        if len(srids) != len(layers) or len(set(srids)) != 1:
            raise ValueError(f"layers to stack must share one CRS: {srids}")
        want = srids[0]
        layers = [df.withColumn("srid", F.when(F.col("srid").eqNullSafe(F.lit(want)), F.col("srid")).otherwise(
            F.raise_error(F.concat(F.lit(f"a row of a layer in EPSG:{want} has srid "), F.coalesce(F.col("srid").cast("string"), F.lit("NULL"))))))
            if "srid" in df.columns else df for df in layers]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), layers)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency per value, most frequent first, NULL left out."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
              .orderBy(F.desc("count"), F.asc(column)))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, NULL included."""
    return df.select(column).distinct()


def asc_pg(c: str | Column) -> Column:
    """Ascending with NULLs last (PostgreSQL's default; Spark's is first)."""
    return F.asc_nulls_last(c) if isinstance(c, str) else c.asc_nulls_last()


def desc_pg(c: str | Column) -> Column:
    """Descending with NULLs first (PostgreSQL's default; Spark's is last)."""
    return F.desc_nulls_first(c) if isinstance(c, str) else c.desc_nulls_first()
