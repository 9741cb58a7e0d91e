"""Pairs of shapes within a distance (the analytic use of a buffer).

Candidate pairs come from the grid join run on the left boxes grown by
``d``; the exact test is then: the shapes intersect, or their boundaries
come within ``d`` (least edge-to-edge distance, compared squared so integer
inputs stay exact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_join import near_pairs
from .spatial_join import plan_grid


def within_distance_join(left: DataFrame, right: DataFrame, distance: float, *, left_id: str, right_id: str,
                         left_cols: list[str] | None = None, right_cols: list[str] | None = None,
                         cell_size: float | None = None) -> DataFrame:
    """Pairs (left_id, right_id, distance) with shapes at most ``distance`` apart."""
    d = float(distance)
    grown = (left.withColumn("x0", F.col("x0") - d).withColumn("y0", F.col("y0") - d)
                 .withColumn("x1", F.col("x1") + d).withColumn("y1", F.col("y1") + d))
    lcols = list(left_cols or [])
    rcols = list(right_cols or [])
    plan = plan_grid(grown, right, cell_size, lcols, rcols)
    pairs = near_pairs(grown, right, left_id, right_id, lcols, rcols, plan, d)
    return pairs.select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id),
                        *[F.col(f"l_c_{c}").alias(c) for c in lcols],
                        *[F.col(f"r_c_{c}").alias(c) for c in rcols], "distance")
