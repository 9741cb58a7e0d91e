"""Descriptive statistics of a layer's numeric columns.

One aggregate pass computes count, nulls, mean, standard deviation, min and
max for every numeric column (all mergeable, so map-side partial
aggregation applies); quartiles use ``percentile_approx`` (bounded memory
per task — an exact percentile would gather a whole column into one task).
Output: one row per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

STATS = ("count", "nulls", "mean", "stddev", "min", "q1", "median", "q3", "max")


def describe_layer(df: DataFrame, columns: list[str] | None = None, accuracy: int = 10000) -> DataFrame:
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        q = F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"),
                             F.count_if(x.isNull()).alias("nulls"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("stddev"), F.min(x).alias("min"),
                             q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
                             F.max(x).alias("max")).alias(c))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(c) for c in cols])).alias("s")).select("s.*")
