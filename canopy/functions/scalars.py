"""Scalar column functions: dates (D01, D02), size bands (D04), relabel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_month(df: DataFrame, ts: str, year: str = "ano", month: str = "mes") -> DataFrame:
    """Integer year and month of a date or timestamp column."""
    return df.withColumn(year, F.year(ts).cast("int")).withColumn(month, F.month(ts).cast("int"))


def dmy_text_year(text: Column) -> Column:
    """Year of a ``DD-MM-YY HH24:MI:SS`` text date, read the PostgreSQL way.

    The third number is the year; one or two digits go to the year nearest
    2020 (70-99 -> 19xx, 00-69 -> 20xx), longer ones pass as they are. Any
    separator is accepted and the time may be missing. Day and month are
    checked through a real date; text that is not a date gives NULL.
    Spark's own ``yy`` pattern would read 98 as 2098 and reject four digits.
    """
    nums = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    ytxt = F.when(F.size(nums) >= 3, nums[2])
    yy = ytxt.cast("int")
    year = F.when(F.length(ytxt) <= 2, yy + F.when(yy >= 70, F.lit(1900)).otherwise(F.lit(2000))).otherwise(yy)
    iso = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"),
                      F.lpad(nums[1], 2, "0"), F.lpad(nums[0], 2, "0"))
    return F.year(F.try_to_date(F.when(F.size(nums) >= 3, iso), "yyyy-MM-dd")).cast("int")


# The five size bands of the yearly-deforestation report, in
# order; the first matching BETWEEN wins and everything else (below 1, above
# 1000, NULL) takes the last label.
SIZE_BANDS = [
    (1, 10, "1-10 ha"),
    (10, 50, "10-50 ha"),
    (50, 100, "50-100 ha"),
    (100, 500, "100-500 ha"),
    (500, 1000, "500-1000 ha"),
]
SIZE_BAND_ELSE = "1000-5000 ha"


def size_band(ha: Column) -> Column:
    """CASE over overlapping inclusive ranges, first match wins."""
    expr = None
    for lo, hi, label in SIZE_BANDS:
        cond = ha.between(lo, hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(SIZE_BAND_ELSE))


# The label fix applied to the stacked priority-area layer.
IMPORT_BIO_FIX = {"Muita Alta": "Muito Alta"}


def replace_values(df: DataFrame, column: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Exact-match replace of values in one column."""
    return df.replace(mapping or IMPORT_BIO_FIX, subset=[column])


def table_name(prefix: str, value: Column) -> Column:
    """``lower(prefix_value)`` table naming of a split layer."""
    return F.lower(F.concat_ws("_", F.lit(prefix), value))
