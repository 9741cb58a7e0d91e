"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import ensure_checkpoint_dir

#: Rows handled at once inside a Python task; Spark bounds an Arrow batch by bytes.
SLICE_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later stages, and tasks retried after an executor is
    lost, read the files and never recompute what made them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: whatever they are called, they clash with no name of an operator."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches, a bounded number at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def ranked(df: DataFrame, key: str, order: list[str], salt: Column, name: str = "rank") -> DataFrame:
    """Add ``name``: gapless numbers from 0 within each ``key``.

    A key may hold any share of the rows, so rows are numbered within
    (key, salt) and shifted by the number of rows in the key's lower salts;
    the counts are pre-aggregated before their shuffle. ``df`` is read twice
    and must give the same salts each time (a written table does).
    """
    parts = df.withColumn("_salt", salt)
    before = W.partitionBy(key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    shift = (parts.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
             .select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
    own = W.partitionBy(key, "_salt").orderBy(*order)
    return (parts.withColumn("_own", F.row_number().over(own))
            .join(shift, [key, "_salt"])
            .withColumn(name, F.col("_own") + F.col("_shift") - 1)
            .drop("_own", "_shift", "_salt"))
