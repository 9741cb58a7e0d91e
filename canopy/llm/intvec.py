"""Vectors as whole numbers, floor(256 * x), and their exact inner products: what the searches by integer score share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

SCALE = 256.0
#: Whole numbers below this are exact as 4-byte floats; sums below EXACT are as doubles.
NARROW, EXACT = float(1 << 24), float(1 << 53)
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


def integer_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(row numbers, lengths, packed components) of the rows that hold a vector: not null or empty, no null or non-finite component.

    A row is packed as 4-byte floats if these hold it exactly, else as doubles; its length in bytes tells which.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(SCALE * pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64))
        narrow = flat.astype(np.float32)

    def held(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[end] - total[end - size]

    rows = np.nonzero((size > 0) & (held(~np.isfinite(flat)) == 0))[0]
    wide = held(np.abs(flat) >= NARROW) > 0
    short, long = narrow.tobytes(), flat.tobytes() if wide.any() else b""
    packed = [long[8 * (end[r] - size[r]):8 * end[r]] if wide[r] else short[4 * (end[r] - size[r]):4 * end[r]] for r in rows]
    return rows, size[rows], packed


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label: Column | None = None) -> DataFrame:
    """(id, label, dim, vec, row) of the rows that hold a vector; ``row`` numbers them once the table is written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            rows, dims, packed = integer_rows(b.column(2))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())],
                                             names=["id", "label", "dim", "vec"])

    label = F.lit(None) if label is None else label
    return (vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vec_col).alias("vec"))
            .mapInArrow(run, "id long, label string, dim int, vec binary").withColumn("row", F.monotonically_increasing_id()))


def apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that two sides made from one table can be told apart."""
    return df.toDF(*df.columns)


def matrix(packed: list[bytes], dim: int) -> np.ndarray:
    """The packed vectors of length ``dim`` as rows of doubles."""
    if all(len(p) == 4 * dim for p in packed):
        return np.frombuffer(b"".join(packed), np.float32).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(p, np.float32 if len(p) == 4 * dim else np.float64).astype(np.float64) for p in packed])


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``q`` with those of ``x``; beyond a long's range, the range's ends."""
    most = x.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0)
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    return np.clip(_whole(q) @ _whole(x).T, LEAST, MOST).astype(np.int64)


def pair_products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same of the pairs (q[i], x[j]) alone."""
    out = np.zeros(len(i), np.int64)
    exact = x.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < EXACT
    for at in range(0, len(i), 1 << 15):
        own = slice(at, at + (1 << 15))
        if exact:
            out[own] = np.einsum("ij,ij->i", q[i[own]], x[j[own]]).astype(np.int64)
        else:
            out[own] = np.clip((_whole(q[i[own]]) * _whole(x[j[own]])).sum(axis=1), LEAST, MOST).astype(np.int64)
    return out


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, which are null) of a column of longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False)


def first_k(group: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, ranks from 0) of each group's first ``k``: higher scores first, ties by smaller id, null ids last."""
    order = np.lexsort((ids, null, ~score, group))
    sorted_group = group[order]
    starts = np.nonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))[0] if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    kept = rank < k
    return order[kept], rank[kept]
